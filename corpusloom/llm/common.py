"""What the training-data operators share: the word rule, scratch tables and small helpers.

A word is a run of anything but the six ASCII white-space characters. ``bytes.split()`` splits on
exactly those, and ``bytes.lower()`` touches exactly A-Z, so Python code works on UTF-8 bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of the separator between words.
SPACES = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one is set for a session in a single process, as in tests; a cluster has to name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows and bytes of the batches in which Python workers get their rows, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches of whole texts small; smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: The scratch folders made since the innermost `dropping` began.
_made: list[list[Scratch]] = []


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    They are deleted when the application ends, or earlier by `dropping`.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if _made:
            _made[-1].append(self)

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write `df`, and return it as read again, with its path."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        # what was shuffled for the table is not needed once it is written
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:
            at, files = self._at(self.root)
            files.deleteOnExit(at)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.put(df)[0]

    def drop(self, path: str | None = None) -> None:
        """Delete one of these tables, or all, once no plan reads them."""
        at, files = self._at(path or self.root)
        files.delete(at, True)

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())


@contextmanager
def dropping() -> Iterator[None]:
    """Delete the scratch tables that are made within: for steps whose results are written before the end."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.drop()


def words_of(text: Column) -> Column:
    """The words of a text as an array; of a null text, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def partitions_for(rows: int, each: int) -> int:
    """How many groups of about `each` rows; at least one."""
    return max(1, -(-rows // each))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of `df` by the hash of the whole row, the same in every run; all rows if there are no more.

    A share of the hashes is kept instead of the smallest ones, so that no task sends a whole
    sample's worth of candidates to the driver. At most a fifth more than `rows` are returned: only
    copies of one row can pass that bound together, and it does not matter which of them fall away.
    """
    n = df.count()
    if n <= rows:
        return df
    scale = 1 << 30
    kept = df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit("sample")), F.lit(scale)) < F.lit(max(1, scale * rows // n)))
    return kept.limit(rows + rows // 5)


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
