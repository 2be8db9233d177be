"""The chunk store: a log of changes over Parquet, merged when it is read.

A change writes its own rows to a folder of their own and then one small commit file, whose number no
other writer can take; so its cost follows the batch and not the store, readers never see half a
change, and a failed write leaves the store as it was. A read takes the last whole table and the changes
behind it: a row is live unless a later change replaced or deleted its document, or wrote its chunk
anew. From `compact_after` changes on the live rows are written as the next whole table, and what lies
before the table that came before is deleted.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, batch: DataFrame, order: str = "batch_pos", key: str = "chunk_id") -> DataFrame:
    """`stored` with the rows of `batch`: of equal keys in the batch the last counts, and it overwrites a stored one."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    newest = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    old = stored.join(newest.select(key), key, "left_anti")
    return old.unionByName(newest, allowMissingColumns=True)


def replace_documents(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """`stored` with all chunks of the batch's documents replaced by the batch."""
    return stored.join(batch.select("document_id").distinct(), "document_id", "left_anti").unionByName(batch, allowMissingColumns=True)


def delete_document(stored: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and one row with the number of rows removed."""
    if not document_id.strip():
        raise ValueError("document_id must not be blank")
    mine = F.col("document_id").eqNullSafe(F.lit(document_id))
    return stored.where(~mine), stored.where(mine).agg(F.count("*").alias("removed"))


def scan(stored: DataFrame) -> DataFrame:
    """Stored chunks as hits: absent names and texts filled in, score 0."""
    return stored.select(
        "chunk_id",
        F.coalesce("document_id", F.lit("unknown_doc")).alias("document_id"),
        F.coalesce("document_name", F.lit("unknown_file")).alias("document_name"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.lit(0.0).alias("score"),
    )


def scratch_store(spark: SparkSession) -> ChunkStore:
    """A new store in the folder that driver and executors share (``spark.checkpoint.dir``), deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    store = ChunkStore(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")
    store.files.mkdirs(store._at(""))
    store.files.deleteOnExit(store._at(""))
    return store


class ChunkStore:
    """A folder of data folders `<path>/d-<id>` and commits `<path>/_commits/<number>`."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 16) -> None:
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _commits(self) -> list[dict]:
        """The commits from the last whole table on, in order."""
        if not self.files.exists(self._at("_commits")):
            return []
        names = sorted(f.getPath().getName() for f in self.files.listStatus(self._at("_commits")))
        out: list[dict] = []
        for name in reversed([n for n in names if n.isdigit()]):
            stream = self.files.open(self._at(f"_commits/{name}"))
            try:
                commit = json.loads(bytes(stream.readAllBytes())) | {"number": int(name)}
            finally:
                stream.close()
            if out and commit["number"] <= max(c.get("upto", 0) for c in out) and "upto" not in commit:
                break
            out.append(commit)
            if commit.get("upto") == commit["number"] - 1:  # nothing came between its reading and its writing
                break
        whole = max((c for c in out if "upto" in c), key=lambda c: c["number"], default=None)
        later = [c for c in out if "upto" not in c and (whole is None or c["number"] > whole["upto"])]
        return ([whole] if whole else []) + sorted(later, key=lambda c: c["number"])

    def _commit(self, **commit: object) -> int:
        """Take the next free number. A file that is renamed to its name is complete, and never replaces another."""
        jvm = self.spark._jvm
        draft = self._at(f"_commits/.draft-{uuid.uuid4().hex}")
        out = self.files.create(draft)
        out.write(json.dumps(commit).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        number = self.version()
        while True:
            number += 1
            try:
                context.rename(draft, self._at(f"_commits/{number:012d}"), none)
                return number
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise

    def _write(self, rows: DataFrame) -> str:
        name = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def version(self) -> int:
        """The number of the last change; 0 for a new store."""
        return max((c["number"] for c in self._commits()), default=0)

    def _live(self, commits: list[dict]) -> DataFrame | None:
        with_rows = [c for c in commits if c.get("data")]
        if not with_rows:
            return None
        tables = {c["number"]: self.spark.read.parquet(f"{self.path}/{c['data']}") for c in with_rows}
        if len(commits) == 1:
            return tables[commits[0]["number"]]
        # a whole table stands where its last change stood
        at = {c["number"]: c.get("upto", c["number"]) for c in commits}
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [t.withColumn("_at", F.lit(at[n])) for n, t in tables.items()])
        gone = [self.spark.createDataFrame([(c["document_id"], c["number"])], "document_id string, _gone int") for c in commits if c["kind"] == "delete"]
        gone += [tables[c["number"]].select("document_id").distinct().withColumn("_gone", F.lit(c["number"])) for c in commits if c["kind"] == "index"]
        anew = [tables[c["number"]].select("chunk_id").distinct().withColumn("_anew", F.lit(c["number"])) for c in commits if c["kind"] == "add"]
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy("document_id").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, "document_id", "left").where("_gone is null or _at >= _gone").drop("_gone")
        if anew:
            last = reduce(DataFrame.unionByName, anew).groupBy("chunk_id").agg(F.max("_anew").alias("_anew"))
            rows = rows.join(last, "chunk_id", "left").where("_anew is null or _at >= _anew").drop("_anew")
        return rows.drop("_at")

    def read(self) -> DataFrame | None:
        return self._live(self._commits())

    def _change(self, **commit: object) -> int:
        number = self._commit(**commit)
        if len(self._commits()) > self.compact_after:
            self.compact()
        return number

    def publish(self, rows: DataFrame) -> int:
        """Put `rows` in the place of all that is stored."""
        upto = self.version()
        return self._commit(kind="whole", data=self._write(rows), upto=upto)

    def compact(self) -> int:
        """Write the live rows as a whole table, and delete what no reader of it or of the table before needs."""
        commits = self._commits()
        live = self._live(commits)
        if live is None:
            return self.version()
        before = next((c for c in commits if "upto" in c), None)
        number = self._commit(kind="whole", data=self._write(live), upto=max(c["number"] for c in commits))
        if before:
            self._vacuum(before)
        return number

    def _vacuum(self, oldest: dict) -> None:
        """Delete the commits and rows that the whole table `oldest` took in."""
        kept = {oldest["data"]}
        for f in self.files.listStatus(self._at("_commits")):
            name = f.getPath().getName()
            if name.isdigit() and int(name) != oldest["number"]:
                stream = self.files.open(f.getPath())
                data = json.loads(bytes(stream.readAllBytes())).get("data")
                stream.close()
                if int(name) <= oldest["upto"] and data not in kept:
                    if data:
                        self.files.delete(self._at(data), True)
                    self.files.delete(f.getPath(), False)

    def add(self, batch: DataFrame, order: str = "chunk_index") -> int:
        """Write the batch's chunks, over stored ones of the same chunk_id; of equal ones in the batch the last counts."""
        return self._change(kind="add", data=self._write(upsert(batch.limit(0), batch, order)))

    def index(self, batch: DataFrame) -> int:
        """Replace the batch's documents."""
        return self._change(kind="index", data=self._write(batch))

    def delete(self, document_id: str) -> int:
        """Remove a document; the number of chunks that went."""
        old = self.read()
        if old is None:
            return 0
        n = delete_document(old, document_id)[1].first()[0]
        if n:
            self._change(kind="delete", document_id=document_id)
        return n

    def count(self) -> int:
        old = self.read()
        return 0 if old is None else old.count()

    def reset(self) -> None:
        old = self.read()
        if old is not None:
            self.publish(old.limit(0))
