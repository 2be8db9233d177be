"""Text recognition around a pluggable engine: page rules, guards and layout as DataFrame logic."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.errors import OcrPageError, OcrUnavailableError
from corpusloom.functions.text import alnum_count, strip

#: Share of a page that images must cover for it to be read as a picture.
IMAGE_SHARE = 0.30
#: The columns of the engine's word table.
TSV_COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
NEEDED = ("level", "block_num", "par_num", "line_num", "word_num", "conf", "text")


def image_coverage(images: DataFrame) -> DataFrame:
    """(page_id, coverage) of (page_id, page_width, page_height, xref, x0, y0, x1, y1).

    Each image counts once, clipped to the page; overlaps count twice; at most 1.
    """
    once = images.dropDuplicates(["page_id", "xref"])
    width = F.greatest(F.least("x1", "page_width") - F.greatest("x0", F.lit(0.0)), F.lit(0.0))
    height = F.greatest(F.least("y1", "page_height") - F.greatest("y0", F.lit(0.0)), F.lit(0.0))
    area = F.max(F.col("page_width") * F.col("page_height"))
    share = F.when(area > 0, F.least(F.sum(width * height) / area, F.lit(1.0))).otherwise(0.0)
    return once.groupBy("page_id").agg(F.coalesce(share, F.lit(0.0)).alias("coverage"))


def coverage_of(images: Column, width: Column, height: Column) -> Column:
    """image_coverage of a page whose images are an array<struct<xref,x0,y0,x1,y1>> in its row."""
    seen = F.transform(images, lambda x: x["xref"])
    once = F.filter(images, lambda x, i: F.array_position(seen, x["xref"]) == i + 1)

    def side(a: Column, b: Column, most: Column) -> Column:
        return F.greatest(F.least(b, most) - F.greatest(a, F.lit(0.0)), F.lit(0.0))

    area = F.aggregate(once, F.lit(0.0), lambda acc, x: acc + side(x["x0"], x["x1"], width) * side(x["y0"], x["y1"], height))
    return F.coalesce(F.when(width * height > 0, F.least(area / (width * height), F.lit(1.0))), F.lit(0.0))


def needs_ocr(text: Column, coverage: Column, min_native_chars: int = 25) -> Column:
    """Few letters and digits, and mostly images."""
    return (alnum_count(text) < min_native_chars) & (F.coalesce(coverage, F.lit(0.0)) >= IMAGE_SHARE)


def raster_error(width: Column, height: Column, dpi: int, most: int) -> Column:
    """Why a page of this size in points must not be drawn; null if it may be."""
    pixels = F.floor(width * dpi / 72).cast("bigint") * F.floor(height * dpi / 72).cast("bigint")
    return F.when(pixels > most, "ocr_page:too_many_pixels")


def _rows(tables: DataFrame) -> DataFrame:
    """One row for each line of (doc, tsv) behind the header, as an array of fields; `names` has the header's."""
    lines = tables.where(strip(F.coalesce("tsv", F.lit(""))) != "").select("doc", F.split("tsv", "\r\n|\r|\n").alias("lines"))
    heads = lines.withColumn("names", F.transform(F.split(F.col("lines")[0], "\t"), lambda x: F.lower(strip(x))))
    rows = heads.select("doc", "names", F.posexplode("lines").alias("pos", "line")).where("pos > 0")
    return rows.select("doc", "names", "pos", F.split("line", "\t").alias("f"))


def tsv_layout(tables: DataFrame) -> DataFrame:
    """(doc, text, mean_confidence, error_code) of (doc, tsv): words to lines, lines to paragraphs.

    Short rows, rows with a field that is no number, blank words and negative confidences are skipped.
    """
    blank = tables.select("doc", strip(F.coalesce("tsv", F.lit(""))).alias("t"), F.split("tsv", "\r\n|\r|\n").alias("lines"))
    names = F.transform(F.split(F.col("lines")[0], "\t"), lambda x: F.lower(strip(x)))
    lacks = F.size(F.array_except(F.array(*[F.lit(n) for n in NEEDED]), names)) > 0
    heads = blank.select("doc", F.when((F.col("t") != "") & lacks, F.lit("ocr_page:missing_column")).alias("error_code"))

    def field(name: str) -> Column:
        return F.get(F.col("f"), (F.array_position("names", name) - 1).cast("int"))

    def number(name: str, kind: str = "int") -> Column:
        pattern = r"^[+-]?[0-9]+$" if kind == "int" else r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
        return F.when(strip(field(name)).rlike(pattern), strip(field(name)).try_cast(kind))

    def absent(name: str) -> Column:
        return ~F.array_contains("names", name)

    words = _rows(tables).where(F.size("f") >= F.size("names"))
    words = words.select(
        "doc", "pos", number("level").alias("level"), (absent("page_num") | number("page_num").isNotNull()).alias("paged"), number("block_num").alias("block"), number("par_num").alias("par"),
        number("line_num").alias("line"), number("word_num").alias("word"), F.when(absent("left"), 0).otherwise(number("left")).alias("left"), number("conf", "double").alias("conf"), strip(field("text")).alias("w"),
    )
    words = words.where("level is not null and paged and block is not null and par is not null and line is not null and word is not null and left is not null and conf >= 0 and w <> ''")

    def joined(column: str, by: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), by)

    lines = words.groupBy("doc", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "left", "pos", "w"))), lambda x: x["w"]), " ").alias("v"), F.sum("conf").alias("conf"), F.count("*").alias("n")
    )
    pars = lines.withColumn("k", F.col("line")).groupBy("doc", "block", "par").agg(joined("v", "\n").alias("v"), F.sum("conf").alias("conf"), F.sum("n").alias("n"))
    docs = pars.withColumn("k", F.struct("block", "par")).groupBy("doc").agg(joined("v", "\n\n").alias("text"), F.round(F.sum("conf") / F.sum("n"), 2).alias("mean_confidence"))
    out = heads.join(docs, "doc", "left")
    ok = F.col("error_code").isNull()
    return out.select("doc", F.when(ok, F.coalesce("text", F.lit(""))).alias("text"), F.when(ok, F.col("mean_confidence")).alias("mean_confidence"), "error_code")


def gap_layout(tables: DataFrame) -> DataFrame:
    """(doc, text) of (doc, tsv): lines in order of appearance, with ` | ` at wide gaps between words.

    A gap is wide from twice the median of the line's positive gaps on, and from 20 on. Needs the
    engine's exact header.
    """
    exact = F.array(*[F.lit(c) for c in TSV_COLUMNS])
    rows = _rows(tables).where((F.size("f") == len(TSV_COLUMNS)))
    heads = tables.select("doc", F.transform(F.split(F.split(F.coalesce("tsv", F.lit("")), "\r\n|\r|\n")[0], "\t"), lambda x: strip(x)).alias("h"))
    at = {c: i for i, c in enumerate(TSV_COLUMNS)}

    def whole(name: str) -> Column:
        return F.when(strip(F.col("f")[at[name]]).rlike(r"^[+-]?[0-9]+$"), strip(F.col("f")[at[name]]).try_cast("int"))

    conf = strip(F.col("f")[at["conf"]])
    conf = F.when(conf.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), conf.try_cast("double"))
    words = rows.select("doc", "pos", whole("block_num").alias("block"), whole("par_num").alias("par"), whole("line_num").alias("line"), whole("left").alias("left"), whole("width").alias("width"), conf.alias("conf"), strip(F.col("f")[at["text"]]).alias("w"))
    words = words.where("block is not null and par is not null and line is not null and left is not null and width is not null and conf >= 0 and w <> ''")
    line = Window.partitionBy("doc", "block", "par", "line")
    before = line.orderBy("left", "pos")
    words = words.withColumn("gap", F.col("left") - F.lag(F.col("left") + F.col("width")).over(before))
    words = words.withColumn("middle", F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(line), F.lit(10.0)))
    wide = F.when(F.col("gap").isNull(), "").when(F.col("gap") >= F.greatest(2.0 * F.col("middle"), F.lit(20.0)), " | ").otherwise(" ")
    lines = words.withColumn("part", F.concat(wide, F.col("w"))).groupBy("doc", "block", "par", "line").agg(
        F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "pos", "part"))), lambda x: x["part"]), "").alias("v")
    )
    docs = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]), "\n").alias("text"))
    good = F.col("h") == exact
    return heads.join(docs, "doc", "left").select("doc", F.when(good, F.coalesce("text", F.lit(""))).otherwise("").alias("text"))


class Recognized(NamedTuple):
    text: str
    mean_confidence: float | None


class OcrEngine(Protocol):
    """An image's bytes to text; raises OcrPageError for a bad page, OcrUnavailableError if it can't work at all."""

    def version(self) -> str: ...

    def recognize(self, image: bytes, language: str, timeout: float) -> Recognized: ...


class CommandEngine:
    """Runs a command-line engine once a page: image on its input, a word table on its output."""

    def __init__(self, command: str = "tesseract", layout=None) -> None:
        self.command, self.layout = command, layout or layout_of
        self._version: str | None = None

    def executable(self) -> str:
        """Where the command is: a name on the path, or a file."""
        found = shutil.which(self.command) or (self.command if os.path.isfile(self.command) else None)
        if found is None:
            raise OcrUnavailableError(f"no executable {self.command!r}")
        return found

    def version(self) -> str:
        """The first line that the engine says of itself; asked once."""
        if self._version is None:
            try:
                done = subprocess.run([self.executable(), "--version"], capture_output=True, timeout=10, check=False)
            except (OSError, subprocess.TimeoutExpired) as e:
                raise OcrUnavailableError(str(e)) from e
            said = (done.stdout or done.stderr).decode("utf-8", "replace").splitlines()
            if done.returncode or not said:
                raise OcrUnavailableError(f"the engine does not tell its version: code {done.returncode}")
            self._version = said[0].strip()
        return self._version

    def recognize(self, image: bytes, language: str = "eng", timeout: float = 60.0) -> Recognized:
        if not re.fullmatch(r"[A-Za-z]{3}(_[A-Za-z]+)?(\+[A-Za-z]{3}(_[A-Za-z]+)?)*", language):
            raise OcrPageError(f"bad language {language!r}")
        try:
            done = subprocess.run([self.executable(), "stdin", "stdout", "-l", language, "--psm", "3", "tsv"], input=image, capture_output=True, timeout=timeout, check=False)
        except FileNotFoundError as e:
            raise OcrUnavailableError(str(e)) from e
        except subprocess.TimeoutExpired as e:
            raise OcrPageError(f"no result in {timeout} s") from e
        said = done.stderr.decode("utf-8", "replace")
        if done.returncode:
            raise (OcrUnavailableError if "traineddata" in said or "loading language" in said else OcrPageError)(said[:500])
        return self.layout(done.stdout.decode("utf-8", "replace"))


def layout_of(tsv: str) -> Recognized:
    """tsv_layout for one table in a worker, for engines that answer page by page."""
    lines = [x.split("\t") for x in re.split(r"\r\n|\r|\n", tsv)]
    if not tsv.strip():
        return Recognized("", None)
    names = [x.strip().lower() for x in lines[0]]
    if not set(NEEDED) <= set(names):
        raise OcrPageError("the word table lacks a column")
    at = {n: i for i, n in enumerate(names)}
    words = []
    for i, f in enumerate(lines[1:]):
        try:
            if len(f) >= len(names):
                numbers = [int(f[at[n]]) if n in at else 0 for n in ("block_num", "par_num", "line_num", "word_num", "left", "level", "page_num")]
                conf, text = float(f[at["conf"]]), f[at["text"]].strip()
                if text and conf >= 0:
                    words.append((*numbers[:5], i, text, conf))
        except ValueError:
            continue
    if not words:
        return Recognized("", None)
    pars: dict[tuple, dict[int, list[str]]] = {}
    for block, par, line, _, _, _, text, _ in sorted(words):
        pars.setdefault((block, par), {}).setdefault(line, []).append(text)
    text = "\n\n".join("\n".join(" ".join(w) for w in ls.values()) for ls in pars.values())
    return Recognized(text, round(sum(w[-1] for w in words) / len(words), 2))


def recognize(images: DataFrame, engine: OcrEngine, language: str = "eng", timeout: float = 60.0) -> DataFrame:
    """(page_id, text, mean_confidence, error_code) of (page_id, image). An engine that can't work stops the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, image in zip(b["page_id"], b["image"], strict=True):
                try:
                    got = engine.recognize(bytes(image), language, timeout)
                    rows.append((page, got.text, got.mean_confidence, None))
                except OcrPageError:
                    rows.append((page, None, None, "ocr_page"))
            yield pd.DataFrame(rows, columns=["page_id", "text", "mean_confidence", "error_code"])

    kind = dict(images.dtypes)["page_id"]
    return images.select("page_id", "image").mapInPandas(run, f"page_id {kind}, text string, mean_confidence double, error_code string")


def pdf_outcome(pages: DataFrame, max_pages: int = 50) -> DataFrame:
    """(document_id, status, n_pages, ocr_pages, failed_pages) by the rules for scanned documents.

    pages: (document_id, page_number, native_text, wants_ocr, ocr_text, ocr_error). ocr_pages are the
    pages tried. A page whose recognition failed or gave no letter or digit keeps its native text; a
    document with pages tried but no letter or digit anywhere has no text to extract; more pages to
    recognise than `max_pages` are too many.
    """
    tried = F.col("wants_ocr")
    failed = tried & (F.col("ocr_error").isNotNull() | (alnum_count("ocr_text") == 0))
    text = F.when(tried & ~failed, F.col("ocr_text")).otherwise(F.col("native_text"))
    rows = pages.select("document_id", "page_number", tried.alias("tried"), failed.alias("failed"), (alnum_count(text) > 0).alias("speaks"))
    agg = rows.groupBy("document_id").agg(
        F.count("*").alias("n_pages"),
        F.count_if("tried").alias("n_tried"),
        F.count_if("tried").alias("ocr_pages"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("page_number")))).alias("failed_pages"),
        F.bool_or("speaks").alias("speaks"),
    )
    status = F.when(F.col("n_tried") > max_pages, "ocr_limit_exceeded").when((F.col("n_tried") > 0) & ~F.col("speaks"), "no_extractable_text").otherwise("ok")
    return agg.select("document_id", status.alias("status"), "n_pages", "ocr_pages", "failed_pages")


