"""Files to pages: validation, format detection and loaders over `binaryFile`.

Validation reads paths and lengths only; the content column is pruned until a loader needs it. Word
documents are read with the standard library. PDF pages and pictures come from extractors that the
caller plugs in; without one such a file gets an error code.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.errors import OcrPageError, OcrUnavailableError
from corpusloom.functions.text import alnum_count
from corpusloom.sources.ocr import OcrEngine, coverage_of, needs_ocr, raster_error

SUFFIXES = (".pdf", ".docx", ".png", ".jpg", ".jpeg")
#: The first bytes of each format, and its suffixes.
FORMATS = (("pdf", b"%PDF", (".pdf",)), ("docx", b"PK\x03\x04", (".docx",)), ("png", b"\x89PNG\r\n\x1a\n", (".png",)), ("jpeg", b"\xff\xd8\xff", (".jpg", ".jpeg")))

PAGE = "document_id string, document_name string, source_type string, page_number int, content string, metadata map<string,string>, error_code string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content) of all files below a path.

    Spark's reader leaves out files without a byte; they are listed apart, so that each gets its error code.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, empty = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        if not f.getLen():
            empty.append((f.getPath().toString(),))
    if not empty:
        return files
    rows = spark.createDataFrame(empty, "path string")
    return files.unionByName(rows.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]+)$", 1))


def file_error(path: Column, length: Column, max_bytes: int | None = None) -> Column:
    """The first reason against a file, from cheap to dear; null if there is none."""
    out = F.when(path.isNull() | length.isNull(), "file_missing").when(length == 0, "empty_file")
    if max_bytes is not None:
        out = out.when(length > max_bytes, "file_too_large")
    return out.when(~suffix(path).isin(*SUFFIXES), "unsupported_format")


def detect_format(path: Column, head: Column) -> Column:
    """struct<format, error_code>: the format by the first bytes and the suffix, which must agree."""
    fmt, known = F.lit(None).cast("string"), F.lit(False)
    for name, magic, ends in FORMATS:
        mine = suffix(path).isin(*ends)
        fmt = F.when(mine & F.startswith(head, F.lit(magic)), name).otherwise(fmt)
        known = known | mine
    error = F.when(fmt.isNotNull(), None).when(known, "content_mismatch").otherwise("unsupported_format")
    return F.struct(fmt.alias("format"), error.alias("error_code"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs outside tables, then tables: a line for each row, its cells joined by ` | `, without empty rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p: ElementTree.Element) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        return "".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()).strip()

    out = [t for p in body.findall(f"{_W}p") if (t := text(p))]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            cells = ["\n".join(text(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                out.append(" | ".join(cells))
    return "\n".join(out)


def table_rows_text(cells: list[Column]) -> Column:
    """A relational row as a line of text; null if every cell is empty."""
    parts = [F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]
    return F.when(F.concat(*parts) != "", F.concat_ws(" | ", *parts))


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height by a picture's header, before anything is decoded."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 < len(content):
        if content[at] != 0xFF:
            return None
        mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", content[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def orientation(content: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 to 8; 1 if it has none. From 5 on width and height change places."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        block = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and block[:6] == b"Exif\0\0" and len(block) >= 14:
            tiff, order = block[6:], "<" if block[6:8] == b"II" else ">"
            first = struct.unpack(f"{order}I", tiff[4:8])[0]
            if first + 2 <= len(tiff):
                for i in range(struct.unpack(f"{order}H", tiff[first : first + 2])[0]):
                    entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
                    if len(entry) == 12 and struct.unpack(f"{order}H", entry[:2])[0] == 0x0112:
                        value = struct.unpack(f"{order}H", entry[8:10])[0]
                        return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def whole_png(content: bytes) -> bool:
    """Whether a PNG's chunks and its compressed rows are complete."""
    at, data, ended = 8, zlib.decompressobj(), False
    try:
        while at + 12 <= len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            block = content[at + 8 : at + 8 + size]
            if len(block) < size or struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + block):
                return False
            if kind == b"IDAT":
                while block:  # decompressed in parts, and not kept
                    data.decompress(block, 1 << 20)
                    block = data.unconsumed_tail
            ended = ended or kind == b"IEND"
            at += 12 + size
    except (struct.error, zlib.error):
        return False
    return ended and data.eof


#: A picture's bytes, found sound by its header and size, to the bytes that an engine gets.
Normalizer = Callable[[bytes], bytes]


def upright_gray(content: bytes) -> bytes:
    """A picture decoded, turned by its EXIF orientation, and written as a PNG of 8-bit grey.

    This needs an image library; without one a complete file goes on as it is. Raises for a broken one.
    """
    try:
        from PIL import Image, ImageOps
    except ImportError:
        if not (whole_png(content) if content[:4] == b"\x89PNG" else content.rstrip(b"\0").endswith(b"\xff\xd9")):
            raise ValueError("the picture is incomplete") from None
        return content
    out = io.BytesIO()
    with Image.open(io.BytesIO(content)) as image:
        image.load()
        ImageOps.exif_transpose(image).convert("L").save(out, format="PNG")
    return out.getvalue()


#: A file's bytes to the texts of its pages.
PageExtractor = Callable[[bytes], list[str]]


def _validated(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """(path, length, bad, format, content): content is null for a file with an error.

    The cheap checks filter the scan, so the bytes of files that fail them are not read.
    """
    error = file_error(F.col("path"), F.col("length"), max_bytes)
    none = F.lit(None)
    failed = files.where(error.isNotNull()).select("path", "length", error.alias("bad"), none.cast("string").alias("format"), none.cast("binary").alias("content"))
    sound = files.where("path is not null").where("length > 0")
    sound = (sound if max_bytes is None else sound.where(F.col("length") <= max_bytes)).where(error.isNull())
    head = sound.withColumn("d", detect_format(F.col("path"), F.substring("content", 1, 8)))
    rows = head.select("path", "length", F.col("d.error_code").alias("bad"), "d.format", F.when(F.col("d.error_code").isNull(), F.col("content")).alias("content"))
    return rows.unionByName(failed)


def load_pages(
    files: DataFrame, pdf: PageExtractor | None = None, ocr: OcrEngine | None = None, max_bytes: int | None = None, max_pixels: int = 40_000_000, language: str = "eng", timeout: float = 60.0, normalize: Normalizer = upright_gray
) -> DataFrame:
    """PAGE rows of (path, length, content): one for each page, or one with an error code for a file that can't be read."""

    def image(path: str, name: str, fmt: str, content: bytes) -> tuple:
        size = image_size(content)
        if ocr is None or size is None or size[0] * size[1] > max_pixels:
            return path, name, "image", None, None, {}, "no_extractor" if ocr is None else "invalid_document" if size is None else "ocr_limit_exceeded"
        try:
            normal = normalize(content)
        except Exception:
            return path, name, "image", None, None, {}, "invalid_document"
        try:
            got = ocr.recognize(normal, language, timeout)
        except OcrUnavailableError:
            raise  # no picture can be read
        except Exception as e:
            return path, name, "image", None, None, {}, "no_extractable_text" if isinstance(e, OcrPageError) else "invalid_document"
        text = got.text.strip()
        if not any(c.isalnum() for c in text):
            return path, name, "image", None, None, {}, "no_extractable_text"
        w, h = size[::-1] if orientation(content) >= 5 else size
        meta = {"total_pages": "1", "file_size_bytes": str(len(content)), "image_format": fmt, "image_width": str(w), "image_height": str(h), "extraction_method": "ocr", "char_count": str(len(text)), "ocr_page_count": "1", "ocr_failed_pages": "", "ocr_language": language}
        if got.mean_confidence is not None:
            meta["ocr_mean_confidence"] = str(got.mean_confidence)
        return path, name, "image", 1, text, meta, None

    def one(path: str, fmt: str, content: bytes) -> Iterator[tuple]:
        name = re.split(r"[\\/]", path)[-1]
        if fmt == "docx":
            try:
                yield path, name, "docx", 1, docx_text(content), {"total_pages": "1", "file_size_bytes": str(len(content))}, None
            except Exception:
                yield path, name, "docx", None, None, {}, "invalid_document"
        elif fmt == "pdf":
            if pdf is None:
                yield path, name, "pdf", None, None, {}, "no_extractor"
                return
            try:
                pages = pdf(content)
            except Exception:
                pages = []
            if not pages:
                yield path, name, "pdf", None, None, {}, "invalid_document"
            for i, text in enumerate(pages):
                yield path, name, "pdf", i + 1, text, {"total_pages": str(len(pages)), "file_size_bytes": str(len(content))}, None
        else:
            yield image(path, name, fmt, content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGE.split(", ")]
        for b in batches:
            out = []
            for path, bad, fmt, content in zip(b["path"], b["bad"], b["format"], b["content"], strict=True):
                if bad is not None:
                    out.append((path, re.split(r"[\\/]", path or "")[-1], None, None, None, {}, bad))
                else:
                    out += one(path, fmt, bytes(content))
            frame = pd.DataFrame(out, columns=names)
            frame["page_number"] = frame["page_number"].astype("Int32")
            yield frame

    return _validated(files, max_bytes).drop("length").mapInPandas(run, PAGE)


class PdfPage(NamedTuple):
    """A page's own text, its size in points, and its pictures as (xref, x0, y0, x1, y1)."""

    text: str
    width: float
    height: float
    images: list[tuple[int, float, float, float, float]]


class PdfReader(Protocol):
    """A PDF's bytes to its pages, and a page drawn as a picture. Raises for a file that it can't read."""

    def pages(self, content: bytes) -> list[PdfPage]: ...

    def draw(self, content: bytes, page_number: int, dpi: int) -> bytes: ...


_NATIVE = "path string, page_number int, native_text string, width double, height double, images array<struct<xref:int,x0:double,y0:double,x1:double,y1:double>>, bad string"


def _native_pages(files: DataFrame, reader: PdfReader) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for path, bad, content in zip(b["path"], b["bad"], b["content"], strict=True):
                try:
                    pages = [] if bad is not None else reader.pages(bytes(content))
                except Exception:
                    pages = []
                out += [(path, i + 1, p.text, p.width, p.height, [dict(zip(("xref", "x0", "y0", "x1", "y1"), x, strict=True)) for x in p.images], None) for i, p in enumerate(pages)]
                if not pages:
                    out.append((path, None, None, None, None, None, bad or "invalid_document"))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _NATIVE.split(", ")])
            frame["page_number"] = frame["page_number"].astype("Int32")
            yield frame

    return files.select("path", "bad", "content").mapInPandas(run, _NATIVE)


def _recognized(files: DataFrame, reader: PdfReader, engine: OcrEngine, dpi: int, language: str, timeout: float) -> DataFrame:
    """(path, page_number, ocr_text, confidence, ocr_error) of (path, content, numbers): one page is drawn at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, numbers in zip(b["path"], b["content"], b["numbers"], strict=True):
                for n in numbers:
                    try:
                        got = engine.recognize(reader.draw(bytes(content), int(n), dpi), language, timeout)
                        out.append((path, int(n), got.text, got.mean_confidence, None))
                    except OcrUnavailableError:
                        raise  # no page can be read
                    except Exception:
                        out.append((path, int(n), None, None, "ocr_page"))
            yield pd.DataFrame(out, columns=["path", "page_number", "ocr_text", "confidence", "ocr_error"])

    return files.select("path", "content", "numbers").mapInPandas(run, "path string, page_number int, ocr_text string, confidence double, ocr_error string")


def load_scanned(
    files: DataFrame, reader: PdfReader, engine: OcrEngine, max_bytes: int | None = None, min_native_chars: int = 25, dpi: int = 300, max_pages: int = 50, max_pixels: int = 40_000_000, language: str = "eng", timeout: float = 60.0
) -> DataFrame:
    """The pages of PDF files (path, length, content), those without text of their own recognised.

    (document_id, document_name, source_type, page_number, content, metadata, page_metadata, error_code),
    as the chunker takes them; a file that failed is one row with its code. A page needs recognition
    by its letters and the share that pictures cover. A file with more such pages than `max_pages` fails
    before any is drawn; a page too large to draw is not drawn. A page whose recognition fails or has
    no letter or digit keeps its own text, and a file without a letter or digit after that fails. An
    engine that can't work ends the job.
    """
    sound = _validated(files, max_bytes).withColumn("bad", F.coalesce("bad", F.when(F.col("format") != "pdf", F.lit("unsupported_format"))))
    pages = _native_pages(sound, reader)
    tried = pages["bad"].isNull() & needs_ocr(F.col("native_text"), coverage_of(F.col("images"), F.col("width"), F.col("height")), min_native_chars)
    file = Window.partitionBy("path")
    rows = pages.withColumn("tried", tried).withColumn("guard", F.when(F.col("tried"), raster_error(F.col("width"), F.col("height"), dpi, max_pixels))).drop("images")
    rows = rows.withColumn("n_tried", F.count_if("tried").over(file)).withColumn("total", F.count("page_number").over(file))
    todo = rows.where(F.col("tried") & F.col("guard").isNull() & (F.col("n_tried") <= max_pages)).groupBy("path").agg(F.sort_array(F.collect_list("page_number")).alias("numbers"))
    read = _recognized(files.select("path", "content").join(todo, "path"), reader, engine, dpi, language, timeout)
    rows = rows.join(read, ["path", "page_number"], "left")
    good = F.col("tried") & F.col("guard").isNull() & F.col("ocr_error").isNull() & (alnum_count("ocr_text") > 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("content", F.when(F.col("good"), F.col("ocr_text")).otherwise(F.col("native_text")))
    failed = F.array_sort(F.collect_list(F.when(F.col("tried") & ~F.col("good"), F.col("page_number"))).over(file))
    rows = rows.withColumn("failed", failed).withColumn("speaks", F.max(alnum_count("content") > 0).over(file))
    error = F.coalesce("bad", F.when(F.col("n_tried") > max_pages, "ocr_limit_exceeded").when((F.col("n_tried") > 0) & ~F.col("speaks"), "no_extractable_text"))
    rows = rows.join(files.select("path", F.col("length").alias("bytes")), "path").withColumn("error_code", error)

    def known(pairs: dict[str, Column]) -> Column:
        """A map of the values that are not null."""
        return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())

    was = F.col("n_tried") > 0
    meta = known({
        "total_pages": F.col("total"), "file_size_bytes": F.col("bytes"), "ocr_page_count": F.when(was, F.col("n_tried")), "ocr_failed_pages": F.when(was, F.array_join(F.col("failed").cast("array<string>"), ",")),
        "ocr_engine": F.when(was, F.lit(engine.version())), "ocr_language": F.when(was, F.lit(language)), "ocr_dpi": F.when(was, F.lit(dpi)),
    })
    own = known({"char_count": F.length("content"), "extraction_method": F.when(F.col("good"), "ocr").otherwise("native_text"), "ocr_mean_confidence": F.when(F.col("good"), F.col("confidence"))})
    shared = [F.col("path").alias("document_id"), F.element_at(F.split("path", r"[\\/]"), -1).alias("document_name"), F.lit("pdf").alias("source_type")]
    none = F.lit(None)
    whole = rows.where("error_code is null").select(*shared, "page_number", "content", meta.alias("metadata"), own.alias("page_metadata"), "error_code")
    lost = rows.where("error_code is not null").groupBy("path").agg(F.min("error_code").alias("error_code"))
    text_map = "map<string,string>"
    return whole.unionByName(lost.select(*shared, none.cast("int").alias("page_number"), none.cast("string").alias("content"), none.cast(text_map).alias("metadata"), none.cast(text_map).alias("page_metadata"), "error_code"))
