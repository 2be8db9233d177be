from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.errors import OcrPageError, OcrUnavailableError
from corpusloom.sources import files as FS
from corpusloom.sources import ocr as O
from corpusloom.streaming.indexing import index_stream
from corpusloom.operators.store import ChunkStore

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = docx(p(" One ") + p("  ") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("") + "</w:tc></w:tr><w:tr><w:tc>" + p(" ") + "</w:tc></w:tr></w:tbl>" + p("Two"))


def png(width: int, height: int) -> bytes:
    def block(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + block(b"IDAT", zlib.compress(bytes((width + 1) * height))) + block(b"IEND", b"")


def exif(value: int, order: str = ">") -> bytes:
    tiff = (b"MM" if order == ">" else b"II") + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}HHHIHH", 1, 0x0112, 3, 1, value, 0)
    return b"\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff


PNG = png(30, 20)
SIZES = b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 20, 30) + b"\x01" * 4
JPEG = b"\xff\xd8" + exif(6) + b"\xff\xe0\0\x04ab" + SIZES + b"\xff\xda\0\x02"
END = b"\xff\xd9"


def test_file_checks(spark):
    rows = [("/a/x.pdf", 5), ("/a/x.PDF", 11), ("/a/x.txt", 5), ("/a/x.docx", 0), (None, 5), ("/a.pdf/x", 5), ("/a/x.jpeg", 10)]
    df = spark.createDataFrame(rows, "path string, length bigint")
    assert [r[0] for r in df.select(FS.file_error(F.col("path"), F.col("length"), 10)).collect()] == [None, "file_too_large", "unsupported_format", "empty_file", "file_missing", "unsupported_format", None]


def test_docx_and_image_headers():
    assert FS.docx_text(DOCX) == "One\nTwo\na | "
    assert FS.image_size(PNG) == (30, 20) and FS.image_size(JPEG) == (30, 20) and FS.image_size(b"nothing") is None
    assert [FS.orientation(b"\xff\xd8" + exif(v, o) + SIZES) for v in (1, 6, 9) for o in "<>"] == [1, 1, 6, 6, 1, 1]
    assert FS.orientation(PNG) == FS.orientation(b"\xff\xd8" + SIZES) == FS.orientation(JPEG[:20]) == 1 and FS.orientation(JPEG) == 6
    assert FS.whole_png(PNG) and not any(FS.whole_png(x) for x in (PNG[:-5], PNG[:-13], PNG[:45] + b"x" + PNG[46:], b""))


def test_scanned_files(spark):
    from corpusloom.plans.queries import _Engine, _Reader

    def pdf(*pages: str) -> bytes:
        return b"%PDF" + "\f".join(pages).encode()

    scan = "[scan 612 792]"
    rows = {
        "a.pdf": pdf("own text of a page", scan + "picture", scan + "Trouble"), "b.pdf": pdf(scan, "--"), "c.pdf": pdf(*[scan + "x"] * 3), "d.pdf": pdf("[scan 9000 9000]x", "some"),
        "e.pdf": b"%PDF\xff", "f.pdf": b"no pdf", "g.txt": b"x", "h.pdf": b"", "i.docx": DOCX, "j.pdf": pdf("plain"),
    }
    files = spark.createDataFrame([(f"/in/{k}", len(v), v) for k, v in rows.items()], "path string, length bigint, content binary")
    got = FS.load_scanned(files, _Reader(), _Engine(), max_pages=2).collect()
    errors = {r.document_name: r.error_code for r in got if r.error_code}
    assert errors == {"b.pdf": "no_extractable_text", "c.pdf": "ocr_limit_exceeded", "e.pdf": "invalid_document", "f.pdf": "content_mismatch", "g.txt": "unsupported_format", "h.pdf": "empty_file", "i.docx": "unsupported_format"}
    pages = {(r.document_name, r.page_number): r for r in got if not r.error_code}
    assert {k: r.content for k, r in pages.items()} == {("a.pdf", 1): "own text of a page", ("a.pdf", 2): "read: picture", ("a.pdf", 3): "", ("d.pdf", 1): "", ("d.pdf", 2): "some", ("j.pdf", 1): "plain"}
    a = pages["a.pdf", 2]
    assert a.page_metadata == {"char_count": "13", "extraction_method": "ocr", "ocr_mean_confidence": "90.0"}
    assert a.metadata == {"total_pages": "3", "file_size_bytes": str(len(rows["a.pdf"])), "ocr_page_count": "2", "ocr_failed_pages": "3", "ocr_engine": "stand-in 1", "ocr_language": "eng", "ocr_dpi": "300"}
    assert pages["d.pdf", 1].metadata["ocr_failed_pages"] == "1" and "ocr_engine" not in pages["j.pdf", 1].metadata

    class Gone(_Engine):
        def recognize(self, image, language, timeout):
            raise OcrUnavailableError("no engine")

    with pytest.raises(Exception, match="no engine"):
        FS.load_scanned(files.where("path like '%a.pdf'"), _Reader(), Gone()).collect()
    assert FS.load_scanned(files.limit(0), _Reader(), _Engine()).count() == 0


def test_sizes_are_checked_by_the_scan(spark, tmp_path):
    for name, n in (("small.pdf", 10), ("large.pdf", 5000)):
        (tmp_path / name).write_bytes(b"%PDF".ljust(n, b"x"))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    plan = FS.load_pages(files, max_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan and "content" not in plan.split("ReadSchema")[-1].split(">")[0]


def test_command(tmp_path):
    with pytest.raises(OcrUnavailableError):
        O.CommandEngine("surely-no-such-command").version()
    tool = tmp_path / "engine"
    tool.write_text("#!/bin/sh\necho engine 5.1\necho more\n")
    tool.chmod(0o755)
    engine = O.CommandEngine(str(tool))
    assert engine.executable() == str(tool) and engine.version() == "engine 5.1"
    tool.write_text("#!/bin/sh\nexit 3\n")
    assert engine.version() == "engine 5.1"  # asked once
    with pytest.raises(OcrUnavailableError):
        O.CommandEngine(str(tool)).version()


class Engine:
    def recognize(self, image, language, timeout):
        if b"bad" in image:
            raise OcrPageError("bad")
        return O.Recognized("-" if b"dash" in image else "seen", 90.0)


def test_load_pages(spark, tmp_path):
    for name, content in {"a.docx": DOCX, "b.pdf": b"%PDF one|two", "c.png": PNG, "d.png": b"%PDF", "e.txt": b"x", "f.docx": b"PK\x03\x04 broken", "g.png": PNG + b"dash", "h.pdf": b"%PDF", "i.jpg": JPEG + b"bad" + END, "j.pdf": b"", "k.png": PNG[:-6], "l.jpg": JPEG + END}.items():
        (tmp_path / name).write_bytes(content)
    files = FS.read_files(spark, f"file://{tmp_path}")
    pages = FS.load_pages(files, lambda b: [x for x in b[5:].decode().split("|") if x], Engine(), 10_000).collect()
    got = {(r.document_name, r.page_number): (r.content, r.error_code) for r in pages}
    assert got == {
        ("a.docx", 1): ("One\nTwo\na | ", None), ("b.pdf", 1): ("one", None), ("b.pdf", 2): ("two", None), ("c.png", 1): ("seen", None), ("d.png", None): (None, "content_mismatch"), ("e.txt", None): (None, "unsupported_format"),
        ("f.docx", None): (None, "invalid_document"), ("g.png", None): (None, "no_extractable_text"), ("h.pdf", None): (None, "invalid_document"), ("i.jpg", None): (None, "no_extractable_text"), ("j.pdf", None): (None, "empty_file"), ("k.png", None): (None, "invalid_document"), ("l.jpg", 1): ("seen", None),
    }
    turned = next(r for r in pages if r.document_name == "l.jpg").metadata
    assert (turned["image_width"], turned["image_height"], turned["ocr_mean_confidence"]) == ("20", "30", "90.0")
    without = {r.document_name: r.error_code for r in FS.load_pages(files, max_pixels=100).collect()}
    assert without["b.pdf"] == without["c.png"] == "no_extractor"
    assert {r.document_name: r.error_code for r in FS.load_pages(files, None, Engine(), max_pixels=100).collect()}["c.png"] == "ocr_limit_exceeded"


HEAD = "\t".join(O.TSV_COLUMNS)


def word(block, par, line, n, left, text, conf="90", width=40):
    return f"5\t1\t{block}\t{par}\t{line}\t{n}\t{left}\t0\t{width}\t10\t{conf}\t{text}"


TABLES = [
    "\n".join([HEAD, word(1, 1, 1, 2, 50, "world", "80.5"), word(1, 1, 1, 1, 0, "hello"), word(1, 1, 2, 1, 0, "again"), word(1, 2, 1, 1, 0, "par"), word(2, 1, 1, 1, 0, "block"), word(2, 1, 1, 2, 9, "no", "-1"), word(2, 1, 1, "x", 9, "no"), "5\t1", word(2, 1, 1, 3, 9, "  ")]),
    "", " \n ", None, HEAD, "level\tconf\n5\t90",
    "\n".join([HEAD, word(3, 1, 1, 1, 0, "a"), word(3, 1, 1, 2, 45, "b"), word(3, 1, 1, 3, 90, "c"), word(3, 1, 1, 4, 300, "d"), word(1, 1, 1, 1, 0, "later")]),
]


def test_layouts(spark):
    df = spark.createDataFrame(list(enumerate(TABLES)), "doc int, tsv string")
    got = {r.doc: (r.text, r.mean_confidence, r.error_code) for r in O.tsv_layout(df).collect()}
    assert got[0] == ("hello world\nagain\n\npar\n\nblock", 88.1, None)
    assert got[1] == got[2] == got[3] == got[4] == ("", None, None) and got[5] == (None, None, "ocr_page:missing_column")
    for i in (0, 1, 2, 4, 6):
        assert tuple(O.layout_of(TABLES[i])) == got[i][:2]
    with pytest.raises(OcrPageError):
        O.layout_of(TABLES[5])
    gaps = {r.doc: r.text for r in O.gap_layout(df).collect()}
    assert gaps[6] == "a b c | d\nlater" and gaps[5] == gaps[3] == ""


def test_page_rules(spark):
    images = [(1, 100.0, 100.0, 1, -50.0, 0.0, 50.0, 50.0), (1, 100.0, 100.0, 1, 0.0, 0.0, 100.0, 100.0), (1, 100.0, 100.0, 2, 0.0, 50.0, 50.0, 150.0), (2, 100.0, 0.0, 1, 0.0, 0.0, 9.0, 9.0), (3, 10.0, 10.0, 1, 0.0, 0.0, 10.0, 10.0), (3, 10.0, 10.0, 2, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(images[:1] + images[2:], "page_id int, page_width double, page_height double, xref int, x0 double, y0 double, x1 double, y1 double")
    assert {r.page_id: r.coverage for r in O.image_coverage(df).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    texts = spark.createDataFrame([("a" * 24, 0.3), ("a" * 25, 0.3), ("", 0.29), ("", None)], "t string, c double")
    assert [r[0] for r in texts.select(O.needs_ocr(F.col("t"), F.col("c"))).collect()] == [True, False, False, False]
    guard = spark.range(1).select(O.raster_error(F.lit(72.0), F.lit(72.7), 100, 10_000), O.raster_error(F.lit(72.0), F.lit(73.0), 100, 10_000)).first()
    assert tuple(guard) == (None, "ocr_page:too_many_pixels")


def test_pdf_outcome(spark):
    rows = [("a", 1, "native", False, None, None), ("a", 2, "kept", True, None, "ocr_page"), ("b", 1, "--", True, "?!", None), ("c", 1, "x", True, "y", None), ("c", 2, "x", True, "y", None), ("d", 1, "--", False, None, None)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, native_text string, wants_ocr boolean, ocr_text string, ocr_error string")
    got = {r.document_id: (r.status, r.ocr_pages, r.failed_pages) for r in O.pdf_outcome(df, 1).collect()}
    assert got == {"a": ("ok", 1, [2]), "b": ("no_extractable_text", 1, [1]), "c": ("ocr_limit_exceeded", 2, []), "d": ("ok", 0, [])}


def test_recognize(spark):
    df = spark.createDataFrame([(1, b"good"), (2, b"bad")], "page_id int, image binary")
    assert {tuple(r) for r in O.recognize(df, Engine()).collect()} == {(1, "seen", 90.0, None), (2, None, None, "ocr_page")}
    with pytest.raises(OcrPageError):
        O.CommandEngine().recognize(b"", "x; rm", 1)


def test_stream_into_the_store(spark, tmp_path):
    schema = "document_id string, doc_ord bigint, document_name string, source_type string, page_number int, content string"
    source, store = f"{tmp_path}/in", f"file://{tmp_path}/store"
    for rows in ([("a", 1, "a", "text", 1, "one two three"), ("b", 2, "b", "text", 1, "four")], [("a", 1, "a", "text", 1, "new")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(schema).parquet(source), store, f"{tmp_path}/cp", 5, 1).awaitTermination()
    assert sorted((r.document_id, r.content) for r in ChunkStore(spark, store).read().collect()) == [("a", "new"), ("b", "four")]
