"""Functions over metadata maps and page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata keys that a chunk sets itself.
CORE = ("chunk_id", "document_id", "document_name", "source_type", "chunk_index", "page_number")


def page_number_of(metadata: Column) -> Column:
    """A page from 1 on under `page_number`, else under `page`; null for anything else.

    Values are text: true and false are no numbers, and 3.0 is 3 while 3.5 is nothing.
    """

    def page(key: str) -> Column:
        # large digits overflow to null rather than fail
        number = F.when(metadata[key].rlike(r"^\s*[0-9]+(\.0*)?\s*$"), metadata[key].try_cast("double"))
        return F.when((number >= 1) & (number < 2**31), number.cast("int"))

    return F.when(F.map_contains_key(metadata, "page_number") & metadata["page_number"].isNotNull(), page("page_number")).otherwise(page("page"))


def flatten_metadata(core: dict[str, Column], extra: Column) -> Column:
    """One flat map: core keys win, absent values and values that are no finite number go."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in core.items()]
    kept = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    flat = F.map_filter(
        F.coalesce(extra, F.create_map().cast("map<string,string>")),
        lambda k, v: v.isNotNull() & ~F.lower(v).isin("nan", "inf", "-inf", "infinity", "-infinity") & ~F.map_contains_key(kept, k) & ~v.rlike(r"^\s*[\[{]"),
    )
    return F.map_concat(kept, flat)


def chunk_metadata(document: Column, page: Column, char_count: Column, size: int, overlap: int) -> Column:
    """A chunk's metadata: the document's, then what its page adds (but no char_count), then its own."""
    none = F.create_map().cast("map<string,string>")
    own = F.create_map(
        F.lit("char_count"), char_count.cast("string"), F.lit("chunk_size"), F.lit(str(size)), F.lit("chunk_overlap"), F.lit(str(overlap))
    )
    base = F.coalesce(document, none)
    added = F.map_filter(F.coalesce(page, none), lambda k, v: ~F.map_contains_key(base, k) & (k != "char_count"))
    return F.map_concat(F.map_filter(F.map_concat(base, added), lambda k, v: ~F.map_contains_key(own, k)), own)
