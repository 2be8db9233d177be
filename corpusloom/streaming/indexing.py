"""Incremental indexing: each micro-batch of documents replaces its documents in the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.store import ChunkStore


def index_stream(pages: DataFrame, store_path: str, checkpoint: str, size: int = 1000, overlap: int = 200, one_page: bool = True) -> StreamingQuery:
    """Chunk a stream of pages into the store. A batch that is run again replaces the same documents with the same chunks."""

    def batch(rows: DataFrame, _: int) -> None:
        chunks = chunk_documents(rows, size, overlap, one_page)
        if not chunks.isEmpty():
            ChunkStore(rows.sparkSession, store_path).index(chunks)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
