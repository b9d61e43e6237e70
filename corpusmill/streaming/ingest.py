"""Continuous ingest: a stream of pages is extracted, cut, embedded and upserted per micro-batch.

All steps are stateless maps. A batch takes the place of its pages' stored chunks, so a page that comes again with other text keeps no
chunk of the old one. The store's manifest records the number of the batch in the same step that publishes its rows, so a batch
that is replayed after a failure between publishing and the stream's checkpoint publishes nothing and embeds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.chunking import chunks
from corpusmill.operators.embed import EmbeddingProvider, embed
from corpusmill.plans.pipeline import extract_pages
from corpusmill.schema import ChunkConfig
from corpusmill.session import bounded_batches, discard, saved
from corpusmill.sources.store import VectorStore
from corpusmill.streaming.progress import StreamProgress


def to_vectors(pages: DataFrame, provider: EmbeddingProvider, chunk: ChunkConfig, min_chars: int = 100) -> DataFrame:
    """Rows for the store from pages (url, title, html)."""
    good = extract_pages(pages, min_chars).where("long_enough")
    return chunks(good, chunk).withColumn("embedding", embed(F.col("content"), provider, kind="float"))


def ingest(stream: DataFrame, store: VectorStore, provider: EmbeddingProvider, checkpoint: str, chunk: ChunkConfig | None = None, available_now: bool = True, progress: StreamProgress | None = None) -> StreamingQuery:
    """Start the query. stream: pages with url and html (title is read from the html where absent). Of pages with one url in a batch one is kept, the greatest by title and html."""
    store.initialize()
    bounded_batches(stream.sparkSession)  # a query's batches have the settings that its session had at the start
    cfg = chunk or ChunkConfig(800, 150)
    ledger = f"stream {checkpoint}"

    def take(batch: DataFrame, batch_id: int) -> None:
        if store.applied(ledger) >= batch_id:
            return
        names = [c for c in ("url", "title", "html") if c in batch.columns]
        # Written once, as rows and keys are read from it: reading the batch twice would read its source twice.
        pages = saved(batch.groupBy("url").agg(F.max(F.struct(*[c for c in names if c != "url"])).alias("p")).select("url", "p.*"), "stream-batch")
        store.replace(to_vectors(pages, provider, cfg), pages.select("url"), batch=(ledger, batch_id))
        discard(pages)

    if progress:
        progress.attach(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
