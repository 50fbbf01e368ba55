"""Streaming ingestion: micro-batches become runs, and a run commits once.

The batch id names the run, so a batch that is replayed after a failure finds its receipt.  Late data is never dropped:
it takes its place in the fold by capture time.  No watermark is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.plans.engine import ingest
from tessera.sources import folder, snapshots
from tessera.sources.store import Store


def ingest_folder(store: Store, root: str, namespace: str, source: str, checkpoint: str, name: str = "folder") -> StreamingQuery:
    """Start a query that ingests new envelopes below ``root`` and stops when all present files are taken."""

    def batch(files: DataFrame, batch_id: int) -> None:
        good = folder.envelopes(files).where("problem is null")
        ingest(store, snapshots.usable_keys(folder.entities(good, namespace, source)), f"{name}-{batch_id}")

    return folder.stream(store.spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heads(events: DataFrame, chain: str, at: str, content: list[str]) -> DataFrame:
    """The running head of each chain of a stream: its newest content, number of observations and last capture.

    An observation older than the head changes nothing but the count.
    """
    return events.groupBy(chain).agg(F.max_by(F.struct(*content), F.struct(at, *content)).alias("head"), F.count(F.lit(1)).alias("observations"), F.max(at).alias("last_seen_at")).select(chain, "head.*", "observations", "last_seen_at")
