"""Ingestion of a growing corpus folder, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusgraph.operators.keyed import Snapshots, insert_or_ignore
from corpusgraph.sources.ingest import source_versions


def ingest(spark: SparkSession, folder: str, schema: str, store: Snapshots, checkpoint: str) -> StreamingQuery:
    """Adds the source versions of new Parquet files to the store's table sources; a batch that runs twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        rows = source_versions(batch)
        table = store.read("sources") if "sources" in store.versions() else rows.limit(0)
        store.commit(sources=insert_or_ignore(table, rows, ["source_key", "content_hash"]))

    stream = spark.readStream.schema(schema).parquet(folder).where(F.col("text").isNotNull())
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
