"""Counters over a stream of links: the one streaming extension, on the same schema as the batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def link_stream(spark: SparkSession, path: str) -> DataFrame:
    """Links with an event time ``seen_at``, as parquet files arrive."""
    from archweave.schema import LINKS

    return spark.readStream.schema(LINKS + ", seen_at timestamp").parquet(path)


def link_counts(links: DataFrame, *, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Links per graph, type and window; state older than the watermark is dropped. Works on batch and stream alike."""
    timed = links.withWatermark("seen_at", late) if links.isStreaming else links
    return timed.groupBy(F.window("seen_at", window).alias("w"), "graph_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")).select("graph_id", "type", F.col("w.start").alias("start"), "n")
