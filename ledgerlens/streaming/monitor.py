"""The same transforms on a stream, and signals over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_of(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(df: DataFrame, time: str, *keys: str, width: str = "1 hour", late: str = "1 day", **signals) -> DataFrame:
    """Signals in windows of event time, for a batch or a stream alike; a stream drops what is later than ``late``."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    agg = source.groupBy(F.window(time, width), *keys).agg(*[c.alias(k) for k, c in signals.items()])
    return agg.select(F.col("window.start").alias("window_start"), *keys, *signals)


def signals() -> dict[str, Column]:
    """The signals of a running pipeline, over ``verdict, used, latency_ms, rules ARRAY<STRUCT<id, status>>, least_confidence``: aggregates for a batch or a stream.

    Shares of reviews, of fallbacks and of documents with a field that is not proven by the text; the share of each failed rule
    is ``rule_shares``; the 95th percentile of the latency is an approximate one, since exact ones have no place in a stream.
    """
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 9)
    return {
        "documents": F.count("*"), "review_rate": share(F.col("verdict") == "REVIEW"), "fallback_rate": share(F.endswith("used", F.lit("fallback"))),
        "ungrounded_rate": share((F.col("least_confidence") > 0) & (F.col("least_confidence") < 0.6)), "p95_ms": F.percentile_approx("latency_ms", 0.95, 10_000),
    }


def rule_shares(df: DataFrame, *keys: str) -> DataFrame:
    """``keys..., rule, documents, failed, fail_rate``."""
    each = df.select(*keys, F.inline("rules"))
    failed = F.count_if(F.col("status") == "FAIL")
    return each.groupBy(*keys, F.col("id").alias("rule")).agg(F.count("*").alias("documents"), failed.alias("failed"), F.round(failed / F.count("*"), 9).alias("fail_rate"))


def weekly_sample(df: DataFrame, time: str, key: str, share: float, verdict: str = "verdict", value: str = "PASS", seed: int = 0) -> DataFrame:
    """About ``share`` of the documents that passed, of each week alike, to be looked at by people; by a seeded hash, so the same on every run and in a stream."""
    passed = df.where(F.col(verdict) == value).withColumn("week", F.date_trunc("week", time))
    return passed.where(F.pmod(F.xxhash64(F.lit(seed), F.col("week"), F.col(key)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def run(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes a stream to Parquet, all that is there and then ends; each batch is written once, also after a restart."""
    out = transform(df) if transform else df
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
