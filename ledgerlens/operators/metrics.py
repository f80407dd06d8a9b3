"""Agreement of predictions with labels, by grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.text import soft
from ledgerlens.functions.words import AMOUNT_FIELDS, FIELDS

STATUSES = ("PASS", "FAIL", "REVIEW")


def values_match(field: Column, predicted: Column, expected: Column) -> Column:
    """Both null, or equal: amounts as numbers (what is no number equals nothing), all else as soft text."""
    number = lambda c: c.try_cast("decimal(38,6)")
    equal = F.when(field.isin(*AMOUNT_FIELDS), number(predicted) == number(expected)).otherwise(soft(predicted) == soft(expected))
    return F.when(predicted.isNull() & expected.isNull(), True).when(predicted.isNull() | expected.isNull(), False).otherwise(F.coalesce(equal, F.lit(False)))


def by_field(df: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """One row for each field of each case: the other columns, ``field``, ``predicted``, ``expected`` and ``ok``."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{predicted}.{f}").cast("string").alias("p"), F.col(f"{expected}.{f}").cast("string").alias("e")) for f in FIELDS])
    rest = [c for c in df.columns if c not in (predicted, expected)]
    long = df.select(*rest, F.inline(rows))
    return long.select(*rest, "field", F.col("p").alias("predicted"), F.col("e").alias("expected"), values_match(F.col("field"), F.col("p"), F.col("e")).alias("ok"))


def field_stats(long: DataFrame, *keys: str) -> DataFrame:
    """Of each field: how many there are, how many agree, and the rate, precision and recall.

    The rate is 0 for no rows; precision and recall are null if nothing was predicted or expected.
    """
    stats = long.groupBy(*keys, "field").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("exact"), F.count_if(F.col("predicted").isNotNull()).alias("predicted"), F.count_if(F.col("expected").isNotNull()).alias("expected"),
        F.count_if(F.col("ok") & F.col("predicted").isNotNull()).alias("hits"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return stats.withColumns({"rate": F.coalesce(rate("exact", "total"), F.lit(0.0)), "precision": rate("hits", "predicted"), "recall": rate("hits", "expected")})


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Three rows and three columns of counts, zeros included."""
    base = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "expected string")
    counted = df.groupBy(F.col(expected).alias("expected")).pivot(predicted, list(STATUSES)).count()
    return base.join(counted, "expected", "left").na.fill(0)


def by_tag(df: DataFrame, tags: str, ok: Column) -> DataFrame:
    """Cases and agreements of each tag."""
    return df.select(F.explode(tags).alias("tag"), ok.alias("ok")).groupBy("tag").agg(F.count("*").alias("cases"), F.count_if("ok").alias("agreed"))


def roll_up(df: DataFrame, config: str, source: str, **aggregates: Column) -> DataFrame:
    """Each configuration as a whole and by source, in one pass; ``name`` is ``config/all`` or ``config/source``. Rows without a source count in the whole only."""
    named = [a.alias(k) for k, a in aggregates.items()]
    sets = df.groupingSets([[F.col(config)], [F.col(config), F.col(source)]], F.col(config), F.col(source)).agg(F.grouping(source).alias("_whole"), *named)
    kept = sets.where((F.col("_whole") == 1) | F.col(source).isNotNull())
    return kept.select(F.concat_ws("/", config, F.when(F.col("_whole") == 1, "all").otherwise(F.col(source))).alias("name"), *aggregates)


def calls(df: DataFrame, latency: str, *keys: str) -> DataFrame:
    """Calls (a latency was measured), their mean, and the 95th percentile by nearest rank.

    Equal latencies of a group are counted before they are sorted, so a group is as large as the number of its different latencies."""
    counted = df.groupBy(*keys, latency).agg(F.count("*").alias("n"))
    there = F.when(F.col(latency).isNotNull(), F.col("n")).otherwise(0)
    over = W.partitionBy(*keys)
    ranked = counted.withColumns({
        "_upto": F.sum(there).over(over.orderBy(F.col(latency).asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum(there).over(over),
    })
    rank = F.ceil(F.round(F.col("_all") * 0.95, 6))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("documents"), F.sum(there).alias("calls"), (F.sum(F.col(latency) * F.col("n")) / F.sum(F.when(there > 0, there))).alias("mean_ms"),
        F.min(F.when(F.col("_upto") >= rank, F.col(latency))).cast("double").alias("p95_ms"),
    )


def micro_rate(stats: DataFrame, *keys: str) -> DataFrame:
    """The exact rate over all fields together, from ``field_stats``."""
    return stats.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("exact").cast("double"), F.sum("total")), F.lit(0.0)).alias("field_exact_rate"))


def summary(results: DataFrame, *keys: str) -> DataFrame:
    """One row for each configuration: cases, agreement of the verdict, calls, fallbacks; ``results`` has ``expected, predicted, latency_ms, used``."""
    agreed = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    return results.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.avg(agreed.cast("double")).alias("verdict_agreement"), F.count("latency_ms").alias("llm_calls"),
        F.count_if(F.coalesce(is_fallback(F.col("used")), F.lit(False))).alias("fallbacks"),
    )


def comparison(results: DataFrame, stats: DataFrame, *keys: str) -> DataFrame:
    """The table that sets configurations side by side: ``summary``, the micro rate of the fields, and mean and 95th percentile of the calls; rates in percent."""
    times = calls(results, "latency_ms", *keys).select(*keys, F.round("mean_ms", 6).alias("mean_ms"), "p95_ms")
    joined = summary(results, *keys).join(micro_rate(stats, *keys), list(keys), "left").join(times, list(keys), "left")
    return joined.select(*keys, "cases", percent(F.col("field_exact_rate")).alias("fields"), percent(F.col("verdict_agreement")).alias("verdicts"), "llm_calls", "fallbacks", "mean_ms", "p95_ms")


def verdict_failures(results: DataFrame, case: str = "case_id") -> DataFrame:
    """One line for each case whose verdict is another one, as ``failures`` has them for fields."""
    show = lambda c: F.coalesce(F.col(c), F.lit("None"))
    wrong = results.where(~F.col("expected").eqNullSafe(F.col("predicted")))
    return wrong.select(case, F.lit("verdict").alias("field"), F.concat(F.lit("verdict: expected "), show("expected"), F.lit(", got "), show("predicted")).alias("message"))


def failures(long: DataFrame, case: str = "case_id") -> DataFrame:
    """One line for each field that does not agree."""
    show = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return long.where(~F.col("ok")).select(case, "field", F.concat(F.col("field"), F.lit(": expected "), show("expected"), F.lit(", got "), show("predicted")).alias("message"))


def gate(now: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """What is worse than the baseline, or has none: ``(name, metric, value, least)``. The gate holds if there is no row."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n.{m}").alias("value"), F.col(f"b.{m}").alias("least")) for m in metrics])
    joined = now.alias("n").join(baseline.withColumn("_there", F.lit(True)).alias("b"), "name", "left")
    return joined.select("name", F.inline(rows)).where(F.col("least").isNull() | (F.col("value") < F.col("least") - 1e-9))


def fallback_gate(now: DataFrame) -> DataFrame:
    """Configurations with fallbacks, as rows of ``gate``: only those whose name begins with ``heuristic@`` may have any."""
    bad = now.where((F.col("fallbacks") > 0) & ~F.startswith(F.col("name"), F.lit("heuristic@")))
    return bad.select("name", F.lit("fallbacks").alias("metric"), F.col("fallbacks").cast("double").alias("value"), F.lit(0.0).alias("least"))


def split_faults(cases: DataFrame, members: DataFrame, source: str = "source") -> DataFrame:
    """What is wrong with a split: ``(fault, name, n)``; none if it is sound.

    ``members`` has ``case_id`` and ``split``. No case may be in two splits, each case must be in one and each member a case, and the
    splits of a source may differ in size by one at most.
    """
    ids = members.select("case_id", "split").distinct()
    twice = ids.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("in two splits").alias("fault"), F.col("case_id").alias("name"), "n")
    none = cases.select("case_id").distinct().join(ids, "case_id", "left_anti").select(F.lit("in no split").alias("fault"), F.col("case_id").alias("name"), F.lit(0).cast("bigint").alias("n"))
    other = ids.join(cases.select("case_id").distinct(), "case_id", "left_anti").select(F.lit("no case").alias("fault"), F.col("case_id").alias("name"), F.lit(0).cast("bigint").alias("n"))
    sizes = ids.join(cases.select("case_id", source).distinct(), "case_id").groupBy(source, "split").agg(F.count("*").alias("size"))
    splits = ids.agg(F.count_distinct("split").alias("splits"))
    per = sizes.groupBy(source).agg(F.max("size").alias("most"), F.min("size").alias("fewest"), F.count("*").alias("found")).join(F.broadcast(splits))  # one row
    uneven = per.select(F.lit("uneven").alias("fault"), F.col(source).alias("name"), (F.col("most") - F.when(F.col("found") < F.col("splits"), 0).otherwise(F.col("fewest"))).alias("n")).where("n > 1")
    return twice.unionByName(none).unionByName(other).unionByName(uneven)


def percent(rate: Column) -> Column:
    """A rate as a whole percentage, half to even; n/a if it is null."""
    return F.when(rate.isNull(), "n/a").otherwise(F.concat(F.bround(rate * 100).cast("int").cast("string"), F.lit("%")))


def is_fallback(used: Column) -> Column:
    return F.endswith(used, F.lit("fallback"))
