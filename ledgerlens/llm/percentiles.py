"""Problem 6: percentiles of very large numeric columns by radix selection."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.plans.runtime import Stages, first_delivery, is_small, table

#: Bits of the two digits that are followed. The first 32 bits of a double are its sign, its exponent and 20 bits of its
#: fraction: whole numbers up to 2 ** 20 come out exactly, all others with a relative error of at most 2 ** -20.
DIGIT_BITS = 16
RANKS = (0.5, 0.9, 0.95, 0.99)


def ordered_bits(x: Column) -> Column:
    """A double as the integer of 64 bits that sorts, signed, as the double does; infinite counts as the largest finite."""
    # No built-in function gives the bits of a double, so they are made from exponent and fraction, which is exact.
    size = F.least(F.abs(x), F.lit(sys.float_info.max))
    tiny = size < F.lit(sys.float_info.min)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.when(tiny, F.lit(-1022)).otherwise(F.floor(F.log2(size)).cast("int"))
    scaled = size / power(guess)
    exponent = guess + F.when(tiny, 0).when(scaled < 1, -1).when(scaled >= 2, 1).otherwise(0)
    fraction = (size / power(exponent) - F.when(tiny, 0.0).otherwise(1.0)) * F.lit(2.0**52)
    bits = F.when(tiny, F.lit(0).cast("bigint")).otherwise((exponent + 1023).cast("bigint")) * F.lit(1 << 52) + fraction.cast("bigint")
    return F.when(x < 0, -bits).otherwise(bits)


def value_of(prefix: Column, dropped: int) -> Column:
    """The double of an ordered integer whose last ``dropped`` bits are zeros; the inverse of ``ordered_bits``."""
    bits = F.abs(F.shiftleft(prefix, dropped))
    exponent = F.shiftright(bits, 52)
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(2.0**52)
    size = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise((fraction + 1) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(prefix < 0, -size).otherwise(size)


def digits(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys..., d1, d2, n``: how many values of a group have each pair of digits.

    This is the sketch: those of days, files or partitions are combined by adding ``n`` of equal digits, and read by
    ``select_ranks``. Null and NaN are left out. Values are counted before the shuffle, so a group with a third of all
    rows sends one row for each pair of digits and task.
    """
    x = F.col(value).cast("double")
    bits = rows.where(x.isNotNull() & ~F.isnan(x)).select(*keys, F.shiftright(ordered_bits(x), 64 - 2 * DIGIT_BITS).alias("_b"))
    d1 = F.shiftright("_b", DIGIT_BITS).cast("int").alias("d1")
    d2 = F.col("_b").bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int").alias("d2")
    return bits.groupBy(*keys, d1, d2).agg(F.count("*").alias("n"))


def follow(counts: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """Of each rank, the digit that holds it, and the rank among the values of that digit.

    ``counts`` has keys, ``digit``, ``n``; ``ranks`` has keys, ``p`` and ``rank`` (from 1). A group has at most
    2 ** DIGIT_BITS digits, so the running sum never holds an unbounded group.
    """
    running = W.partitionBy(*keys).orderBy("digit").rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(running))
    return (
        same(upto, ranks, keys)
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select(*keys, "p", "digit", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, null equal to null."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"_{k}" for k in keys])


def select_ranks(counts: DataFrame, keys: list[str], ranks: tuple[float, ...], stages: Stages) -> DataFrame:
    """``keys..., p, value, n, error`` from the sketch ``counts``, which may have finer keys than ``keys``.

    ``value`` is the lower border of a pair of digits; the true one is farther from zero by less than ``error``: 2 ** -20 of the power of
    two below it, and 0 for whole numbers up to 2 ** 20.

    The first digit is histogrammed for each group; of the second one only the digits under a first digit that holds a
    rank are, so the other counts are dropped before they are added up.
    """
    first = stages.cut(counts.groupBy(*keys, "d1").agg(F.sum("n").alias("n")).withColumnRenamed("d1", "digit"))
    totals = stages.cut(first.groupBy(*keys).agg(F.sum("n").alias("n")))
    wanted = totals.withColumn("p", F.explode(F.array(*map(F.lit, ranks)))).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 6))).cast("bigint")
    )
    held = stages.cut(follow(first, keys, wanted.drop("n")).withColumnRenamed("digit", "d1"))
    below = same(counts, held.select(*keys, "d1").distinct(), [*keys, "d1"])
    second = below.groupBy(*keys, "d1", F.col("d2").alias("digit")).agg(F.sum("n").alias("n"))
    last = follow(second, [*keys, "d1"], held)
    prefix = F.shiftleft(F.col("d1").cast("bigint"), DIGIT_BITS) + F.col("digit")
    value = value_of(prefix, 64 - 2 * DIGIT_BITS)
    return same(last.select(*keys, "p", value.alias("value"), F.abs(value_of(prefix + F.when(prefix < 0, -1).otherwise(1), 64 - 2 * DIGIT_BITS) - value).alias("error")), totals, keys)


def radix_select(values: DataFrame, keys: list[str], ranks: tuple[float, ...], stages: Stages, levels: tuple[tuple[str, ...], ...] | None = None) -> DataFrame:
    """``level INT, keys..., p, value, n``: exact percentiles, digit by digit; ``values`` is a staged table of ``keys`` and ``_b``, ordered bits.

    The first digit of all values is histogrammed. Each later digit is histogrammed only under the digits so far that hold
    a rank of some group: all other values are dropped before they are counted. Counts are made for the finest groups and
    added up for each of ``levels``, which are lists of some of the keys (all keys if none are given); keys that a level
    has not are null. A group has at most 2 ** DIGIT_BITS digits in a round.
    """
    levels = levels or (tuple(keys),)
    types = {f.name: f.dataType for f in values.schema.fields}
    groups = F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in level else F.lit(None).cast(types[c])).alias(c) for c in keys]) for k, level in enumerate(levels)])
    all_keys = ["level", *keys]
    held, totals = None, None
    for k in range(64 // DIGIT_BITS):
        shift = 64 - DIGIT_BITS * (k + 1)
        prefix = F.shiftright("_b", shift + DIGIT_BITS) if k else F.lit(0).cast("bigint")
        digit = F.shiftright("_b", shift) if k == 0 else F.shiftright("_b", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        rows = values.select(*keys, prefix.alias("prefix"), digit.cast("int").alias("digit"))
        if held is not None:
            some = held.select("prefix").distinct()
            rows = rows.join(F.broadcast(some) if is_small(some) else some, "prefix", "left_semi")
        finest = rows.groupBy(*keys, "prefix", "digit").agg(F.count("*").alias("n"))
        counts = finest.select(F.explode(groups).alias("g"), "prefix", "digit", "n").select("g.*", "prefix", "digit", "n")
        if held is not None:
            # What holds no rank of its group goes before the counts are added up.
            some = held.select(*all_keys, "prefix").distinct()
            counts = same(counts, F.broadcast(some) if is_small(some) else some, [*all_keys, "prefix"])
        counts = stages.cut(counts.groupBy(*all_keys, "prefix", "digit").agg(F.sum("n").alias("n")))
        if held is None:
            totals = stages.cut(counts.groupBy(*all_keys).agg(F.sum("n").alias("n")))
            held = totals.select(*all_keys, F.lit(0).cast("bigint").alias("prefix"), F.explode(F.array(*map(F.lit, ranks))).alias("p"), "n").select(
                *all_keys, "prefix", "p", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 6))).cast("bigint").alias("rank")
            )
        last = follow(counts, [*all_keys, "prefix"], held)
        longer = F.col("digit").cast("bigint") if k == 0 else F.shiftleft("prefix", DIGIT_BITS) + F.col("digit")
        held = stages.cut(last.select(*all_keys, longer.alias("prefix"), "p", "rank"), counts)
    return same(held.select(*all_keys, "p", value_of(F.col("prefix"), 0).alias("value")), totals, all_keys)


def values_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys..., _b``: the ordered bits of all values; null and NaN are left out."""
    x = F.col(value).cast("double")
    return rows.where(x.isNotNull() & ~F.isnan(x)).select(*keys, ordered_bits(x).alias("_b"))


def percentiles(rows: DataFrame, keys: list[str], value: str, ranks: tuple[float, ...] = RANKS, stages: Stages | None = None) -> DataFrame:
    """``keys..., p, value, n``: the ``ceil(p * n)``-th smallest value of each group (the smallest for p = 0), exactly.

    Null keys are a group of their own; groups without values do not come out; ties are counted as often as they
    come; infinite values count as the largest finite one; an empty table gives an empty result; other columns do not matter.
    Results of days or files are combined by the sketch of ``digits``, whose error ``select_ranks`` states.
    """
    stages = stages or Stages(rows.sparkSession)
    return radix_select(stages.cut(values_of(rows, keys, value)), keys, ranks, stages).drop("level")


def measurements(responses: DataFrame, stages: Stages) -> DataFrame:
    """``(model, day, metric, value)`` of each response once; null, 0 and -1 are lost and left out, time-outs stay.

    The day is that of ``logged_at`` in UTC. Of a response that came several times the first delivery holds.
    """
    plain = responses.select("response_id", "received_at", "model", F.to_date("logged_at").alias("day"), "latency_ms", "output_tokens")
    once = first_delivery(plain, "response_id", "received_at", ["model", "day", "latency_ms", "output_tokens"], stages)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("latency_ms", "output_tokens")])
    return once.select("model", "day", F.inline(pairs)).where("value > 0")


LEVELS = (("model", "day", "metric"), ("model", "metric"), ("day", "metric"), ("metric",))


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of ``latency_ms`` and ``output_tokens`` by model and day, by model, by day and of all, exactly.

    ``level`` names the grouping (a null model is a group too, so null alone would not tell); the wider levels
    combine the counts of the finest one.
    """
    stages = Stages(spark)
    keys = ["model", "day", "metric"]
    values = stages.cut(values_of(measurements(table(spark, folder, "llm_responses"), stages), keys, "value"))
    found = radix_select(values, keys, RANKS, stages, LEVELS)
    at = {p: F.max(F.when(F.col("p") == p, F.col("value"))).cast("bigint").alias(f"p{round(p * 100)}") for p in RANKS}
    wide = found.groupBy("level", *keys).agg(F.max("n").alias("n"), *at.values())
    names = F.array(*[F.lit("_".join(x for x in level if x != "metric") or "all") for level in LEVELS])
    return wide.withColumn("level", F.get(names, F.col("level")))
