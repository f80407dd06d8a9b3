"""Problem 1: splits that keep related cases together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.plans.runtime import Stages, table, with_value

#: Groups with more than 1/LARGE of all cases are placed one by one; there are at most LARGE of them.
LARGE = 10_000
#: All other groups are placed by ranges of their hash.
RANGES = 1 << 16
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def source_key(source: Column) -> Column:
    """One form of a source: the last folder of the path, lower case, without separators; null if nothing is left."""
    last = F.regexp_extract(F.lower(source), r"([^/\\]*[^/\\\s][^/\\]*)[/\\\s]*$", 1)
    return F.nullif(F.regexp_replace(last, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def original_key(case_id: Column, prefixes: Column) -> Column:
    """Prefix and number of the original in an id, or null.

    The number is a run of exactly eight digits. The prefix is the last run of exactly three letters before it that is a
    prefix of some plain id of the table (``prefixes``), else the last such run.
    """
    lower = F.lower(case_id)
    number = F.regexp_extract(lower, r"(?<!\d)(\d{8})(?!\d)", 1)
    head = F.regexp_extract(lower, r"^(.*?)(?<!\d)\d{8}(?!\d)", 1)
    runs = F.regexp_extract_all(head, F.lit(r"(?<![a-z])([a-z]{3})(?![a-z])"), F.lit(1))
    known = F.filter(runs, lambda x: F.array_contains(prefixes, x))
    prefix = F.coalesce(F.try_element_at(known, F.lit(-1)), F.try_element_at(runs, F.lit(-1)))
    return F.when((number != "") & prefix.isNotNull(), F.concat_ws("_", prefix, number))


def case_groups(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """``(case_id, group_id)`` of every case; ``group_id`` is the least ``case_id`` of its group.

    Null ids are dropped. Rows delivered again, and rows of one id with several sources, count once with all their
    sources. A case without source and original is a group of its own. An empty table gives an empty result.
    """
    stages = Stages(spark)
    plain = F.regexp_extract("case_id", r"^([a-z]{3})_\d{8}$", 1)
    # At most 26 ** 3 prefixes exist.
    prefixes = cases.select(plain.alias("p")).where("p <> ''").groupBy().agg(F.collect_set("p").alias("prefixes"))
    keyed = stages.cut(
        cases.where("case_id is not null")
        .select("case_id", source_key(F.col("source")).alias("s"))
        .distinct()
        .crossJoin(F.broadcast(prefixes))  # one row
        .select("case_id", F.concat(F.lit("s:"), "s").alias("s"), F.concat(F.lit("o:"), original_key(F.col("case_id"), F.col("prefixes"))).alias("o"))
    )
    own = F.concat(F.lit("c:"), "case_id")
    # Cases are collapsed to the distinct pairs of their keys before the search: a source with a third of all cases is
    # one node. An id delivered with several sources ties them by its original, or by itself if it has none.
    tie = F.coalesce("o", own)
    comps = components(spark, keyed.where("s is not null").select(F.col("s").alias("a"), tie.alias("b")), stages)
    key = F.coalesce("o", own)
    named = stages.cut(
        keyed.select("case_id", key.alias("node")).distinct()
        .join(comps, "node", "left")
        .select("case_id", F.coalesce("comp", "node").alias("comp"))
    )
    # A case with neither partner in the graph keeps its own key; the least id of a group is a map-side combined minimum.
    least = named.groupBy("comp").agg(F.min("case_id").alias("group_id"), F.count("*").alias("members"))
    return with_value(named, stages.cut(least), "comp", "members").select("case_id", "group_id", "members")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every case that must stay together with another one."""
    groups = case_groups(spark, table(spark, folder, "cases").select("case_id", "source"))
    return groups.where("members > 1").select("case_id", "group_id")


def assign(sizes: DataFrame, shares: dict[str, float] = SHARES) -> tuple[dict[str, str], dict[int, str]]:
    """Splits of the large groups and of the hash ranges, from ``sizes (group_id, members)``.

    The large groups, largest first, go where most is missing. The ranges follow in hash order and fill the splits
    one after another; a range goes to the next split once less than half of it is still missing.
    """
    total = sizes.agg(F.sum("members")).first()[0] or 0
    big = sizes.where(F.col("members") * LARGE > total).orderBy(F.desc("members"), "group_id").collect()
    ranges = (
        sizes.where(F.col("members") * LARGE <= total)
        .groupBy(F.pmod(F.xxhash64("group_id"), F.lit(RANGES)).cast("int").alias("r"))
        .agg(F.sum("members").alias("n"))
        .orderBy("r")
        .collect()
    )
    missing = {k: v * total for k, v in shares.items()}
    groups, by_range = {}, {}
    for row in big:
        to = max(missing, key=lambda k: (missing[k], k))
        groups[row["group_id"]] = to
        missing[to] -= row["members"]
    order = list(shares)
    for row in ranges:
        while len(order) > 1 and missing[order[0]] < row["n"] / 2:
            order.pop(0)
        by_range[row["r"]] = order[0]
        missing[order[0]] -= row["n"]
    return groups, by_range


def p1_split(spark: SparkSession, folder: str) -> DataFrame:
    """``(case_id, group_id, new_split)``: 80 : 10 : 10 of the cases as nearly as whole groups allow."""
    stages = Stages(spark)
    groups = stages.cut(case_groups(spark, table(spark, folder, "cases").select("case_id", "source")))
    sizes = groups.groupBy("group_id").agg(F.first("members").alias("members"))
    big, ranges = assign(sizes)
    large = spark.createDataFrame([*big.items()], "group_id string, own string")
    hashed = spark.createDataFrame([*ranges.items()], "r int, common string")
    return (
        groups.withColumn("r", F.pmod(F.xxhash64("group_id"), F.lit(RANGES)).cast("int"))
        .join(F.broadcast(large), "group_id", "left")  # at most LARGE rows
        .join(F.broadcast(hashed), "r", "left")  # at most RANGES rows
        .select("case_id", "group_id", F.coalesce("own", "common").alias("new_split"))
    )


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """``(new_split, wanted, parted, near)``: of each split how many cases it should have, how many groups lie in it and in another one too
    (none), and whether its size is off by no more than the largest group that had a choice, those of up to a tenth of all cases."""
    stages = Stages(spark)
    split = stages.cut(p1_split(spark, folder))
    total = split.agg(F.count("*")).first()[0]
    groups = split.groupBy("group_id").agg(F.count_distinct("new_split").alias("splits"), F.count("*").alias("members"))
    parted, largest = groups.agg(F.count_if(F.col("splits") > 1), F.max(F.when(F.col("members") <= total / 10, F.col("members")))).first()
    want = spark.createDataFrame([(k, round(v * total, 6)) for k, v in SHARES.items()], "new_split string, wanted double")
    sizes = split.groupBy("new_split").agg(F.count("*").alias("n"))
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("wanted")) <= (largest or 0)
    return want.join(sizes, "new_split", "left").select("new_split", "wanted", F.lit(parted or 0).cast("bigint").alias("parted"), near.alias("near"))
