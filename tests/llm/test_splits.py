import random

import pytest

from ledgerlens.llm import splits as S
from ledgerlens.llm.components import components


def brute(edges):
    comp = {}
    for a, b in edges:
        comp.setdefault(a, {a}), comp.setdefault(b, {b})
        if comp[a] is not comp[b]:
            both = comp[a] | comp[b]
            for x in both:
                comp[x] = both
    return {frozenset(c) for c in comp.values()}


@pytest.mark.parametrize("seed,nodes,n,small", [(1, 60, 45, 10_000), (2, 40, 60, 3), (3, 200, 150, 5)])
def test_components_against_brute_force(spark, seed, nodes, n, small):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(n)] + [("hub", f"h{k}") for k in range(30)] + [("x", "x")]
    got = components(spark, spark.createDataFrame(edges + [(None, "a")], "a string, b string"), small=small).collect()
    by = {}
    for r_ in got:
        by.setdefault(r_["comp"], set()).add(r_["node"])
    assert {frozenset(c) for c in by.values()} == brute(edges)
    assert len(got) == len({r_["node"] for r_ in got})


CASES = [
    ("mar_00000001", "marlow_0000001"), ("mar_00000002", "./MARLOW_0000001/"), ("MAR-00000002-1", "other"), ("oth_00000009", " Other "),
    ("rot1_gin_00000003", None), ("gin00000003r2", None), ("gin_00000004", None), ("copy1-of-kes_00000007", "far/lone 1"), ("kes_00000007", None),
    ("odd", "x__y"), ("odd2", "x-y"), ("odd3", None), (None, "x y"), ("mar_00000001", "marlow_0000001"), ("blank_1", " / "),
]


def test_groups_of_cases(spark):
    df = spark.createDataFrame([(*c, 1) for c in CASES], "case_id string, source string, members int")
    got = {r["case_id"]: (r["group_id"], r["members"]) for r in S.case_groups(spark, df.select("case_id", "source")).collect()}
    first = {"mar_00000001", "mar_00000002", "MAR-00000002-1", "oth_00000009"}
    assert {k for k, v in got.items() if v == ("MAR-00000002-1", 4)} == first
    assert got["rot1_gin_00000003"] == got["gin00000003r2"] == ("gin00000003r2", 2)
    assert got["copy1-of-kes_00000007"] == got["kes_00000007"] == ("copy1-of-kes_00000007", 2)
    assert got["odd"] == got["odd2"] == ("odd", 2)
    assert got["odd3"] == ("odd3", 1) and got["blank_1"] == ("blank_1", 1) and got["gin_00000004"] == ("gin_00000004", 1)
    assert None not in got
    assert S.case_groups(spark, df.limit(0).select("case_id", "source")).count() == 0


def test_assignment_keeps_proportions(spark):
    sizes = spark.createDataFrame([(f"g{k}", 1 + k % 4) for k in range(4000)] + [("huge", 2500)], "group_id string, members bigint")
    groups, ranges = S.assign(sizes)
    assert groups["huge"] == "train"
    total = {"train": 0, "validation": 0, "test": 0}
    from pyspark.sql import functions as F

    for r in sizes.withColumn("r", F.pmod(F.xxhash64("group_id"), F.lit(S.RANGES)).cast("int")).collect():
        total[groups.get(r["group_id"]) or ranges[r["r"]]] += r["members"]
    n = sum(total.values())
    assert all(abs(total[k] / n - v) < 0.002 for k, v in S.SHARES.items())


def test_chains_and_large_hubs(spark, monkeypatch):
    """A chain of many steps, and a hub with 10 ** 6 leaves of which some lie in a second ring: hot keys are cut into pieces."""
    from pyspark.sql import functions as F

    chain = spark.range(200).select(F.format_string("c%04d", "id").alias("a"), F.format_string("c%04d", F.col("id") + 1).alias("b"))
    hub = spark.range(1_000_000).select(F.lit("hub").alias("a"), F.format_string("h%07d", "id").alias("b"))
    ring = spark.range(20_000).select(F.format_string("h%07d", "id").alias("a"), F.format_string("h%07d", F.col("id") + 20_000).alias("b"))
    got = components(spark, chain.union(hub).union(ring), small=50).cache()
    sizes = got.groupBy("comp").count().collect()
    assert sorted(r["count"] for r in sizes) == [201, 1_000_001]
    got.unpersist()


def test_join_with_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerlens.plans import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    rows = spark.range(4_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    values = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key <> 'k3'")
    for how in ("inner", "left"):
        plain = rows.join(values, "key", how).select("id", "key", "n", "top")
        got = runtime.with_value(rows, values, "key", "n", how).select("id", "key", "n", "top")
        assert got.count() == plain.count() and got.exceptAll(plain).count() == 0
