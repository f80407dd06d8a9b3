import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import packing, tokens
from ledgerlens.llm import percentiles as Q
from ledgerlens.plans.runtime import Stages

FILE = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@needs_file
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    r = random.Random(3)
    pool = ["def f(x):\n", "    return x\r\n", "<|endoftext|>", "  ", "\t", "été ", "日本語", "é", " ", " ", "\x1c", "\x85", "123", "'s", "'S", "_", "aaaa", "\n\n", " \n", "🙂", "﻿", "the ", "Zürich"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(300)] + ["", None, "a" * 30_000, " " * 5_000 + "x", "ab" * 9_000, "=" * 20_001, "\n" * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "text as ids")
    got = {x["doc_id"]: x["ids"] for x in tokens.encode_documents(df).collect()}
    assert all(got[k] == (t.encode(x, add_special_tokens=False).ids if x else []) for k, x in enumerate(texts))
    assert {x["doc_id"]: x["tokens"] for x in tokens.document_sizes(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode_documents(df.limit(0)).count() == 0


@needs_file
def test_backtracking_equals_plain_merging():
    bpe = tokens.ByteBPE(FILE)
    r = random.Random(1)

    def merge(word):
        ids = [next(i for i, w in bpe.word.items() if w == c) for c in word]
        while True:
            ranked = [(bpe.rank[bpe.joined[p]], k) for k, p in enumerate(zip(ids, ids[1:])) if p in bpe.joined]
            if not ranked:
                return ids
            _, k = min(ranked)
            ids[k : k + 2] = [bpe.joined[ids[k], ids[k + 1]]]

    for _ in range(400):
        w = "".join(r.choices("aeinorst lhd", k=r.randint(1, 14)))
        assert bpe.encode(w) == merge(w)


def test_best_fit_and_query(spark):
    r = random.Random(4)
    sizes = [(k, r.choice([0, 5, 90, 300, 511, 512, 513, 1500])) for k in range(900)] + [(900, None), (0, 7)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    packs = spark.createDataFrame([("s", 512), ("m", 2048), ("s", 600), (None, 5), ("z", 0)], "pack_name string, capacity_tokens int")
    rows = packing.pack(spark, df, packs, limit=16, lane_tokens=100_000).collect()
    fill, parts = defaultdict(int), defaultdict(list)
    for x in rows:
        fill[x["pack_name"], x["lane"], x["bin_no"]] += x["tokens"]
        parts[x["pack_name"], x["doc_id"]].append(x)
    cap = {"s": 512, "m": 2048}
    assert {k[0] for k in fill} == set(cap) and all(v <= cap[k[0]] for k, v in fill.items())
    for name, c in cap.items():
        total = sum(s or 0 for _, s in sizes)
        assert sum(v for k, v in fill.items() if k[0] == name) == total
        assert len([k for k in fill if k[0] == name]) <= 1.12 * math.ceil(total / c)
        for k, s in sizes[1:900]:
            assert len(parts[name, k]) == max(1, -(-s // c)) and sum(p["tokens"] for p in parts[name, k]) == s
    assert packing.pack(spark, df.limit(0), packs).count() == 0 and packing.pack(spark, df, packs.limit(0)).count() == 0


def test_fullest_closes_first():
    f = packing.BestFit(10, limit=2)
    assert [f.put(6), f.put(7), f.put(8)] == [0, 1, 2]
    assert f.put(4) == 0 and f.put(2) == 2  # bin 1 was the fullest when the third one opened


def test_bits_sort_like_doubles(spark):
    r = random.Random(2)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.0**-1022, 1e308, -1e308, 0.1, 3.0, 1023.999, 2.0**53 - 1] + [r.uniform(-1, 1) * 10.0 ** r.randint(-300, 300) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Q.ordered_bits(Q.F.col("x")).alias("b"))
    rows = df.withColumn("back", Q.value_of(Q.F.col("b"), 0)).collect()
    assert all(x["back"] == x["x"] for x in rows)
    want = lambda v: int(np.float64(abs(v)).view(np.int64)) * (-1 if v < 0 else 1)
    assert all(x["b"] == want(x["x"]) for x in rows)


def test_percentiles_against_sorting(spark):
    r = random.Random(6)
    data = [(r.choice(["a", "b", None]), float(r.randint(1, 1_000_000))) for _ in range(3000)] + [("c", 5.0), ("d", None), ("e", float("nan")), ("f", -2.5), ("f", -1.5), ("f", 7e9 + 0.123)]
    df = spark.createDataFrame([(*x, 1) for x in data], "k string, v double, n int")
    ranks = (0.0, 0.01, 0.5, 0.9, 1.0)
    got = {(x["k"], x["p"]): (x["value"], x["n"]) for x in Q.percentiles(df.select("k", "v"), ["k"], "v", ranks).collect()}
    by = defaultdict(list)
    for k, v in data:
        if v is not None and v == v:
            by[k].append(v)
    assert {k for k, _ in got} == set(by)
    for k, vs in by.items():
        vs.sort()
        for p in ranks:
            exact = vs[max(1, math.ceil(round(p * len(vs), 6))) - 1]
            assert got[k, p] == (exact, len(vs))
    assert Q.percentiles(df.limit(0), ["k"], "v").count() == 0
    # Sketches of two halves, added up, give what the whole gives.
    half = Q.F.pmod(Q.F.monotonically_increasing_id(), Q.F.lit(2))
    parts = df.withColumn("h", half)
    both = Q.digits(parts.where("h = 0"), ["k"], "v").union(Q.digits(parts.where("h = 1"), ["k"], "v"))
    again = {(x["k"], x["p"]): x for x in Q.select_ranks(both, ["k"], ranks, Stages(spark)).collect()}
    assert set(again) == set(got)
    for key, x in again.items():
        exact, n = got[key]
        assert x["n"] == n and 0 <= abs(exact) - abs(x["value"]) < max(x["error"], 1e-300) and x["error"] <= 2**-20 * abs(exact) and (exact != int(exact) or abs(exact) > 2**20 or exact == x["value"])


def test_levels_add_up(spark):
    r = random.Random(3)
    data = [(r.choice("ab"), r.choice([1, 2, None]), r.choice([r.random(), float(r.randint(-5, 5))])) for _ in range(800)]
    df = spark.createDataFrame(data, "k string, d int, v double")
    stages = Stages(spark)
    levels = (("k", "d"), ("k",), ())
    got = {(x["level"], x["k"], x["d"], x["p"]): x["value"] for x in Q.radix_select(stages.cut(Q.values_of(df, ["k", "d"], "v")), ["k", "d"], (0.5, 0.9), stages, levels).collect()}
    by = defaultdict(list)
    for k, d, v in data:
        for key in ((0, k, d), (1, k, None), (2, None, None)):
            by[key].append(v)
    want = {(*key, p): sorted(vs)[max(1, math.ceil(round(p * len(vs), 6))) - 1] for key, vs in by.items() for p in (0.5, 0.9)}
    assert got == want
