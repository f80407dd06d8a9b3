"""Connected components by frontier breadth-first search over hash-partitioned adjacency lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.plans.runtime import Stages, is_small, with_value

#: Neighbours in one adjacency row. A hub has many rows, spread over all partitions.
BLOCK = 2_000
#: Pieces into which the labels that reach one node are hashed before they are compared.
SALTS = 1_024
#: One node in SEED_SHARE is a seed, and the seeds expand by STEPS steps; what they don't reach by then is a seed too. So
#: the number of steps does not depend on the width of the graph, and the label graph has about half of its nodes or less.
SEED_SHARE, STEPS = 4, 2
#: Pairs of the label graph that one task may merge; a larger label graph is itself solved by this search.
SMALL_GRAPH = 200_000


def _merge_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over at most SMALL_GRAPH pairs."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    if nodes:
        yield pd.DataFrame({"node": nodes, "comp": [find(x) for x in nodes]})


def components(
    spark: SparkSession, edges: DataFrame, stages: Stages | None = None, small: int = SMALL_GRAPH, depth: int = 0
) -> DataFrame:
    """``(node STRING, comp STRING)`` for every node of ``edges (a STRING, b STRING)``.

    ``comp`` is one node of the component. Pairs with a null are dropped; loops, repeated pairs and both directions of
    a pair are harmless; an empty input gives an empty result.

    Nodes with one neighbour (leaves) take the label of that neighbour in the end and are left out of the search; what is
    left is the core. Its adjacency lists are cut into blocks of BLOCK neighbours, hash-partitioned by (node, block), so that a
    hub with a third of all edges is spread like any other rows. All seeds expand at once; a node takes the least of the labels
    that reach it first, every other label that meets it goes into the label graph. Nodes that no seed reached in STEPS steps
    become seeds. The label graph is merged in one task if it has at most ``small`` pairs (SMALL_GRAPH), else by the same
    operator with other seeds.
    """
    stages = stages or Stages(spark)
    pairs = edges.where("a is not null and b is not null")
    one = stages.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = one.union(one.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    sized = stages.cut(both.groupBy("a").agg(F.count("*").alias("degree"), F.min("b").alias("anchor")))
    degree = lambda name: sized.select(F.col("a").alias(name), F.col("degree").alias(f"_{name}"))
    inner = with_value(both, degree("a"), "a", "_a").where("_a > 1").select("a", "b")
    core = with_value(inner, degree("b"), "b", "_b").where("_b > 1 and a <> b").select("a", "b")
    # A node without a neighbour in the core names its component itself, and its leaves after it.
    found = search(spark, stages.cut(core), stages, small, depth)
    own = sized.where("degree > 1").select(F.col("a").alias("node"), "degree").join(found, "node", "left")
    named = stages.cut(own.select("node", "degree", F.coalesce("comp", "node").alias("comp")))
    leaves = sized.where("degree = 1").select(F.col("a").alias("node"), F.col("anchor").alias("other"))
    anchors = named.select(F.col("node").alias("other"), "comp", "degree")
    # A pair of leaves has no inner node: its lesser end names it.
    hung = with_value(leaves, anchors, "other", "degree", "left").select("node", F.coalesce("comp", F.least("node", "other")).alias("comp"))
    return stages.cut(named.select("node", "comp").unionByName(hung), one, named)


def search(spark: SparkSession, both: DataFrame, stages: Stages, small: int, depth: int) -> DataFrame:
    """The breadth-first search itself, over distinct pairs in both directions; ``depth`` makes each search choose other seeds.

    ``both`` is a staged table, which is deleted."""
    nodes = stages.cut(both.groupBy(F.col("a").alias("node")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    if nodes.isEmpty():
        return nodes.select("node", F.col("node").alias("comp"))
    weighed = nodes.select(F.col("node").alias("a"), "blocks", (F.col("blocks") * BLOCK).alias("_n"))
    lists = stages.cut(
        with_value(both, weighed, "a", "_n")
        .groupBy(F.col("a").alias("node"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.collect_list("b").alias("nbrs")),
        both,
    )
    seeds = nodes.where(F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(SEED_SHARE)) == 0)
    label = lambda df: df.select("node", F.col("node").alias("label"), "blocks")
    frontier = stages.cut(label(seeds))
    visited, steps = [frontier], []
    for _ in range(STEPS):
        steps.append(stages.cut(expand(frontier, lists, nodes, visited)))
        frontier = steps[-1].where("not link and old is null").select("node", "label", "blocks")
        visited.append(frontier)
    # All that no seed reached are seeds now; each node expands once, so every pair is met from both of its ends.
    rest = stages.cut(label(nodes.join(union(visited), "node", "left_anti")))
    visited.append(rest)
    steps.append(stages.cut(expand(frontier.unionByName(rest), lists, nodes, visited), lists))
    met = union([s.where("link or old <> label").select(F.col("label").alias("a"), F.when(F.col("link"), F.col("node")).otherwise(F.col("old")).alias("b")) for s in steps])
    links = stages.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    every = stages.cut(union(visited).select("node", "label"), nodes, *steps, rest, visited[0])
    if is_small(links, small):
        merged = links.coalesce(1).mapInPandas(_merge_task, "node string, comp string")
    else:
        merged = components(spark, links, stages, small, depth + 1)
    merged = merged.select(F.col("node").alias("label"), "comp")
    reach = stages.cut(every.groupBy("label").agg(F.count("*").alias("n")).join(merged, "label", "left"))
    return with_value(every, reach, "label", "n").select("node", F.coalesce("comp", "label").alias("comp"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def expand(frontier: DataFrame, lists: DataFrame, nodes: DataFrame, visited: list[DataFrame]) -> DataFrame:
    """One step of all seeds: ``(node, label, old, blocks, link)`` with the least label that reaches each node and the one it has
    already; where ``link`` is set, two labels that met.

    The labels of a node are compared in SALTS pieces first and the least ones of the pieces then, so that a hub which
    many seeds reach is no burden to one task.
    """
    reached = (
        frontier.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(lists, ["node", "block"])
        .select(F.explode("nbrs").alias("node"), "label", F.pmod(F.xxhash64("label"), F.lit(SALTS)).cast("int").alias("salt"))
    )
    piece = reached.groupBy("node", "salt", "label").count().withColumn("least", F.min("label").over(W.partitionBy("node", "salt")))
    whole = piece.where("label = least").withColumn("first", F.min("label").over(W.partitionBy("node")))  # SALTS rows a node at most
    met = whole.where("label = first").select("node", "label").join(union(visited).select("node", F.col("label").alias("old")), "node", "left").join(nodes, "node")
    none = [F.lit(None).cast("string").alias("old"), F.lit(None).cast("int").alias("blocks"), F.lit(True).alias("link")]
    links = piece.where("label <> least").select(F.col("label").alias("node"), F.col("least").alias("label"), *none)
    links = links.union(whole.where("label <> first").select(F.col("label").alias("node"), F.col("first").alias("label"), *none))
    return met.withColumn("link", F.lit(False)).union(links)
