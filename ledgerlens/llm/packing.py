"""Problem 8: documents packed into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import document_sizes
from ledgerlens.plans.runtime import Stages, table

#: Bins that are open at once in a lane.
OPEN = 256
#: Tokens that one lane packs at least.
LANE_TOKENS = 8_000_000
#: Lanes at most; beyond LANES * LANE_TOKENS tokens lanes are longer, so the number of tasks stays bounded at any size.
LANES = 256


class BestFit:
    """Bounded-space online best-fit for one capacity.

    Open bins are kept by their free space; a bitset has a one for each free space that some open bin has, so the
    tightest bin that takes an item is the lowest one at or above the item's size. When a bin more than ``limit`` would be
    open, the fullest one closes; full bins close at once.
    """

    def __init__(self, capacity: int, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.free = 0
        self.bins: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _close_fullest(self) -> None:
        space = (self.free & -self.free).bit_length() - 1
        self._take(space)

    def _take(self, space: int) -> int:
        group = self.bins[space]
        bin_no = group.pop()
        if not group:
            del self.bins[space]
            self.free ^= 1 << space
        self.open -= 1
        return bin_no

    def put(self, size: int) -> int:
        """The number of the bin that takes an item of at most the capacity."""
        above = self.free >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            bin_no = self._take(space)
        else:
            if self.open >= self.limit:
                self._close_fullest()
            bin_no, space = self.made, self.capacity
            self.made += 1
        space -= size
        if space:
            if space not in self.bins:
                self.bins[space] = []
                self.free |= 1 << space
            self.bins[space].append(bin_no)
            self.open += 1
        return bin_no


def pack_task(capacities: dict[str, int], limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs rows sorted by pack name and lane as they stream by; holds nothing but the open bins.

    Bins that are still open when a lane ends go out with ``left``, their free space."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fit = None, None
        columns = ["pack_name", "lane", "bin_no", "doc_id", "part", "start", "tokens", "left"]

        def ended() -> list[tuple]:
            return [(*at, b, None, None, None, None, space) for space, group in fit.bins.items() for b in group] if at else []

        for batch in batches:
            out: list[tuple] = []
            for pack, lane, doc, tokens in zip(batch["pack_name"], batch["lane"], batch["doc_id"], batch["tokens"]):
                if (pack, lane) != at:
                    out += ended()
                    at, fit = (pack, lane), BestFit(capacities[pack], limit)
                start, part = 0, 0
                while True:
                    size = min(tokens - start, fit.capacity)
                    out.append((pack, lane, fit.put(size), doc, part, start, size, None))
                    start, part = start + size, part + 1
                    if start >= tokens:
                        break
            if out:
                yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in columns[1:]})
        if at and (rest := ended()):
            yield pd.DataFrame(rest, columns=columns).astype({c: "Int64" for c in columns[1:]})

    return task


def join_task(capacities: dict[str, int], limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs what the lanes left open once more, each part-filled bin as one item: at most OPEN bins a lane and capacity."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fit = None, None
        for batch in batches:
            out = []
            for pack, lane, bin_no, left in zip(batch["pack_name"], batch["lane"], batch["bin_no"], batch["left"]):
                if pack != at:
                    at, fit = pack, BestFit(capacities[pack], limit)
                out.append((pack, lane, bin_no, fit.put(capacities[pack] - left)))
            if out:
                yield pd.DataFrame(out, columns=["pack_name", "lane", "bin_no", "joined"])

    return task


def pack(spark: SparkSession, sizes: DataFrame, packs: DataFrame, limit: int = OPEN, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """``(pack_name, capacity_tokens, lane, bin_no, doc_id, part, start, tokens)``, one row for each part of a document.

    ``sizes`` has ``doc_id`` and ``tokens``. A document is split only if it is larger than the capacity: into full
    containers and a rest. Documents without tokens take no space but are placed. Rows with a null size are placed as
    if they had none; repeated rows are packed as often as they come. Packs with a null name or a capacity under 1 are left
    out, of a name that is repeated the first capacity holds. Lanes are by hash of the id, each packed in
    hash order, which makes a lost task repeatable. There are LANES at most, whatever the size; the bins that are open when a lane ends
    are packed once more across all lanes, into bins of lane -1.
    """
    stages = Stages(spark)
    capacities = {
        r["pack_name"]: r["c"]
        for r in packs.where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").alias("c")).collect()
    }  # the table of container kinds is fixed at a handful of rows
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    lanes = max(1, min(LANES, -(-total // lane_tokens)))
    kinds = spark.createDataFrame([(k, c) for k, c in capacities.items()], "pack_name string, capacity_tokens int")
    rows = (
        sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
        .withColumn("pack_name", F.explode(F.lit(sorted(capacities)) if capacities else F.array().cast("array<string>")))
        .withColumn("h", F.xxhash64("doc_id", F.lit(8)))
        .withColumn("lane", F.pmod("h", F.lit(lanes)).cast("int"))
    )
    columns = "pack_name string, lane int, bin_no bigint, doc_id bigint, part int, start bigint, tokens bigint, left bigint"
    placed = stages.cut(
        rows.repartition(max(1, lanes * len(capacities)), "pack_name", "lane")
        .sortWithinPartitions("pack_name", "lane", "h", "doc_id", "tokens")
        .select("pack_name", "lane", "doc_id", "tokens")
        .mapInPandas(pack_task(capacities, limit), columns)
    )
    open_ = placed.where("left is not null").select("pack_name", "lane", "bin_no", "left")
    # At most OPEN rows a lane and capacity.
    joined = open_.repartition(max(1, len(capacities)), "pack_name").sortWithinPartitions("pack_name", "left", "lane", "bin_no").mapInPandas(
        join_task(capacities, limit), "pack_name string, lane int, bin_no bigint, joined bigint"
    )
    joined = stages.cut(joined) if lanes > 1 else joined.limit(0)
    return (
        placed.where("left is null").drop("left")
        .join(F.broadcast(joined), ["pack_name", "lane", "bin_no"], "left")
        .join(F.broadcast(kinds), "pack_name")
        .select("pack_name", "capacity_tokens", F.when(F.col("joined").isNull(), F.col("lane")).otherwise(-1).alias("lane"), F.coalesce("joined", "bin_no").alias("bin_no"), "doc_id", "part", "start", "tokens")
    )


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in the packs of each capacity."""
    stages = Stages(spark)
    sizes = stages.cut(document_sizes(table(spark, folder, "documents")))
    return pack(spark, sizes, table(spark, folder, "packs"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Of each capacity: containers, tokens, the least number of containers that any packing needs, and the share filled."""
    placed = p8_packs(spark, folder)
    bins = placed.groupBy("pack_name", "capacity_tokens", "lane", "bin_no").agg(F.sum("tokens").alias("used"))
    return bins.groupBy("pack_name", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_containers"),
        F.round(F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("filled"),
    )
