"""What every plan needs from the session: tables, the shared folder, staged tables and the code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which on the key is taken for hot and cut into pieces, and how many keys may be hot. A key that is not
#: among the HOT_KEYS most frequent ones has less than one HOT_KEYS-th of all rows.
HOT_ROWS, HOT_KEYS = 20_000, 1_000
#: A side is broadcast only if its rows were counted and are at most this many (of at most a few hundred bytes each).
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only a session without that setting (tests, one machine) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Stages:
    """Tables written to the shared folder in place of lineage: each is computed once and survives the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back; the staged tables ``done``, which nothing else reads, are deleted then."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._stage_path = path
        self.drop(*done)
        return read

    def drop(self, *dfs: DataFrame) -> None:
        """Delete staged tables that no later plan reads."""
        for df in dfs:
            path = getattr(df, "_stage_path", None)
            if path:
                jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ledgerlens-code-")) / f"{home.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, os.path.join(home.name, f.relative_to(home)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores if its files make fewer tasks than that, else as it is: for rows that cost much more than they weigh.

    Rows with equal ``keys`` then stay together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores and not keys else df.repartition(max(2 * cores, df.rdd.getNumPartitions()), *keys)


def with_value(rows: DataFrame, values: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``values``, however unequal the keys of ``rows`` are.

    ``values`` has one row a key, and in ``weight`` about how many rows of ``rows`` have it. The most frequent keys are cut
    into pieces of HOT_ROWS rows by the hash of the other columns, and their values are repeated for each piece; the list of
    those keys, at most HOT_KEYS, is broadcast. Null keys find no value. All stays lazy.
    """
    top = values.where(F.col(weight) > HOT_ROWS).orderBy(F.desc(weight), key).limit(HOT_KEYS)
    hot = F.broadcast(top.select(key, F.ceil(F.col(weight) / HOT_ROWS).cast("int").alias("_pieces")))
    other = [c for c in rows.columns if c != key]
    pieces = F.coalesce("_pieces", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_piece", F.when(pieces > 1, F.pmod(F.xxhash64(*other), pieces)).otherwise(0).cast("int"))
    right = values.join(hot, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.drop("_pieces").join(right.drop("_pieces"), [key, "_piece"], how).drop("_piece")


def first_delivery(df: DataFrame, key: str, by: str, columns: list[str], stages: Stages, last: bool = False) -> DataFrame:
    """``key`` and ``columns`` of each key once: of the row with the least ``by`` (the greatest if ``last``).

    Of equal ``by`` the least (greatest) row by its columns holds, one with a ``by`` before one without. Null keys are left out.
    Keys are counted alone first, and only the rows of those that came several times are sorted out; their keys are broadcast if
    they were counted and are few, else all rows are shuffled by the key once.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, by, *[c for c in columns if c not in (key, by)])
    again = stages.cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    hint = F.broadcast(again) if is_small(again) else again
    kept = F.struct(F.col(by).isNull() if not last else F.col(by).isNotNull(), by, *[F.col(c) for c in columns if c != by])
    pick = (F.max if last else F.min)(kept).alias("r")
    several = rows.join(hint, key, "left_semi").groupBy(key).agg(pick).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
    return rows.join(hint, key, "left_anti").select(key, *columns).unionByName(several)
