"""Problem 9: the reading level of each document, by ordinal regression over features of its prose."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.prose import sentences
from ledgerlens.plans.runtime import Stages, is_small, ship_code, table, with_value

#: Words of prose that a document needs.
LEAST_WORDS = 40
#: Ratings that the regression is fitted to: the first ones by hash of document and rater.
MAX_RATINGS = 20_000
#: Words of a vocabulary that is sent to all workers; the counts of a larger one are joined.
RANKED = 50_000
#: Strengths of the ridge penalty, of which the one with the least loss on held-out ratings is taken, and the parts held out in turn.
RIDGES, FOLDS = (0.1, 1.0, 10.0, 100.0), 5
BANDS = (1, 2, 3, 4)

# Words that join or subordinate clauses, and those that open a clause within another one.
CONNECTIVES = frozenset(
    "because although whereas while when until unless since before after once though if so provided insofar inasmuch whereupon notwithstanding albeit lest whereby "
    "therefore however moreover furthermore consequently hence thus nevertheless nonetheless otherwise meanwhile accordingly".split()
)
OPENERS = frozenset("that which who whom whose where why how whether because although whereas while when until unless since though if lest insofar inasmuch whereupon whereby provided albeit".split())
FEATURES = ("sentence_length", "word_length", "long_words", "syllables", "diversity", "rarity", "connectives", "clauses", "commas")
RARITY = FEATURES.index("rarity")


def syllables(word: str) -> int:
    """Groups of vowels, at least one."""
    n, last = 0, False
    for c in word:
        vowel = c in "aeiouy"
        n += vowel and not last
        last = vowel
    return max(1, n)


def depth(sent: list[str]) -> int:
    """How many clauses are open at once at most: an opener after the first word opens one, a comma closes one."""
    now = most = 0
    for k, w in enumerate(sent):
        if w == ",":
            now = max(0, now - 1)
        elif k and w in OPENERS:
            now += 1
            most = max(most, now)
    return most


def features(sents: list[list[str]], rarity: Mapping[str, float]) -> list[float]:
    """The FEATURES of a document with at least one word. ``rarity`` is minus the log of a word's share; a word without one counts 0."""
    words = [w for s in sents for w in s if w != ","]
    n = len(words)
    window = 40
    # Distinct words in windows of equal length, so that long documents do not seem poor; the last window ends at the last word.
    starts = sorted({*range(0, max(1, n - window + 1), window // 2), max(0, n - window)})
    distinct = [len(set(words[k : k + window])) / len(words[k : k + window]) for k in starts]
    return [
        math.log(n / len(sents)),
        sum(map(len, words)) / n,
        sum(len(w) >= 9 for w in words) / n,
        sum(map(syllables, words)) / n,
        sum(distinct) / len(distinct),
        sum(rarity.get(w, 0.0) for w in words) / n,
        sum(w in CONNECTIVES for w in words) / n,
        sum(map(depth, sents)) / len(sents),
        sum(s.count(",") for s in sents) / len(sents),
    ]


class Ordinal:
    """Proportional odds: the chance of a band above k is logistic in ``x·w - cut[k]``; ridge penalty on ``w``."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.cuts, self.mean, self.scale = weights, cuts, mean, scale

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 400) -> Ordinal:
        """Newton's method on the sum of the ``bands - 1`` binary losses that share ``w``; deterministic."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = (x - mean) / scale
        n, d = z.shape
        k = len(BANDS) - 1
        theta = np.zeros(d + k)
        theta[d:] = np.linspace(-1, 1, k)
        above = np.stack([(y > b).astype(float) for b in BANDS[:-1]], 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ theta[:d, None] - theta[None, d:], -30, 30)))
            g, h = p - above, np.maximum(p * (1 - p), 1e-6)
            grad = np.concatenate([z.T @ g.sum(1) + ridge * theta[:d], -g.sum(0) + 1e-3 * theta[d:]])
            cross = -(z.T @ h)
            hess = np.block([[z.T @ (z * h.sum(1)[:, None]) + ridge * np.eye(d), cross], [cross.T, np.diag(h.sum(0) + 1e-3)]])
            step = np.linalg.solve(hess, grad)
            theta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-7:
                break
        return Ordinal(theta[:d], np.sort(theta[d:]), mean, scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def band(self, x: np.ndarray) -> np.ndarray:
        """The band whose chances of more and of less are both at most a half."""
        return 1 + (self.score(x)[:, None] > self.cuts[None, :]).sum(1)


    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean of minus the log of the chance of the true band."""
        above = 1 / (1 + np.exp(-np.clip(self.score(x)[:, None] - self.cuts[None, :], -30, 30)))
        edge = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        chance = edge[np.arange(len(x)), y - 1] - edge[np.arange(len(x)), y]
        return float(-np.log(np.maximum(chance, 1e-6)).mean())


def best_ridge(x: np.ndarray, y: np.ndarray) -> float:
    """The ridge with the least loss on ratings held out in FOLDS turns; the first one if there are too few to hold any out."""
    fold = np.arange(len(y)) % FOLDS
    if any(len(set(y[fold != k].tolist())) < 2 for k in range(FOLDS)) or len(y) < 10 * FOLDS:
        return RIDGES[1]
    loss = {r: sum(Ordinal.fit(x[fold != k], y[fold != k], r).loss(x[fold == k], y[fold == k]) for k in range(FOLDS)) for r in RIDGES}
    return min(RIDGES, key=lambda r: loss[r])


def robust_fit(x: np.ndarray, y: np.ndarray, rounds: int = 3) -> Ordinal:
    """Fits, leaves out ratings that are two bands or more off, and fits again, up to ``rounds`` times: raters err at times."""
    ridge, keep = best_ridge(x, y), np.ones(len(y), bool)
    model = Ordinal.fit(x, y, ridge)
    for _ in range(rounds):
        now = np.abs(model.band(x) - y) < 2
        if (now == keep).all() or now.sum() < 10:
            break
        keep = now
        model = Ordinal.fit(x[keep], y[keep], ridge)
    return model


def prose_of(documents: DataFrame) -> DataFrame:
    """``(doc_id, words, prose)`` of documents with some English prose: sentences are lines, words parted by blanks."""
    ship_code(documents.sparkSession)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, path in zip(batch["doc_id"], batch["text"], batch["path"]):
                found = sentences(text, path)
                if found:
                    rows.append((i, sum(len(s) - s.count(",") for s in found), "\n".join(map(" ".join, found))))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "prose"])

    path = F.col("path") if "path" in documents.columns else F.lit(None).cast("string").alias("path")
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text", path).mapInPandas(task, "doc_id bigint, words bigint, prose string")


def word_counts(prose: DataFrame) -> DataFrame:
    """``(w, n, rarity)``: how often each word comes in the prose of all documents, and minus the log of its share."""
    counted = prose.select(F.explode(F.split("prose", r"[ \n]")).alias("w")).where("w <> ','").groupBy("w").agg(F.count("*").alias("n"))
    total = prose.agg(F.sum("words")).first()[0] or 1
    return counted.withColumn("rarity", -F.log(F.col("n") / F.lit(float(total))))


def measured(prose: DataFrame, counts: DataFrame, ranked: int = RANKED) -> DataFrame:
    """``(doc_id, words, f)`` with the features of each document.

    ``counts``, a staged table, goes to all workers if it has at most ``ranked`` rows; else the words of the documents are counted for
    each document and joined with it, frequent words in pieces, and only their means come back. Both ways give the same features.
    """
    small = is_small(counts, ranked)
    known = prose.sparkSession.sparkContext.broadcast({r["w"]: r["rarity"] for r in counts.collect()} if small else {})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="prose").assign(f=[features([s.split(" ") for s in p.split("\n")], known.value) for p in batch["prose"]])

    if small:
        return prose.mapInPandas(task, "doc_id bigint, words bigint, f array<double>")
    keyed = prose.withColumn("h", F.xxhash64("prose"))
    own = keyed.select("doc_id", "h", F.explode(F.split("prose", r"[ \n]")).alias("w")).where("w <> ','").groupBy("doc_id", "h", "w").agg(F.count("*").alias("times"))
    # Of a document that is there twice the words were counted twice, and so was their number.
    mean = with_value(own, counts, "w", "n").groupBy("doc_id", "h").agg((F.sum(F.col("times") * F.col("rarity")) / F.sum("times")).alias("mean"))
    found = keyed.select("doc_id", "words", "prose", "h").mapInPandas(task, "doc_id bigint, words bigint, h bigint, f array<double>")
    return found.join(mean, ["doc_id", "h"]).select("doc_id", "words", F.transform("f", lambda v, i: F.when(i == RARITY, F.col("mean")).otherwise(v)).alias("f"))


def ratings(labels: DataFrame, most: int = MAX_RATINGS) -> DataFrame:
    """``(doc_id, band)``: at most ``most`` ratings, each rater's of a document once; null and unknown bands are left out."""
    fine = labels.where("doc_id is not null").where(F.col("band").isin(*BANDS)).select("doc_id", "rater", F.col("band").cast("int").alias("band")).distinct()
    return fine.orderBy(F.xxhash64("doc_id", "rater"), "doc_id", "rater", "band").limit(most).select("doc_id", "band")


def levels(spark: SparkSession, documents: DataFrame, labels: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, words, band BIGINT, score)`` of each document with at least ``least`` words of English prose.

    The regression is fitted to at most MAX_RATINGS ratings, everything else covers all documents. Without two bands among
    the ratings nothing can be fitted and the result is empty. Null, empty and blank texts have no prose; repeated rows come
    out as often as they go in; other columns are not read.
    """
    stages = Stages(spark)
    prose = stages.cut(prose_of(documents))
    enough = prose.where(F.col("words") >= least)
    rows = stages.cut(measured(enough, stages.cut(word_counts(prose))))
    rated = stages.cut(ratings(labels))  # at most MAX_RATINGS rows
    sample = rated.join(rows.join(F.broadcast(rated.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "band", "f").orderBy("doc_id", "band").collect()  # at most MAX_RATINGS rows
    y = np.array([r["band"] for r in sample], int)
    if len(set(y.tolist())) < 2:
        return rows.select("doc_id", "words", F.lit(0).cast("bigint").alias("band"), F.lit(0.0).alias("score")).limit(0)
    model = robust_fit(np.array([r["f"] for r in sample], float), y)
    weights = model.weights / model.scale
    base = float(model.mean @ weights)
    score = F.aggregate(F.zip_with("f", F.array(*map(F.lit, weights.tolist())), lambda a, b: a * b), F.lit(-base), lambda s, v: s + v)
    band = F.lit(1)
    scored = rows.select("doc_id", "words", score.alias("score"))
    for cut in model.cuts.tolist():
        band = band + F.when(F.col("score") > cut, 1).otherwise(0)
    return scored.select("doc_id", "words", band.cast("bigint").alias("band"), "score")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The band of each document with enough English prose."""
    return levels(spark, table(spark, folder, "documents"), table(spark, folder, "reading_labels")).select("doc_id", "band")
