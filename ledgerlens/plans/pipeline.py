"""The three ways to run extraction: by labels of the lines, by recorded replies, or by both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import opaque
from ledgerlens.operators.replies import cascade, reply_candidates
from ledgerlens.operators.resolve import extract, resolve

MODES = ("heuristic", "llm", "hybrid")


def run(df: DataFrame, mode: str = "heuristic", replies: DataFrame | None = None, pages: str = "pages", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` with ``candidates, fields, used, warnings``; one mode for all rows.

    ``heuristic`` needs nothing else. ``llm`` takes the candidates of each row's recorded reply, ``hybrid`` asks only where the own
    fields are doubtful; both join ``replies (request_key, text)`` and fall back to the own fields, with a warning, where none is usable.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode != "heuristic" and replies is None:
        raise ValueError(f"mode {mode} needs replies")
    own = extract(df, pages)
    none = F.array().cast("array<string>")
    if mode == "heuristic":
        return own.withColumns({"used": F.lit("heuristic"), "warnings": none})
    if mode == "hybrid":
        return cascade(own, replies, pages=pages, cut=cut)
    one = replies.where("request_key is not null").groupBy("request_key").agg(F.min("text").alias("_reply"))
    asked = cut(own).join(one, "request_key", "left").withColumn("_theirs", reply_candidates(F.col("_reply")))
    usable = F.col("_theirs").isNotNull()
    warning = F.when(F.col("_reply").isNull(), "no reply was recorded for this request").when(~usable, "the reply does not match the schema")
    chosen = asked.withColumns({
        "used": F.when(usable, "llm").otherwise("heuristic:fallback"), "warnings": F.filter(F.array(warning), lambda w: w.isNotNull()),
        "candidates": opaque(F.coalesce("_theirs", "candidates")),
    })
    return resolve(chosen, "candidates", pages).drop("_reply", "_theirs")
