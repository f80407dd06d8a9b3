"""Building labels: printed values win, what is not printed is a discrepancy; scenarios, halves and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import is_printed, printed_forms
from ledgerlens.functions.dates import printed_dates
from ledgerlens.functions.text import canon
from ledgerlens.functions.words import AMOUNT_FIELDS, FIELDS, ID_FIELDS

# The scenarios that are dealt out in turn, and the days that their reference date lies after the invoice.
SCENARIOS = ("valid", "old_date", "currency", "customer")
RECENT_DAYS, OLD_DAYS = 30, 120


def printed(field: str, value: Column, text: Column) -> Column:
    """Whether a label's value is printed in the text, in any of the usual forms of its kind."""
    if field in AMOUNT_FIELDS:
        return is_printed(text, printed_forms(F.abs(value.try_cast("decimal(38,2)"))))
    if field == "invoice_date":
        return is_printed(text, printed_dates(value.try_cast("date")))
    if field == "currency":
        sign = F.when(value == "EUR", "€").when(value == "GBP", "£").when(value == "USD", "$").otherwise(value)
        return F.contains(text, value) | F.contains(text, sign)
    if field in ID_FIELDS:
        tight = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
        return F.contains(tight(text), tight(value))
    return F.contains(canon(text), canon(value))


def checked(df: DataFrame, expected: str, text: str) -> DataFrame:
    """``df`` with labels that are not printed set to null, and ``discrepancies``, the names of those fields."""
    fine = {f: F.coalesce(printed(f, F.col(f"{expected}.{f}"), F.col(text)), F.lit(False)) for f in FIELDS}
    kept = F.struct(*[F.when(fine[f], F.col(f"{expected}.{f}")).alias(f) for f in FIELDS])
    lost = F.filter(F.array(*[F.when(F.col(f"{expected}.{f}").isNotNull() & ~fine[f], f) for f in FIELDS]), lambda x: x.isNotNull())
    return df.withColumns({expected: kept, "discrepancies": lost})


def seeded(key: str, seed: int | None) -> list[Column]:
    """The order of ``key`` by a seeded hash, or of the key itself without a seed. It is the same on every run and every number of partitions."""
    return [F.col(key)] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def with_scenario(df: DataFrame, key: str, date: str, *groups: str, seed: int | None = None) -> DataFrame:
    """Deals the scenarios out in turn over the seeded order of ``key`` in each group, and sets the reference date that belongs to each.

    A window over a group orders all its rows in one task: give groups that are small, such as batches of labels.
    """
    turn = F.pmod(F.row_number().over(W.partitionBy(*groups).orderBy(*seeded(key, seed))) - 1, F.lit(len(SCENARIOS)))
    df = df.withColumn("scenario", F.element_at(F.array(*map(F.lit, SCENARIOS)), turn + 1))
    return df.withColumn("reference_date", F.date_add(date, F.when(F.col("scenario") == "old_date", OLD_DAYS).otherwise(RECENT_DAYS)))


def halves(df: DataFrame, key: str, *groups: str, seed: int | None = None) -> DataFrame:
    """The two halves of each group in the seeded order of ``key``; the first one has the odd row."""
    return df.withColumn("half", F.when(F.ntile(2).over(W.partitionBy(*groups).orderBy(*seeded(key, seed))) == 1, "dev").otherwise("test"))


def sample_of_each(df: DataFrame, n: int, key: str, *groups: str, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, the first ones in the seeded order of ``key``."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*groups).orderBy(*seeded(key, seed)))).where(F.col("_k") <= n).drop("_k")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, with their number; null keys don't count."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def adds_up(subtotal: Column, tax: Column, total: Column, *others: Column) -> Column:
    """Whether the parts make the total to within a cent."""
    parts = subtotal + tax
    for o in others:
        parts = parts + F.coalesce(o, F.lit(0))
    return F.abs(parts - total) <= F.lit("0.01").cast("decimal(4,2)")


def match_reason(number: Column, wanted: Column, printed_totals: Column, total: Column) -> Column:
    """Why a document is dropped, or null: it prints no number, another number, or not the total of its label."""
    return F.when(number.isNull() | (number == ""), "no_number").when(number != wanted, "other_number").when(~F.array_contains(printed_totals, total), "total_not_printed")
