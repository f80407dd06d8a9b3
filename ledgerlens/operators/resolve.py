"""From candidates to typed fields with a confidence that can be checked against the document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import DECIMAL, find_amounts, find_currencies, has_three_decimals, local_dollar, normalize_amount, normalize_currency, normalize_tax_id, same_tax_id
from ledgerlens.functions.dates import date_order, date_readings, is_credit_note, normalize_date, pick_reading
from ledgerlens.functions.text import canon, fold, is_blank, let, normalize_text, opaque, page_of, squash
from ledgerlens.functions.words import AMOUNT_FIELDS, FIELDS, ID_FIELDS
from ledgerlens.operators.lines import CANDIDATES
from ledgerlens.plans.runtime import ship_code

# The four levels of confidence, and how printed amounts are added up.
HIGH, AMBIGUOUS, UNGROUNDED, MISSING = 1.0, 0.6, 0.3, 0.0
POOL, MOST_ADDENDS = 10, 6
# Labels of the two parties, as patterns of the JVM.
CUSTOMER_LABEL = (
    r"(?iuU)\b(bill(?:ed)?\s+to|sold\s+to|ship\s+to|invoice\s+to|customer|client|cliente|buyer|recipient|destinatario|destinataire|facturar\s+a|kunde|rechnungsempf[aä]nger)\b"
)
SUPPLIER_LABEL = r"(?iuU)\b(from|seller|supplier|vendor|issued\s+by|emisor|proveedor|lieferant|fournisseur|fornitore)\b"
TYPES = {f: DECIMAL if f in AMOUNT_FIELDS else "date" if f == "invoice_date" else "string" for f in FIELDS}
FIELDS_TYPE = "struct<" + ",".join(f"{f}:struct<value:{TYPES[f]},confidence:double,evidence:string,page:int>" for f in FIELDS) + ">"


def grounded(evidence: Column, squashed: Column) -> Column:
    """Whether the evidence stands in the squashed document, as a whole or, if it has several lines, each of them."""
    lines = F.filter(F.split(evidence, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: ~is_blank(x))
    return F.contains(squashed, squash(evidence)) | ((F.size(lines) > 1) & F.forall(lines, lambda x: F.contains(squashed, squash(x))))


def is_sum(value: Column, amounts: Column) -> Column:
    """Whether a value, sign aside, is the sum of two to six of the first ten amounts that are not 0."""
    pool = F.slice(F.transform(F.filter(amounts, lambda a: a["value"] != 0), lambda a: F.abs(a["value"])), 1, POOL)

    def search(p: Column) -> Column:
        masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(p)) - 1)

        def fits(m: Column) -> Column:
            chosen = F.aggregate(p, F.struct(F.lit(0).cast(DECIMAL).alias("s"), F.lit(0).alias("i")), lambda a, x: F.struct(
                (a["s"] + F.when(F.getbit(m, a["i"]) == 1, x).otherwise(F.lit(0).cast(DECIMAL))).cast(DECIMAL).alias("s"), (a["i"] + 1).alias("i")
            ))["s"]
            return F.bit_count(m).between(2, MOST_ADDENDS) & (chosen == F.abs(value))

        return F.exists(masks, fits)

    return let(pool, search)


def whole_match(field: str, value: Column, evidence: Column) -> Column:
    """Whether the value stands in the evidence as a whole: ids without more id characters next to them, names between words."""
    chars = F.filter(F.split(value if field in ID_FIELDS else fold(value), ""), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    if field in ID_FIELDS:
        body = F.array_join(chars, r"[\s.\-/]*")
        pattern = F.concat(F.lit(r"(?<![0-9A-Z/\-])(?<![0-9A-Za-z][/\-])(?iu:"), body, F.lit(r")(?![0-9a-z])(?![A-Z](?![a-z]))(?![/\-][0-9A-Za-z])"))
        return (F.size(chars) > 0) & F.regexp_like(evidence, pattern)
    pattern = F.concat(F.lit("(?<![0-9a-z])"), F.array_join(chars, "[^0-9a-z]*"), F.lit("(?![0-9a-z])"))
    return (F.size(chars) > 0) & F.regexp_like(fold(evidence), pattern)


def support(field: str, value: Column, evidence: Column, order: Column, three: Column, credit: Column, dollar: Column) -> Column:
    """``STRUCT<ok, ambiguous>``: whether the evidence has the value, and whether it can be read otherwise too."""
    made = lambda ok, unsure: F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(unsure, F.lit(False)).alias("ambiguous"))
    if field == "invoice_date":
        def dates(r: Column) -> Column:
            hit = F.get(F.filter(r, lambda x: F.when(order.isNull(), F.array_contains(x["dates"], value)).otherwise(pick_reading(x["dates"], order) == value)), F.lit(0))
            return made(hit.isNotNull(), order.isNull() & (F.size(hit["dates"]) > 1))

        return let(date_readings(evidence), dates)
    if field in AMOUNT_FIELDS:
        def amounts(a: Column) -> Column:
            hits = F.filter(a, lambda x: (x["value"] == value) | (credit & (x["value"] == -value)))
            found = F.size(hits) > 0
            summed = is_sum(value, a) if field == "tax_amount" else F.lit(False)
            return made(found | summed, F.when(found, F.forall(hits, lambda x: x["ambiguous"])).otherwise(summed))

        return let(find_amounts(evidence, three), amounts)
    if field == "currency":
        def codes(c: Column) -> Column:
            hits = F.filter(c, lambda x: x["code"] == value)
            return made(F.size(hits) > 0, (F.size(hits) > 0) & F.forall(hits, lambda x: x["ambiguous"]) & ~F.coalesce(dollar == value, F.lit(False)))

        return let(find_currencies(evidence), codes)
    inside = (canon(value) != "") & F.contains(canon(evidence), canon(value))
    return made(inside, inside & ~whole_match(field, value, evidence))


def confidence(value: Column, raw: Column, evidence: Column, ambiguous: Column, squashed: Column, supported: Column) -> Column:
    """0 for nothing, 0.3 for what is not parsed or not proven by the document, 0.6 for what is doubtful, else 1."""
    return (
        F.when(value.isNull(), F.when(F.coalesce(raw, F.lit("")) != "", UNGROUNDED).otherwise(MISSING))
        .when((F.coalesce(evidence, F.lit("")) == "") | ~F.coalesce(grounded(evidence, squashed), F.lit(False)), UNGROUNDED)
        .when(~supported["ok"], UNGROUNDED)
        .when(F.coalesce(ambiguous, F.lit(False)) | supported["ambiguous"], AMBIGUOUS)
        .otherwise(HIGH)
    )


def resolve(df: DataFrame, candidates: str = "candidates", pages: str = "pages", fields: str = "fields") -> DataFrame:
    """``df`` with a struct of the ten fields, each ``STRUCT<value, confidence, evidence, page>``.

    Signs of the whole document (order of dates, decimals, credit note, country) are computed once. Amounts of a credit note are
    negative. A doubtful tax is confirmed by a sure subtotal and total; after that, parties that are the same, or that are quoted
    under the label of the other one, become doubtful. A null candidate is a field without a value.
    """
    from ledgerlens.operators import onepass

    ship_code(df.sparkSession)
    return df.withColumn(fields, F.arrow_udf(onepass.resolved, FIELDS_TYPE)(candidates, pages))


def extract(df: DataFrame, pages: str = "pages", extractor: Callable[[DataFrame, str], DataFrame] | None = None, candidates: bool = True) -> DataFrame:
    """``df`` with ``candidates`` (unless they aren't wanted) and ``fields``: the whole path from pages to typed fields, without a shuffle.

    ``extractor`` is any transform that adds ``candidates``; without one the labels of the lines propose them. What it proposes goes the
    same way as all candidates.
    """
    from ledgerlens.operators import onepass

    if extractor:
        return resolve(extractor(df, pages), "candidates", pages)
    ship_code(df.sparkSession)
    if not candidates:
        return df.withColumn("fields", F.arrow_udf(onepass.extracted_fields, FIELDS_TYPE)(pages))
    both = df.withColumn("_both", F.arrow_udf(onepass.extracted, f"struct<candidates:{CANDIDATES},fields:{FIELDS_TYPE}>")(pages))
    return both.withColumns({"candidates": F.col("_both.candidates"), "fields": F.col("_both.fields")}).drop("_both")
