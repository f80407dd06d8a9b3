"""Label jobs: from the ground truth of a public source and the text of its document to checked labels.

All follow one policy: what is printed wins. A value that is not printed becomes null and a discrepancy, credit notes are negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import mixed_amount
from ledgerlens.functions.text import after_label, before_comma
from ledgerlens.functions.words import AMOUNT_FIELDS, FIELDS
from ledgerlens.operators.labels import adds_up, match_reason, printed

NOTE = "struct<field:string,label:string,reason:string>"
# The months of printed Spanish dates, in order.
SPANISH_MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def note(field: str, label: Column, reason: str) -> Column:
    return F.struct(F.lit(field).alias("field"), label.cast("string").alias("label"), F.lit(reason).alias("reason")).cast(NOTE)


def labelled(df: DataFrame, fields: dict[str, Column], text: Column, shown: dict[str, Column] | None = None, notes: list[Column] | None = None, reason: str = "not printed") -> DataFrame:
    """``df`` with ``expected``, the ten fields as strings, and ``discrepancies``. ``shown`` replaces the check of single fields, ``notes`` are further discrepancies (null if none)."""
    df = df.withColumns({f"_f_{f}": fields[f].cast("string") for f in FIELDS})
    ok = {f: F.coalesce((shown or {}).get(f, printed(f, F.col(f"_f_{f}"), text)), F.lit(False)) for f in FIELDS}
    df = df.withColumns({f"_ok_{f}": ok[f] for f in FIELDS})
    lost = [F.when(F.col(f"_f_{f}").isNotNull() & ~F.col(f"_ok_{f}"), note(f, F.col(f"_f_{f}"), reason)) for f in FIELDS]
    expected = F.struct(*[F.when(F.col(f"_ok_{f}"), F.col(f"_f_{f}")).alias(f) for f in FIELDS])
    made = df.withColumns({"expected": expected, "discrepancies": F.array_compact(F.array(*(notes or []), *lost))})
    return made.drop(*[f"_{k}_{f}" for k in ("f", "ok") for f in FIELDS])


def spanish_amount(text: Column) -> Column:
    """An amount with points between thousands and a decimal comma."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,2)")


def spanish_day(text: Column) -> Column:
    """A date such as ``3 de mayo de 2021``."""
    part = lambda k: F.regexp_extract(F.lower(text), r"^\s*(\d{1,2}) de (\p{L}+) de (\d{4})\s*$", k)
    month = F.array_position(F.array(*map(F.lit, SPANISH_MONTHS)), part(2))
    return F.try_to_date(F.format_string("%s-%02d-%s", part(3), month, F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


def printed_in_spanish(day: Column, text: Column) -> Column:
    """Whether a date is printed in figures or in Spanish words."""
    word = F.element_at(F.array(*map(F.lit, SPANISH_MONTHS)), F.month(day))
    long = [F.concat(d, F.lit(" de "), word, F.lit(" de "), F.year(day).cast("string")) for d in (F.date_format(day, "dd"), F.date_format(day, "d"))]
    forms = F.array(*[F.date_format(day, f) for f in ("dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd")], *long)
    return F.exists(forms, lambda f: F.contains(F.lower(text), f))


def idsem(df: DataFrame, gt: str = "gt", text: str = "text", template: str = "template") -> DataFrame:
    """Spanish utility bills: fields by their keys in the ground truth (a map of strings).

    The tax is the sum of the two rates, and holds only if each rate that is not zero is printed. ``checks`` tells whether the parts make the
    total, ``tags`` what is special about the bill.
    """
    g = lambda k: F.trim(F.try_element_at(F.col(gt), F.lit(k)))
    flat = F.regexp_replace(F.col(text), r"(?U)\s+", " ")
    rates, day = [spanish_amount(g("N5")), spanish_amount(g("N8"))], spanish_day(g("F3"))
    tax, sub, total = rates[0] + rates[1], spanish_amount(g("J4")), spanish_amount(g("J5"))
    fields = {
        "supplier_name": g("C1"), "invoice_number": g("F1"), "invoice_date": day, "total_amount": total, "currency": F.lit("EUR"), "tax_id": g("C2"), "subtotal_amount": sub,
        "tax_amount": tax, "customer_name": g("A1"), "customer_tax_id": g("A2"),
    }
    each = [(r == 0) | printed("tax_amount", r.cast("string"), flat) for r in rates]
    made = labelled(df, fields, flat, {"tax_amount": each[0] & each[1], "invoice_date": printed_in_spanish(day, flat)})
    textual = F.contains(F.lower(flat), F.lower(g("F3"))) & g("F3").rlike(r"\d{1,2} de \p{L}+ de \d{4}")
    tags = [
        F.concat(F.lit("idsem_template"), F.col(template).cast("string")), *map(F.lit, ("utility_bill", "spanish", "synthetic_data", "spanish_number_format")),
        F.when(textual, "textual_spanish_date"), *map(F.lit, ("multi_vat", "electricity_tax")), F.when(F.contains(flat, F.lit("IGIC")), "igic_not_iva").otherwise("iva"),
        F.when(flat.rlike(r"X,XX|XX,XX"), "placeholder_amounts"),
    ]
    return made.withColumns({"checks": adds_up(sub, tax, total), "tags": F.array_compact(F.array(*tags))})


def gobl(df: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Invoices of an open JSON format (a variant): net amounts where prices include the tax, the country of a tax id only where it is
    printed with it, credit notes booked negative whatever sign is printed. ``key`` and ``kind`` serve to find duplicates."""
    v = lambda path: F.try_variant_get(F.col(doc), path, "string")
    compact = F.regexp_replace(F.col(text), r"(?U)\W", "")
    included, credit = F.coalesce(v("$.tax.prices_include").isNotNull(), F.lit(False)), F.coalesce(v("$.type") == "credit-note", F.lit(False))

    def tax_id(party: str) -> Column:
        code, country = v(f"$.{party}.tax_id.code"), F.coalesce(v(f"$.{party}.tax_id.country"), F.lit(""))
        whole = F.concat(country, code)
        return F.when(F.contains(compact, whole) & ~F.contains(F.col(text), F.concat(F.lit("("), country, F.lit(")"))), whole).otherwise(code)

    net, gross = v("$.totals.total"), v("$.totals.sum")
    raw = {"total_amount": v("$.totals.total_with_tax"), "subtotal_amount": F.when(included, net).otherwise(gross), "tax_amount": F.coalesce(v("$.totals.tax"), F.lit("0.00"))}
    turned = {f: credit & (raw[f].try_cast("decimal(38,2)") > 0) for f in AMOUNT_FIELDS}
    fields = {
        "supplier_name": v("$.supplier.name"), "invoice_number": F.concat(F.coalesce(F.concat(v("$.series"), F.lit("-")), F.lit("")), v("$.code")), "invoice_date": v("$.issue_date"),
        "currency": v("$.currency"), "tax_id": tax_id("supplier"), "customer_name": v("$.customer.name"), "customer_tax_id": tax_id("customer"),
        **{f: F.when(turned[f], F.concat(F.lit("-"), raw[f])).otherwise(raw[f]) for f in AMOUNT_FIELDS},
    }
    notes = [F.when(included, note("subtotal_amount", net, "prices include the tax: the net total is taken")).when(gross != net, note("subtotal_amount", gross, "another net total is given"))]
    notes += [F.when(turned[f], note(f, fields[f], "booked negative")) for f in AMOUNT_FIELDS]
    made = labelled(df, fields, F.col(text), notes=notes)
    return made.withColumns({"kind": F.coalesce(v("$.type"), F.lit("standard")), "key": F.concat_ws("|", v("$.supplier.name"), gross, raw["tax_amount"], raw["total_amount"])})


def salorworks(df: DataFrame, fields: dict[str, Column], text: str = "text", scanned: Column | None = None, discount: Column | None = None, freight: Column | None = None, duty: Column | None = None) -> DataFrame:
    """Invoices of several countries: of a scanned document (no text) all labels are null and nothing is a discrepancy; ``arithmetic`` tells whether
    subtotal less discount, with tax, freight and duty, makes the total."""
    gone = (F.lit(False) if scanned is None else F.coalesce(scanned, F.lit(False))) | F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    given = {f: F.when(~gone, before_comma(c) if f == "customer_name" else c) for f, c in fields.items()}
    number = lambda f: fields[f].try_cast("decimal(38,3)")
    less = -(F.lit(0) if discount is None else F.coalesce(discount, F.lit(0))).cast("decimal(38,3)")
    sums = adds_up(number("subtotal_amount"), number("tax_amount"), number("total_amount"), less, *[c for c in (freight, duty) if c is not None])
    return labelled(df, given, F.coalesce(F.col(text), F.lit(""))).withColumn("arithmetic", sums)


def mendeley(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Documents joined with the labels of the number that they print, and why one is dropped.

    ``labels`` has ``number, seller, client, day (MM/DD/YYYY), total, net, tax, seller_tax_id, client_tax_id``. ``reason`` is null for what is
    kept; ``misread`` tells that a reading with the day first gives another date. Names agree if the one begins with the other.
    """
    t = F.col(text)
    docs = df.withColumn("number", F.nullif(F.regexp_extract(t, r"(?i)invoice no:?\s*(\S+)", 1), F.lit("")))
    wanted = labels.select("number", F.struct(*[c for c in labels.columns if c != "number"]).alias("l"))
    j = docs.join(wanted, "number", "left")
    amounts = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\d[\d ,.]*[,.]\d{2}"), F.lit(0)), lambda a: mixed_amount(F.replace(a, F.lit(" "), F.lit("")))))
    total = mixed_amount(F.col("l.total"))
    begins = lambda a, b: F.startswith(F.lower(a), F.lower(b)) | F.startswith(F.lower(b), F.lower(a))
    compact = F.regexp_replace(t, r"(?U)\W", "")
    inside = lambda c: F.contains(compact, F.regexp_replace(c, r"(?U)\W", ""))
    day = F.try_to_date("l.day", "MM/dd/yyyy")
    other = F.try_to_date("l.day", "dd/MM/yyyy")
    reason = (
        F.when(F.col("l").isNull() & F.col("number").isNotNull(), "no_label").otherwise(match_reason(F.col("number"), F.col("number"), amounts, total))
    )
    reason = F.coalesce(
        reason, F.when(~F.coalesce(begins(after_label(t, "Seller"), F.col("l.seller")), F.lit(False)), "other_seller"),
        F.when(~F.coalesce(inside(F.col("l.seller_tax_id")), F.lit(False)), "tax_id_not_printed"), F.when(day.isNull(), "no_date"),
    )
    return j.withColumns({"reason": reason, "invoice_date": day, "misread": F.coalesce(other != day, F.lit(False))}).drop("l")


def rendered_faults(df: DataFrame, expected: str, text: str) -> DataFrame:
    """``df`` with ``faults``: labels that a rendered document does not print, a currency that it must not name, and parts that do not make the total."""
    of = lambda f: F.col(f"{expected}.{f}").cast("string")
    number = lambda f: of(f).try_cast("decimal(38,3)")
    missing = [F.when(of(f).isNotNull() & ~F.coalesce(printed(f, of(f), F.col(text)), F.lit(False)), F.concat(F.lit(f), F.lit(" is not printed"))) for f in FIELDS]
    marks = {"EUR": "€", "GBP": "£", "USD": "$"}
    foreign = [F.when(F.contains(F.col(text), F.lit(m)) & ~F.coalesce(of("currency") == c, F.lit(False)), f"{m} is printed") for c, m in marks.items()]
    wrong = F.when(~F.coalesce(adds_up(number("subtotal_amount"), number("tax_amount"), number("total_amount")), F.lit(True)), "the parts do not make the total")
    return df.withColumn("faults", F.array_compact(F.array(*missing, *foreign, wrong)))
