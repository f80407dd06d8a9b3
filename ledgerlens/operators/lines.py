"""From pages to candidates: line analysis inside the document's row, so that no step shuffles or needs a window.

Every step adds columns; arrays that later steps use more than once stay columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import find_amounts, find_currencies, normalize_tax_id, parse_amount
from ledgerlens.functions.dates import find_dates
from ledgerlens.functions.text import canon, is_label, let, opaque, strip
from ledgerlens.functions.words import FIELDS
from ledgerlens.plans.runtime import ship_code

# The words that label fields on invoices, as patterns of the JVM.
I = "(?iuU)"  # noqa: E741
BILL_TO = I + r"^\s*(bill(?:ed)?\s*to|ship\s*to|sold\s*to|customer|client|cliente|facturar\s*a)\b"
SUPPLIER = I + r"^\s*(?:supplier|seller|vendor|from|issued\s*by|proveedor|emisor)\s*:\s*(.*)$"
LEGAL_SUFFIX = (
    r"(?<![\w.])(?:ltd|limited|plc|llc|inc|corp|gmbh|ag|b\.?v|n\.?v|s\.?l\.?[up]?|s\.?a\.?u?|sas|sarl|s\.?r\.?l|ab|oy|a/s)\.?(?!\w)"
)
NUMBER = (
    I + r"(?:\b(?:invoice|factura|facture|fattura|factuur|faktura|fatura|rechnung)s?\s*-?\s*(?:no\b\.?|nr\b\.?|number|nummer|n[úu]m(?:ero|éro)?\b\.?|n[º°]\.?|n\.|#|id\b)?"
    r"|\b(?:numer|n[úu]mero|no\.?)\s+(?:de\s+)?(?:faktury|factura|facture|fatura))\s*[:#]?\s*(?=[A-Z0-9/.\-]*\d)([A-Z0-9][A-Z0-9/.\-]*[A-Z0-9]|\d)"
)
DATE_SPECIFIC = I + r"\b(invoice\s*date|date\s*of\s*issue|issue\s*date|fecha\s*(?:de\s*)?(?:emisi[óo]n|factura))\b"
DATE_GENERIC = I + r"\b(date|fecha)\b"
DUE = I + r"\b(due|vencimiento|payment\s*terms)\b"
TOTAL = I + (
    r"\b(total[a-z]*|amount\s*due|importe\s*total|gesamt\w*|rechnungs(?:betrag|total)|endbetrag|zu\s*zahlen|[àa]\s*payer|te\s*betalen|gross\s*amount|montant\s*total|valor\s*total)\b"
)
TOTAL_STRONG = I + (
    r"\b(total\s*due|amount\s*due|total\s*a\s*pagar|importe\s*total|invoice\s*total|total\s*factura|grand\s*total|total\s*amount|total\s*ttc|gesamtbetrag|rechnungs(?:betrag|total)"
    r"|totale\s*documento|totaal\s*te\s*betalen|zu\s*zahlen|montant\s*total)\b"
)
NOT_TOTAL = I + r"\b(sub-?\s*total|net\s*total|base\s*imponible|vat|iva|tax|total\s*h\.?t\b\.?|hors\s*tax\w*|netto\w*|imponibile|zwischensumme|subtotaal)"
TAX_LABEL = I + r"\b(?:vat|tax\s*id|nif|cif|ust-?idnr\.?(?:\s*/\s*vat\s*id)?)\b(?:\s*(?:reg(?:istration)?\.?|no\.?|number|id|nr\.?))*\s*[:#]?\s*(.+)$"
SUBTOTAL = I + (
    r"\b(sub-?\s*total|net\s*total|net\s*amount|taxable\s*amount|base\s*imponible|total\s*h\.?t\b|hors\s*tax\w*|netto\w*|imponibile|subtotaal|zwischensumme|net\s*value|importe\s*neto)"
)
_TAX = r"(?:vat|iva|igic|tax|tva|mwst|ust|btw|gst|hst|moms)"
TAX_AMOUNT = I + rf"\b{_TAX}\b.*(%|@)|{I}%\s*{_TAX}\b|{I}^\s*{_TAX}\b\s*(?:\[%\])?\s*[\d(-]|{I}\b(?:total\s*{_TAX}|{_TAX}\s*amount|cuota\s*iva)\b"
TAX_ID_LINE = I + r"\b(?:vat|tax)\s*(?:id|reg\w*|no\b|number|nr)|\b(?:nif|cif|ust-?idnr|tin|trn)\b"
VALUE_ONLY = r"^\s*(?:[A-Z]{3}|[$€£¥₹])?\s*-?\(?\d[\d.,'’\u00a0\u202f ]*\)?\s*(?:%|[A-Z]{3}|[$€£¥₹]|-)?\s*$"
WITHHOLDING = I + r"\b(retenci[óo]n|irpf|withholding)\b"
SECTION = I + r"\b(invoice|factura|date|fecha|total|subtotal|description|qty|quantity|concepto|importe|amount)\b"
VALUE_DATE = r"(?U)^\s*[\d./\-]{6,10}\s*$|^\s*\d{1,2}\s+\w+\.?\s+\d{2,4}\s*$"
BLOCK_LINES = 6

CANDIDATE = "struct<raw:string,evidence:string,page:int,ambiguous:boolean>"
CANDIDATES = "struct<" + ",".join(f"{f}:{CANDIDATE}" for f in FIELDS) + ">"


def none() -> Column:
    return F.lit(None).cast(CANDIDATE)


def candidate(raw: Column, evidence: Column, page: Column, ambiguous: Column | bool = False) -> Column:
    unsure = F.lit(ambiguous) if isinstance(ambiguous, bool) else ambiguous
    return F.struct(raw.alias("raw"), evidence.alias("evidence"), page.cast("int").alias("page"), unsure.alias("ambiguous"))


def index(n: Column) -> Column:
    """0 to n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def lines_of(pages: Column) -> Column:
    """``ARRAY<STRUCT<page, text>>``: the lines of all pages, stripped, in order."""
    return F.flatten(F.transform(pages, lambda p, k: F.transform(F.split(p, "\n", -1), lambda t: F.struct((k + 1).alias("page"), strip(t).alias("text")))))


def block_flags(lines: Column) -> Column:
    """For each line, whether it is in a customer block.

    A line that opens one holds for six lines with itself, or up to a blank line, a line of another section or a supplier's label. So
    a line is in a block if an opener is at most five lines above it and none of the lines after the opener, itself included, ends it.
    """
    opens = F.transform(lines, lambda x: x["text"].rlike(BILL_TO))
    ends = F.transform(lines, lambda x: ~x["text"].rlike(BILL_TO) & ((x["text"] == "") | x["text"].rlike(SECTION) | x["text"].rlike(SUPPLIER)))

    def flags(o: Column) -> Column:
        def inside(e: Column) -> Column:
            def at(i: Column) -> Column:
                reach = F.sequence(F.lit(0), F.least(i, F.lit(BLOCK_LINES - 1)))
                return F.exists(reach, lambda k: F.get(o, i - k) & ~F.exists(F.slice(e, i - k + 2, k), lambda x: x))

            return F.transform(index(F.size(o)), at)

        return let(ends, inside)

    return let(opens, flags)


def paired_rows(own: Column) -> Column:
    """``ARRAY<STRUCT<label INT, value INT>>``: lines of labels and the lines of values that a text layer printed after them.

    A run of labels and the run of values right after it are paired in order from the last label, if there are not more values
    than labels. The lines are coded as one letter each, so that a run is a match.
    """
    coded = F.array_join(F.transform(own, lambda x: F.when(is_label(x["text"]), "L").when(x["text"].rlike(VALUE_ONLY), "V").otherwise("-")), "")

    def pairs(s: Column) -> Column:
        between = F.split(s, "L+V+", -1)
        labels, values = (F.regexp_extract_all(s, F.lit("(L+)(V+)"), F.lit(k)) for k in (1, 2))
        runs = F.zip_with(labels, values, lambda a, b: F.struct(F.length(a).alias("l"), F.length(b).alias("v")))

        def all_pairs(r: Column) -> Column:
            def of(run: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda n, t: n + F.length(t)) + F.aggregate(F.slice(r, F.lit(1), i), F.lit(0), lambda n, t: n + t["l"] + t["v"])
                first = before + run["l"]
                made = F.transform(index(run["v"]), lambda k: F.struct((first - run["v"] + k).alias("label"), (first + k).alias("value")))
                return F.when(run["v"] <= run["l"], made).otherwise(F.slice(made, 1, 0))

            return F.flatten(F.transform(r, of))

        return let(runs, all_pairs)

    return let(coded, pairs)


def rows_of(own: Column, pairs: Column) -> Column:
    """``ARRAY<STRUCT<page, text, evidence>>``: every line, and after all of them each label with its value."""
    plain = F.transform(own, lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"), x["text"].alias("evidence")))
    joined = F.transform(
        pairs,
        lambda p: F.struct(
            F.get(own, p["label"])["page"].alias("page"),
            F.concat_ws(" ", F.get(own, p["label"])["text"], F.get(own, p["value"])["text"]).alias("text"),
            F.concat_ws("\n", F.get(own, p["label"])["text"], F.get(own, p["value"])["text"]).alias("evidence"),
        ),
    )
    return F.concat(plain, joined)


def pick(found: Column, ambiguous: Column | bool = False) -> Column:
    """The first of ``ARRAY<STRUCT<raw, evidence, page>>``; ambiguous too if several raw values differ by letters or figures."""

    def first(f: Column) -> Column:
        several = F.size(F.array_distinct(F.transform(f, lambda x: canon(x["raw"])))) > 1
        unsure = several | (F.lit(ambiguous) if isinstance(ambiguous, bool) else ambiguous)
        return F.when(F.size(f) > 0, candidate(F.get(f, F.lit(0))["raw"], F.get(f, F.lit(0))["evidence"], F.get(f, F.lit(0))["page"], unsure))

    return let(found, first)


def quote(raw: Column, line: Column) -> Column:
    evidence = line["evidence"] if line is not None else None
    return F.struct(raw.alias("raw"), evidence.alias("evidence"), line["page"].alias("page"))


def supplier(lines: Column, inside: Column) -> Column:
    """What follows a supplier's label outside the customer block, on its line or on the next one that is not blank; else the
    lines with a legal form."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["page"].alias("page"), x["text"].alias("text"), F.get(inside, i).alias("inside")))

    def choose(all_: Column) -> Column:
        outside = F.filter(all_, lambda x: ~x["inside"])

        def named(x: Column) -> Column:
            here = strip(F.regexp_extract(x["text"], SUPPLIER, 1))
            after = F.get(F.filter(all_, lambda y: (y["i"] > x["i"]) & (y["text"] != "")), F.lit(0))
            return F.when(here != "", candidate(here, x["text"], x["page"])).when(after.isNotNull(), candidate(after["text"], after["text"], after["page"]))

        labelled = F.filter(F.transform(F.filter(outside, lambda x: x["text"].rlike(SUPPLIER)), named), lambda c: c.isNotNull())
        suffixed = F.transform(
            F.filter(outside, lambda x: x["text"].rlike(I + LEGAL_SUFFIX)), lambda x: F.struct(x["text"].alias("raw"), x["text"].alias("evidence"), x["page"].alias("page"))
        )
        return F.coalesce(F.get(labelled, F.lit(0)), pick(suffixed))

    return let(numbered, choose)


def as_rows(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"), x["text"].alias("evidence")))


def invoice_number(own: Column) -> Column:
    """The first identifier with a figure after a label, line by line."""
    found = F.transform(as_rows(own), lambda x: quote(F.regexp_extract(x["text"], NUMBER, 1), x))
    return pick(F.filter(found, lambda x: x["raw"] != ""))


def invoice_date(own: Column) -> Column:
    """Dates by the label of their line: that of an issue date before a plain one before none; lines with a due date don't count.

    A date alone on its line takes the line before it, blank lines aside, as its label if that is only a label.
    """
    filled = F.filter(own, lambda x: x["text"] != "")

    def choose(f: Column) -> Column:
        def read(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(f, i - 1)["text"], F.lit(""))
            alone = is_label(before) & x["text"].rlike(VALUE_DATE)
            label = F.when(alone, F.concat_ws(" ", before, x["text"])).otherwise(x["text"])
            evidence = F.when(alone, F.concat_ws("\n", before, x["text"])).otherwise(x["text"])
            tier = F.when(label.rlike(DUE), 9).when(label.rlike(DATE_SPECIFIC), 0).when(label.rlike(DATE_GENERIC), 1).otherwise(2)
            return F.transform(
                find_dates(x["text"]), lambda d: F.struct(tier.alias("tier"), d["matched"].alias("raw"), evidence.alias("evidence"), x["page"].alias("page"))
            )

        dated = F.filter(F.flatten(F.transform(f, read)), lambda d: d["tier"] < 9)

        def best(d: Column) -> Column:
            top = F.array_min(F.transform(d, lambda x: x["tier"]))
            return pick(F.transform(F.filter(d, lambda x: x["tier"] == top), lambda x: F.struct(x["raw"].alias("raw"), x["evidence"].alias("evidence"), x["page"].alias("page"))), F.coalesce(top == 2, F.lit(False)))

        return let(dated, best)

    return let(filled, choose)


def last_amount(rows: Column, wanted, strong=None) -> Column:
    """The last amount of the last row that is wanted, of strong rows if there are any; ambiguous if their amounts differ."""
    read = F.transform(
        F.filter(rows, wanted),
        lambda x: F.struct(
            F.try_element_at(find_amounts(x["text"]), F.lit(-1))["token"].alias("raw"), x["evidence"].alias("evidence"), x["page"].alias("page"),
            (strong(x) if strong else F.lit(True)).alias("strong"),
        ),
    )

    def choose(found: Column) -> Column:
        chosen = F.when(F.exists(found, lambda x: x["strong"]), F.filter(found, lambda x: x["strong"])).otherwise(found)

        def last(c: Column) -> Column:
            end = F.try_element_at(c, F.lit(-1))
            return F.when(F.size(c) > 0, candidate(end["raw"], end["evidence"], end["page"], F.size(F.array_distinct(F.transform(c, lambda x: parse_amount(x["raw"])))) > 1))

        return let(chosen, last)

    return let(F.filter(read, lambda x: x["raw"].isNotNull()), choose)


def currency(own: Column, total: Column) -> Column:
    """The currency in the line of the total, the first one that is not shared if there is any; else the one named most often."""
    near = find_currencies(total["evidence"])

    def by_total(f: Column) -> Column:
        sure = F.get(F.filter(f, lambda c: ~c["ambiguous"]), F.lit(0))["code"]
        return F.when(F.size(f) > 0, candidate(F.coalesce(sure, F.get(f, F.lit(0))["code"]), total["evidence"], total["page"]))

    named = F.flatten(
        F.transform(own, lambda x: F.transform(find_currencies(x["text"]), lambda c: F.struct(c["code"].alias("code"), x["text"].alias("text"), x["page"].alias("page"))))
    )

    def by_count(f: Column) -> Column:
        codes = F.array_distinct(F.transform(f, lambda c: c["code"]))
        ranked = F.transform(codes, lambda c, i: F.struct((-F.size(F.filter(f, lambda x: x["code"] == c))).alias("n"), i.alias("i"), c.alias("code")))
        code = F.array_min(ranked)["code"]
        first = F.get(F.filter(f, lambda x: x["code"] == code), F.lit(0))
        return F.when(F.size(f) > 0, candidate(code, first["text"], first["page"], F.size(codes) > 1))

    return F.coalesce(let(near, by_total), let(named, by_count))


def tax_id(lines: Column) -> Column:
    """The tax ids after a label that read as one."""
    found = F.transform(as_rows(lines), lambda x: quote(normalize_tax_id(F.regexp_extract(x["text"], TAX_LABEL, 1)), x))
    return pick(F.filter(found, lambda x: x["raw"].isNotNull()))


def customer_name(block: Column) -> Column:
    """The first name with a legal form in the customer block, cut after the form, without the block's label."""
    read = F.transform(
        block,
        lambda x: F.struct(
            strip(F.regexp_extract(F.regexp_replace(F.regexp_replace(x["text"], BILL_TO, ""), r"^[ :]+", ""), I + "^(.*?" + LEGAL_SUFFIX + ")", 1)).alias("raw"),
            x["text"].alias("evidence"), x["page"].alias("page"),
        ),
    )
    first = F.get(F.filter(read, lambda x: x["raw"] != ""), F.lit(0))
    return F.when(first.isNotNull(), candidate(first["raw"], first["evidence"], first["page"]))


def propose(df: DataFrame, pages: str = "pages") -> DataFrame:
    """``df`` with ``candidates``: a struct of the ten fields, each ``STRUCT<raw, evidence, page, ambiguous>`` or null.

    A null, an empty list of pages and blank pages give no candidates. Narrow: each document stays in its row.
    """
    from ledgerlens.operators import onepass

    ship_code(df.sparkSession)
    return df.withColumn("candidates", F.arrow_udf(onepass.proposed, CANDIDATES)(pages))
