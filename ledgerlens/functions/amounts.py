"""Amounts, currencies and tax ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import let
from ledgerlens.functions.words import CURRENCY_WORDS, ISO_CURRENCIES, NOT_EU_VAT, SYMBOLS, THREE_DECIMALS, US_STATES, VAT_PREFIXES

DECIMAL = "decimal(38,6)"
# What parts groups of thousands, and what a number looks like; the grouped form is tried first.
GROUPS = " \u00a0\u202f'\u2019"
TOKEN = rf"-?\d{{1,3}}(?:[{GROUPS}]\d{{3}})+(?:[.,]\d{{1,2}})?(?![\d.,])|-?\d[\d.,]*\d|-?\d"
_AROUND = rf"(?s)(?<=(^|.))({TOKEN})(?=(.{{0,2}}))"


def parse_amount(token: Column, three: Column | None = None) -> Column:
    """``STRUCT<value DECIMAL(38,6), ambiguous BOOLEAN>`` of one number, or null.

    With both marks the later one is the decimal mark. A mark that comes more than once parts thousands, and then three
    figures must follow each. One mark before three figures may be either: it is read as thousands and is ambiguous, except a
    point where ``three`` says that the currency has three decimals.
    """
    three = F.lit(False) if three is None else three
    body = F.regexp_replace(token, rf"^-+|[{GROUPS}]", "")

    def read(d: Column) -> Column:
        point, comma = F.contains(d, F.lit(".")), F.contains(d, F.lit(","))
        no_marks = F.regexp_replace(d, "[.,]", "")
        text = (
            F.when(point & comma, F.when(d.rlike(r"\.[^,]*$"), F.replace(d, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(d, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
            .when(d.rlike(r"^\d*[.,]\d*[.,]"), F.when(d.rlike(r"^\d*(?:[.,]\d{3})+$"), no_marks))
            .when(d.rlike(r"\.\d{3}$") & three, d)
            .when(d.rlike(r"[.,]\d{3}$"), no_marks)
            .when(d.rlike(r"[.,]\d{1,2}$"), F.replace(d, F.lit(","), F.lit(".")))
            .when(~point & ~comma, d)
        )
        unsure = ~(point & comma) & d.rlike(r"^\d*[.,]\d{3}$") & ~(point & three)
        value = text.try_cast(DECIMAL)
        signed = F.when(F.startswith(token, F.lit("-")), -value).otherwise(value).cast(DECIMAL)
        return F.when(value.isNotNull(), F.struct(signed.alias("value"), unsure.alias("ambiguous")))

    return let(body, read)


def find_amounts(text: Column, three: Column | None = None) -> Column:
    """``ARRAY<STRUCT<value, ambiguous, token>>`` of all amounts in a text, in their order.

    Numbers next to a letter or a figure of another kind, and percentages, are none. A number with two decimals in brackets or
    before a minus is negative; its token has those marks.
    """
    text = F.replace(text, F.lit("−"), F.lit("-"))
    part = lambda k: F.regexp_extract_all(text, F.lit(_AROUND), F.lit(k))
    found = F.filter(F.arrays_zip(part(1).alias("before"), part(2).alias("token"), part(3).alias("after")), lambda m: ~m["before"].rlike(r"[\p{L}\p{N}]") & ~m["after"].rlike(r"^[\p{L}%]"))

    def read(m: Column) -> Column:
        def signed(a: Column) -> Column:
            exact = m["token"].rlike(r"[.,]\d{2}$") & (a["value"] > 0)
            bracket = exact & (m["before"] == "(") & F.startswith(m["after"], F.lit(")"))
            minus = exact & m["after"].rlike(r"^-(?!\d)")
            return F.when(
                a.isNotNull(),
                F.struct(
                    F.when(bracket | minus, -a["value"]).otherwise(a["value"]).cast(DECIMAL).alias("value"),
                    a["ambiguous"].alias("ambiguous"),
                    F.when(bracket, F.concat(F.lit("("), m["token"], F.lit(")"))).when(minus, F.concat(m["token"], F.lit("-"))).otherwise(m["token"]).alias("token"),
                ),
            )

        return let(parse_amount(m["token"], three), signed)

    return F.filter(F.transform(found, read), lambda a: a.isNotNull())


def normalize_amount(raw: Column, three: Column | None = None) -> Column:
    """The last amount in a text, or null."""
    return F.try_element_at(find_amounts(raw, three), F.lit(-1))["value"]


def _found(code: Column, ambiguous: Column, matched: Column) -> Column:
    return F.struct(code.alias("code"), ambiguous.alias("ambiguous"), matched.alias("matched"))


def find_currencies(text: Column) -> Column:
    """``ARRAY<STRUCT<code, ambiguous, matched>>``: codes first, then symbols, then written names."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    codes = F.transform(F.filter(every(r"(?U)\b[A-Z]{3}\b"), lambda m: m.isin(*ISO_CURRENCIES)), lambda m: _found(m, F.lit(False), m))
    of = F.create_map(*[F.lit(x) for s, c, _ in SYMBOLS for x in (s, c)])
    shared = [s for s, _, a in SYMBOLS if a]
    symbols = F.transform(every("|".join(rf"\Q{s}\E" for s, _, _ in SYMBOLS)), lambda m: _found(F.element_at(of, m), m.isin(*shared), m))

    def written(pattern: str, code: str, ambiguous: bool) -> Column:
        return F.transform(every(pattern), lambda m: _found(F.lit(code), F.lit(ambiguous), m))

    words = [written(*w) for w in CURRENCY_WORDS]
    return F.concat(codes, symbols, *words)


def normalize_currency(raw: Column) -> Column:
    """The first currency in a text, else the first one in it in upper case."""
    first = lambda t: F.get(find_currencies(t), F.lit(0))["code"]
    return F.coalesce(first(raw), first(F.upper(raw)))


def has_three_decimals(text: Column) -> Column:
    """Whether a document names a currency with three decimals."""
    return F.exists(find_currencies(text), lambda c: c["code"].isin(*THREE_DECIMALS))


_EU_VAT = rf"(?U)\b(?:{'|'.join(sorted(set(VAT_PREFIXES) - set(NOT_EU_VAT)))})[ ]?(?=[0-9A-Z]*\d{{6}})[0-9A-Z]{{8,12}}\b"
_US_ADDRESS = rf"(?U)\b(?:{'|'.join(US_STATES)})\s+\d{{5}}(?:-\d{{4}})?\b"


def is_us(text: Column) -> Column:
    """Whether a document has a US postal address."""
    return text.rlike(_US_ADDRESS)


def is_european(text: Column) -> Column:
    """Whether a document has a euro or pound sign, or a VAT number of the EU scheme."""
    return F.contains(text, F.lit("€")) | F.contains(text, F.lit("£")) | text.rlike(_EU_VAT)


def local_dollar(text: Column) -> Column:
    """USD if the only sign of a country is a US address, else null."""
    return F.when(is_us(text) & ~is_european(text), F.lit("USD"))


def normalize_tax_id(raw: Column) -> Column:
    """One form of a tax id, upper case without marks; null if the text does not begin with something like one.

    A country in brackets before it goes; another tax label after it ends it. Accepted are VAT numbers with 8 to 12 characters after
    the country, Spanish numbers, nine figures, and 8 to 20 characters with at least five figures.
    """
    text = F.regexp_replace(F.upper(raw), r"^\s*\([A-Z]{2}\)\s*", "")
    text = F.regexp_replace(text, r"(?sU)\s+(?:NIF|CIF|VAT|TVA|IVA|UID|NIP|TIN|TRN|UST-?IDNR)\b.*$", "")
    tight = F.regexp_extract(F.regexp_replace(text, r"(?U)[\s.\-]", ""), r"^([A-Z0-9]+)", 1)

    def accept(c: Column) -> Column:
        vat = F.substring(c, 1, 2).isin(*VAT_PREFIXES) & F.length(c).between(10, 14)
        spanish = c.rlike(r"^(?:[A-Z]\d{7}[A-Z0-9]|\d{8}[A-Z])$")
        other = F.length(c).between(8, 20) & (F.length(F.regexp_replace(c, r"[^0-9]", "")) >= 5)
        return F.when(vat | spanish | c.rlike(r"^\d{9}$") | other, c)

    return let(tight, accept)


def same_tax_id(a: Column, b: Column) -> Column:
    """Equal, or equal but for the country before one of them."""
    a_longer = F.length(a) > F.length(b)
    longer, shorter = F.when(a_longer, a).otherwise(b), F.when(a_longer, b).otherwise(a)
    return (a == b) | (F.substring(longer, 1, 2).isin(*VAT_PREFIXES) & (F.substr(longer, F.lit(3)) == shorter))


def minor_units(value: Column, currency: Column) -> Column:
    """An amount rounded half up to the decimals of its currency."""
    return F.when(currency.isin(*THREE_DECIMALS), F.round(value, 3)).otherwise(F.round(value, 2)).cast("decimal(38,3)")


def mixed_amount(text: Column) -> Column:
    """An amount where a comma is the decimal mark if there is one, points part thousands beside it, to two decimals."""
    plain = F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text)
    return F.round(F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast("decimal(38,6)"), 2).cast("decimal(38,2)")


def printed_forms(value: Column) -> Column:
    """All ways in which an amount is printed with two decimals: English, German, French, Swiss and without groups."""
    english = F.format_number(value.cast("decimal(38,2)"), 2)
    swap = lambda a, b: F.translate(english, ",.", a + b)
    return F.array_distinct(
        F.array(
            english, swap(".", ","), swap(" ", ","), swap("\u00a0", ","), swap("\u202f", ","), swap("'", "."), swap("\u2019", "."),
            F.replace(english, F.lit(","), F.lit("")), F.replace(swap(".", ","), F.lit("."), F.lit("")),
        )
    )


def is_printed(text: Column, forms: Column) -> Column:
    """Whether one of the forms stands in the text without a figure, or a mark and a figure, next to it."""
    return F.exists(forms, lambda f: F.regexp_like(text, F.concat(F.lit(r"(?<!\d)(?<!\d[.,])\Q"), f, F.lit(r"\E(?![.,]?\d)"))))
