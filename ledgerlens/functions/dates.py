"""Dates in running text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import is_european, is_us
from ledgerlens.functions.text import fold, is_blank
from ledgerlens.functions.words import CREDIT_NOTE, MONTHS, TITLE_LINES

# The five forms of a date; the numbers are the groups of year, month and day.
YMD = (r"(?U)\b(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\b", 1, 3, 4)
CJK = (r"(\d{4})年(\d{1,2})月(\d{1,2})日", 1, 2, 3)
NUMERIC = (r"(?U)\b(\d{1,2})([/.\-])(\d{1,2})\2(\d{4}|\d{2})\b", 4, 3, 1)
DAY_MONTH = (r"(?U)\b(\d{1,2})(?:st|nd|rd|th|er|º|\.)?[\s\-]+(?:de\s+)?([^\W\d_]{3,})\.?,?[\s\-]+(?:de\s+)?(\d{4}|\d{2})\b", 3, 2, 1)
MONTH_DAY = (r"(?U)\b([^\W\d_]{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b", 3, 1, 2)
_MONTH_MAP = [x for kv in MONTHS.items() for x in kv]


def days_of_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is no such day."""
    fine = year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= days_of_month(year, month))
    return F.when(fine, F.make_date(year, month, day))


def full_year(year: Column) -> Column:
    """Below 70 is in the 2000s, below 100 in the 1900s, however many figures were written."""
    return year + F.when(year < 70, 2000).when(year < 100, 1900).otherwise(0)


def month_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, _MONTH_MAP)), fold(name))


def starts(text: Column, pattern: str) -> Column:
    """Where the matches of a pattern begin: what lies between them, and they themselves, add up to it."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    matched = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    return F.transform(
        matched,
        lambda _, i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(matched, F.lit(1), i), F.lit(0), lambda s, x: s + x),
    )


def _matches(text: Column, form: tuple[str, int, int, int], rank: int) -> Column:
    pattern, y, m, d = form
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    number = lambda c: c.try_cast("int")
    named = form in (DAY_MONTH, MONTH_DAY)
    zipped = F.arrays_zip(starts(text, pattern).alias("start"), group(0).alias("matched"), group(y).alias("y"), group(m).alias("m"), group(d).alias("d"), group(2).alias("mark"))

    def read(x: Column) -> Column:
        year = full_year(number(x["y"]))
        month = month_of(x["m"]) if named else number(x["m"])
        first = real_date(year, month, number(x["d"]))
        options = [first, real_date(year, number(x["d"]), number(x["m"]))] if form is NUMERIC else [first]
        dates = F.array_distinct(F.filter(F.array(*options), lambda o: o.isNotNull()))
        if form is NUMERIC:
            dates = F.when((x["mark"] == "-") & (F.length(x["y"]) == 2), F.slice(dates, 1, 0)).otherwise(dates)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["matched"].alias("matched"), dates.alias("dates"))

    return F.transform(zipped, read)


def date_readings(text: Column) -> Column:
    """``ARRAY<STRUCT<start, rank, matched, dates>>`` in the order of the text: each date with its readings that are real days.

    A date in figures has two, day first and then month first; two figures of a year after hyphens make no date.
    """
    found = F.concat(*[_matches(text, f, k) for k, f in enumerate((YMD, CJK, NUMERIC, DAY_MONTH, MONTH_DAY))])
    return F.array_sort(F.filter(found, lambda x: F.size(x["dates"]) > 0))


def pick_reading(dates: Column, order: Column) -> Column:
    """The last reading if the month comes first, else the first one."""
    return F.when(order == "MDY", F.try_element_at(dates, F.lit(-1))).otherwise(F.get(dates, F.lit(0)))


def date_order(text: Column) -> Column:
    """DMY, MDY or null: what the dates in figures of a document show, else what the signs of its country say."""
    numbers = lambda k: F.transform(F.regexp_extract_all(text, F.lit(NUMERIC[0]), F.lit(k)), lambda x: x.cast("int"))
    pairs = F.arrays_zip(numbers(1).alias("a"), numbers(3).alias("b"))
    day_first = F.exists(pairs, lambda p: (p["a"] > 12) & (p["b"] <= 12))
    month_first = F.exists(pairs, lambda p: (p["b"] > 12) & (p["a"] <= 12))
    us, eu = is_us(text), is_european(text)
    return (
        F.when(day_first & ~month_first, "DMY").when(month_first & ~day_first, "MDY").when(day_first & month_first, None).when(us & ~eu, "MDY").when(eu & ~us, "DMY")
    )


def find_dates(text: Column, order: Column | None = None) -> Column:
    """``ARRAY<STRUCT<date, matched, ambiguous>>``; ambiguous are two readings without an order."""
    order = F.lit(None).cast("string") if order is None else order
    return F.transform(
        date_readings(text),
        lambda r: F.struct(pick_reading(r["dates"], order).alias("date"), r["matched"].alias("matched"), (order.isNull() & (F.size(r["dates"]) > 1)).alias("ambiguous")),
    )


def normalize_date(raw: Column, order: Column | None = None) -> Column:
    """The first date of a text, or null."""
    return F.get(find_dates(raw, order), F.lit(0))["date"]


def is_credit_note(text: Column) -> Column:
    """Whether one of the first lines that are not blank has the title of a credit note."""
    head = F.slice(F.filter(F.split(text, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: ~is_blank(x)), 1, TITLE_LINES)
    return F.array_join(head, "\n").rlike(CREDIT_NOTE)


def compact_date(x: Column) -> Column:
    """A date written as eight figures, as in XML invoices."""
    return F.when(x.rlike(r"^\d{8}$"), real_date(F.substring(x, 1, 4).cast("int"), F.substring(x, 5, 2).cast("int"), F.substring(x, 7, 2).cast("int")))


def printed_dates(day: Column) -> Column:
    """The ways in which a date is printed in figures."""
    return F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "d/M/yyyy", "d.M.yyyy")])
