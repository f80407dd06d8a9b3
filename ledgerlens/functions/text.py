"""Text functions as column expressions; null in, null out unless a docstring says otherwise."""

from __future__ import annotations

import functools
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlens.functions.words import ACCENTED, UNACCENTED

SPACE = r"(?U)\s+"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def opaque(value: Column) -> Column:
    """``value`` as the optimiser can't take apart: a struct whose fields are used many times is then computed once, not inlined."""
    return let(value, lambda x: x)


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    """Null, or nothing but white space."""
    return x.isNull() | ~x.rlike(r"(?U)\S")


@functools.lru_cache(1)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """What case folding, compatibility decomposition and dropping of marks make of each character: characters that become one
    other character, those it becomes followed by those that vanish, and characters that become several. Hangul stays composed."""
    single, plain, gone, several = [], [], [], {}
    for code in range(0x110000):
        if 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xDFFF or 0x20000 <= code <= 0x2F7FF or 0x30000 <= code < 0xE0000:
            continue
        c = chr(code)
        to = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if to == c:
            continue
        if not to:
            gone.append(c)
        elif len(to) == 1:
            single.append(c)
            plain.append(to)
        else:
            several[c] = to
    return "".join(single) + "".join(gone), "".join(plain), several


def fold(x: Column) -> Column:
    """Lower case without accents, for the letters of European languages; ``fold_full`` is for all others."""
    return F.translate(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), ACCENTED, UNACCENTED)


def fold_full(x: Column) -> Column:
    """Case folding, compatibility decomposition and no combining marks, as the Unicode tables have it; all in the JVM.

    Its tables make a plan large: it is for columns that are folded once, while ``fold`` stands many times in the plan of the extraction.

    Letters that become several (sharp s, ligatures, Roman numerals) are looked up one by one, and only in texts that have one."""
    before, after, several = fold_tables()
    pattern = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in several) + "]"
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal once it is folded, not thousands of expressions
    one = F.translate(x, before, after)
    spread = F.array_join(F.transform(F.split(one, ""), lambda c: F.when(c.rlike(pattern), F.try_element_at(table, c)).otherwise(c)), "")
    return F.when(x.rlike(r"[^\x00-\x7F]") & x.rlike(pattern), spread).otherwise(one)


@F.pandas_udf(StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """The same as ``fold`` by Python's own tables; what the tests compare with."""

    def one(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Compatibility composition with runs of white space as one blank."""
    return s.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()), na_action="ignore")


def without_space(x: Column) -> Column:
    return F.regexp_replace(x, SPACE, "")


def canon(x: Column) -> Column:
    """Letters and figures only, folded: how values and evidence are compared."""
    return F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")


def squash(x: Column) -> Column:
    """Lower case with one blank between words: how evidence is found in a document."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), SPACE, " "))


def normalize_text(x: Column) -> Column:
    """One blank between words, no blank, colon, semicolon or comma at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(x, SPACE, " "), r"^[ :;,]+|[ :;,]+$", ""), F.lit(""))


def is_label(x: Column) -> Column:
    """At least one letter and no figure."""
    return x.rlike(r"\p{L}") & ~x.rlike(r"\p{N}")


def soft(x: Column) -> Column:
    """Squashed and without full stops and commas at the end: how text fields are scored."""
    return F.regexp_replace(squash(x), r"[.,]+$", "")


def western_digits(x: Column) -> Column:
    """Arabic-Indic and Persian figures as 0 to 9."""
    return F.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def before_comma(x: Column) -> Column:
    """The part before the first comma, and of that the part before a slash between blanks."""
    return strip(F.split_part(F.split_part(x, F.lit(","), F.lit(1)), F.lit(" / "), F.lit(1)))


def after_label(text: Column, label: str) -> Column:
    """The first line that is not blank after ``label`` with a colon."""
    return F.nullif(F.trim(F.regexp_extract(text, label + r":\s*\n\s*(.+)", 1)), F.lit(""))


def request_id(x: Column) -> Column:
    """The id if it is 1 to 64 plain characters, else a new one."""
    return F.when(x.rlike(r"^[A-Za-z0-9._:-]{1,64}$"), x).otherwise(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def page_of(pages: Column, snippet: Column) -> Column:
    """The first page, from 1, that has the snippet; null if none has it or the snippet is blank or null."""
    needle = squash(snippet)
    at = F.array_position(F.transform(pages, lambda p: F.contains(squash(p), needle)), True)
    return F.when(needle != "", F.nullif(at, F.lit(0).cast("bigint"))).cast("int")
