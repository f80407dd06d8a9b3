"""Problem 4: one form for text that looks the same."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator, Mapping

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.runtime import Stages, is_small, ship_code, table, with_value

# Letters of other scripts that are drawn like a Latin letter of the same case: Cyrillic, Greek, Armenian, Coptic,
# Cherokee, Lisu and Deseret letters, as the public list of confusable characters (Unicode Technical Standard 39) has them.
LETTERS = {
    "A": "АΑꓮᎪⲀ", "B": "ВΒꓐᏴⲂ", "C": "СϹꓚᏟⲤ", "D": "ꓓᎠ", "E": "ЕΕꓰᎬ", "F": "Ϝꓝ", "G": "ԌꓖᏀ", "H": "НΗꓧᎻⲎ", "I": "ІΙꓲⲒ", "J": "ЈͿꓙᎫ", "K": "КΚꓗᏦⲔ", "L": "ꓡᏞ",
    "M": "МΜꓟᎷⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ𐐄", "P": "РΡꓑᏢⲢ", "Q": "Ԛ", "R": "ꓣᎡ", "S": "ЅՏꓢᏚ", "T": "ТΤꓔᎢⲦ", "U": "Սꓴ", "V": "ѴꓦᏙ", "W": "ԜꓪᎳ", "X": "ХΧꓫⲬ", "Y": "ҮΥꓬⲨ", "Z": "ΖꓜᏃⲌ",
    "a": "аα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօⲟ𐐬", "p": "рρⲣ",
    "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уүγ",
}
# Blanks other than the plain one, marks that are drawn as a hyphen, and code points without a picture.
BLANKS = (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
HYPHENS = "‐‑‒−﹣－"
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0)
INVISIBLE_RANGES = ((0x180B, 0x180D), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F))


@functools.lru_cache(1)
def pairs() -> list[tuple[str, str]]:
    """Strings that look the same, from the fixed values above and from the decompositions of the character database.

    Of those only the ones that keep the picture count: canonical ones, width, blanks and ligatures of letters. A
    superscript, a fraction or a letter in a circle looks different. Letters and figures in another cut of type (``<font>``) look
    the same. All planes are covered.
    """
    found = [(a, b) for a, others in LETTERS.items() for b in others]
    latin = {b: a for a, b in found}
    found += [("-", x) for x in HYPHENS]
    found += [("", chr(c)) for c in INVISIBLE]
    found += [("", chr(c)) for a, b in INVISIBLE_RANGES for c in range(a, b + 1)]
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind, _, _ = (d := unicodedata.decomposition(c)).partition("> ")
        if not d or 0xAC00 <= code < 0xD7A4:
            continue
        if not kind.startswith("<"):
            found.append((c, unicodedata.normalize("NFD", c)))
            found.append((c, "".join(latin.get(x, x) for x in unicodedata.normalize("NFD", c))))
            found.append((c, unicodedata.normalize("NFC", c)))
        elif kind in ("<wide", "<narrow", "<noBreak", "<font"):
            found.append((c, unicodedata.normalize("NFKC", c)))
        elif kind == "<compat" and (code in BLANKS or 0xFB00 <= code <= 0xFB06 or 0x132 <= code <= 0x133 or 0x1C7 <= code <= 0x1CC or 0x1F1 <= code <= 0x1F3):
            found.append((c, unicodedata.normalize("NFKC", c)))
    return [(a, b) for a, b in found if a != b]


def classes(links: list[tuple[str, str]]) -> list[set[str]]:
    """Transitive classes of strings and code points, by union-find."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups: dict[str, set[str]] = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return list(groups.values())


def representatives(counts: Mapping[str, int], links: list[tuple[str, str]] | None = None) -> dict[str, str]:
    """Of each string that is rewritten, the string it becomes: the member of its class that is seen most often.

    What is invisible always goes. A string of several code points counts as its rarest one. Ties go to the shorter member, then to the one that comes first by code point.
    """
    out: dict[str, str] = {}
    for group in classes(pairs() if links is None else links):
        if "" in group:
            best = ""
        else:
            best = min(group, key=lambda x: (-min(counts.get(c, 0) for c in x), len(x), x))
        out |= {x: best for x in group if x != best and x}
    return out


class Rewriter:
    """Rewrites texts greedily, the longest match at the leftmost place first, until nothing changes.

    Invisible code points go before all else, since they may stand between a letter and its accent. So do blanks at the
    ends, for nothing of them is seen there; only plain ones stay, which are a difference.
    """

    def __init__(self, to: Mapping[str, str]):
        gone = "".join(x for x, y in to.items() if not y and len(x) == 1)
        self.gone = regex.compile(f"[{regex.escape(gone)}]+") if gone else None
        self.ends = gone + "".join(map(chr, BLANKS))
        self.automaton = ahocorasick.Automaton()
        for x, y in to.items():
            if y:
                self.automaton.add_word(x, (len(x), y))
        self.filled = len(self.automaton) > 0
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        text = text.strip(self.ends)
        if self.gone is not None:
            text = self.gone.sub("", text)
        if not self.filled:
            return text
        seen: dict[str, int] = {}
        while text not in seen:
            seen[text] = len(seen)
            out, at = [], 0
            for end, (size, new) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - size], new)
                at = end + 1
            if not out:
                return text
            text = "".join(out) + text[at:]
        # Forms that lead to each other in a circle are one: the first of them by code point.
        return min(list(seen)[seen[text] :])


def rewrite_column(spark: SparkSession, to: Mapping[str, str]) -> Callable[[Column], Column]:
    """A function of columns that rewrites strings; ``to`` is as large as the table of look-alikes and no larger."""
    ship_code(spark)
    kept: list[Rewriter] = []
    fixed = dict(to)

    @F.pandas_udf("string")
    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not kept:
            kept.append(Rewriter(fixed))
        for s in texts:
            yield s.map(kept[0], na_action="ignore")

    return rewrite


def code_point_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """How often each code point of the look-alike table occurs; at most as many rows as that table has."""
    links = pairs()
    members = sorted({c for pair in links for x in pair for c in x})
    chars = texts.select(F.explode(F.split(column, "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return {r["c"]: r["n"] for r in chars.where(F.col("c").isin(members)).collect()}


FIELDS = ("supplier_name", "customer_name", "tax_id")


def values(extractions: DataFrame) -> DataFrame:
    """``(extraction_id, field, value)`` of the three fields, each once however often it was delivered."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value")) for f in FIELDS])
    return (
        extractions.where("extraction_id is not null")
        .select("extraction_id", F.inline(each))
        .where("value is not null")
        .distinct()
    )


def forms(spark: SparkSession, extractions: DataFrame, parties: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The values, and the rewriting that the frequencies in register and values lead to.

    Empty tables, empty strings and texts of any length are fine; null values come to nothing.
    """
    rows = values(extractions)
    # Each value once: a frequent one is no evidence about the code points.
    texts = rows.select("value").union(parties.select("name")).union(parties.select("tax_id")).where("value is not null").distinct()
    return rows, rewrite_column(spark, representatives(code_point_counts(texts, "value")))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """``(extraction_id, field, value, form)`` of every value; each distinct value is rewritten once."""
    stages = Stages(spark)
    rows, rewrite = forms(spark, table(spark, folder, "extractions"), table(spark, folder, "parties"))
    form = stages.cut(rows.groupBy("value").agg(F.count("*").alias("n")).withColumn("form", rewrite("value")))
    return with_value(rows, form, "value", "n").select("extraction_id", "field", "value", "form")


def find(spark: SparkSession, extractions: DataFrame, parties: DataFrame) -> DataFrame:
    """``(extraction_id, field, party_id)``: values that look like a registered one without being any registered one."""
    rows, rewrite = forms(spark, extractions, parties)
    known = parties.where("party_id is not null").select(
        "party_id", F.inline(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("known")), F.struct(F.lit("tax_id").alias("kind"), F.col("tax_id").alias("known"))))
    ).where("known is not null")
    register = known.select("party_id", "kind", "known", rewrite("known").alias("form"))
    hint = F.broadcast if is_small(parties) else lambda x: x
    kind = F.when(F.col("field") == "tax_id", "tax_id").otherwise("name")
    # Values that are registered go first, the most frequent ones are among them; of all others only distinct ones are rewritten.
    rows = rows.withColumn("kind", kind).join(hint(register.select("kind", F.col("known").alias("value"))), ["kind", "value"], "left_anti")
    key = F.concat_ws(" ", "kind", "value")
    looked = (
        rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
        .withColumn("form", rewrite("value"))
        .join(hint(register.select("kind", "form", "party_id")), ["kind", "form"])
        .groupBy(key.alias("key")).agg(F.max("n").alias("n"), F.collect_set("party_id").alias("ids"))  # at most the parties
    )
    found = with_value(rows.select("extraction_id", "field", key.alias("key")), Stages(spark).cut(looked), "key", "n")
    return found.select("extraction_id", "field", F.explode("ids").alias("party_id")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that look like a registered name or tax id and consist of other characters."""
    return find(spark, table(spark, folder, "extractions"), table(spark, folder, "parties"))
