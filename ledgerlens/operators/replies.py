"""Recorded model replies: strict reading, candidates, and the cascade that asks for one only where it is needed."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import is_blank, let, opaque
from ledgerlens.functions.words import BRIEF_FIELDS, FIELDS
from ledgerlens.operators.lines import CANDIDATE, candidate, none
from ledgerlens.operators.resolve import resolve

# Keys that a reply may have before the fields.
PREAMBLE = ("issuer_country", "date_format")
_FOUND = "OBJECT<evidence: STRING, value: STRING>"


def is_strict(reply: Column) -> Column:
    """Whether a reply is a JSON object with exactly the ten fields, each null or a value and an evidence that are strings.

    ``from_json`` would turn numbers into strings, so the types are read off the variant.
    """
    def check(v: Column) -> Column:
        keys = F.filter(F.coalesce(F.json_object_keys(reply), F.array().cast("array<string>")), lambda k: ~k.isin(*PREAMBLE))
        exact = (F.size(keys) == len(FIELDS)) & (F.size(F.array_except(F.array(*map(F.lit, FIELDS)), keys)) == 0)
        kinds = F.array(*[F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in FIELDS])
        return exact & F.forall(kinds, lambda k: F.coalesce(k, F.lit("VOID")).isin("VOID", _FOUND))

    return F.coalesce(let(F.try_parse_json(reply), check), F.lit(False))


def reply_candidates(reply: Column) -> Column:
    """The candidates of a reply that is strict, else null; a blank value is no candidate, a blank evidence none."""
    def one(f: str) -> Column:
        value, evidence = (F.get_json_object(reply, f"$.{f}.{k}") for k in ("value", "evidence"))
        return F.when(~is_blank(value), candidate(value, F.nullif(evidence, F.lit("")), F.lit(None))).otherwise(none()).cast(CANDIDATE).alias(f)

    return opaque(F.when(is_strict(reply), F.struct(*[one(f) for f in FIELDS])))


class PromptSpec(NamedTuple):
    """What shapes a request besides the document: data, not code."""

    version: str
    system: str
    schema_json: str
    note: str | None = None

    def key(self, model: Column, text: Column) -> Column:
        """The request key of a document under this prompt."""
        return request_key(model, F.lit(self.version), F.lit(self.system), user_prompt(text, self.note), F.lit(self.schema_json))


def user_prompt(text: Column, note: str | None = None) -> Column:
    """The document between its tags, after a note if there is one."""
    body = F.concat(F.lit("<document>\n"), text, F.lit("\n</document>"))
    return F.concat(F.lit(f"{note}\n\n"), body) if note else body


def request_key(model: Column, version: Column, system: Column, user: Column, schema_json: Column) -> Column:
    """The first 32 figures of the hash over all that shapes a reply, as a JSON list with a blank after each comma."""
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.expr("null") if c is None else F.regexp_replace(quoted(c), r"^\[|\]$", "")
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[inner(c) for c in (model, version, system, user)], schema_json), F.lit("]")), 256), 1, 32)


def needs_reply(fields: str = "fields") -> Column:
    """Whether a field that was found is doubtful, or one of the six main fields is missing."""
    of = lambda f: F.col(f"{fields}.{f}.confidence")
    doubtful = [of(f).between(0.0001, 0.9999) for f in FIELDS]
    missing = [of(f) == 0 for f in BRIEF_FIELDS]
    return F.exists(F.array(*doubtful, *missing), lambda x: x)


def cascade(df: DataFrame, replies: DataFrame, key: str = "request_key", pages: str = "pages", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` (with ``candidates`` and ``fields``) with the better of its own and the reply's candidate for each field.

    Only rows that need a reply are joined; of a key that was recorded twice one row holds. ``used`` tells what happened; a missing or
    unusable reply leaves the own fields and a warning. Each side is scored against the whole document first, and what is chosen is
    scored again. ``replies`` has ``request_key`` and ``text``; it is a table like any other, joined by a shuffle unless it is small.
    All is lazy and runs on a stream as well; a batch may give ``cut``, which makes a table of the first scores, as both kinds of rows read them.
    """
    need = cut(df.withColumn("_need", needs_reply()))
    one = replies.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("text").alias("_reply"))
    asked = need.where("_need").join(one, key, "left").withColumn("_theirs", reply_candidates(F.col("_reply")))
    theirs = resolve(asked, "_theirs", pages, "_their_fields")
    usable = F.col("_theirs").isNotNull()
    better = [
        F.when(usable & (F.col(f"_their_fields.{f}.confidence") >= F.col(f"fields.{f}.confidence")), F.col(f"_theirs.{f}")).otherwise(F.col(f"candidates.{f}")).alias(f)
        for f in FIELDS
    ]
    used = F.when(usable, "hybrid:llm_called").otherwise("heuristic:fallback")
    warning = F.when(F.col("_reply").isNull(), "no reply was recorded for this request").when(~usable, "the reply does not match the schema")
    merged = resolve(theirs.withColumns({"used": used, "warnings": F.filter(F.array(warning), lambda w: w.isNotNull()), "candidates": opaque(F.struct(*better))}), "candidates", pages)
    alone = need.where(~F.col("_need")).withColumns({"used": F.lit("hybrid:heuristic_only"), "warnings": F.array().cast("array<string>")})
    columns = [*df.columns, "used", "warnings"]
    return alone.select(*columns).unionByName(merged.select(*columns))


def missed(df: DataFrame, replies: DataFrame, key: str = "request_key", most: int | None = None) -> DataFrame:
    """Rows whose request has no recorded reply; at most ``most`` if a budget of calls is given."""
    left = df.join(replies.select(key).distinct(), key, "left_anti")
    return left if most is None else left.limit(most)
