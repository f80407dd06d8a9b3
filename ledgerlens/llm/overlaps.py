"""Problem 5: invoices of the evaluation splits that are also in the training split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.words import ACCENTED, UNACCENTED
from ledgerlens.llm.splits import source_key
from ledgerlens.plans.runtime import HOT_KEYS, Stages, first_delivery, is_small, table

#: Least cosine of two labels that are compared field by field.
COSINE = 0.72
#: Rows of one inverted list that one task reads at most; longer lists are cut on both sides.
LIST = 5_000
#: Letters of a number that is taken to be of one invoice whatever its date.
LONG = 7
FIELDS = ("supplier_name", "invoice_number", "invoice_date", "total_amount", "currency", "tax_id", "subtotal_amount", "tax_amount", "customer_name", "customer_tax_id")
AMOUNTS = ("total_amount", "subtotal_amount", "tax_amount")
#: Squared weight of each field, in the order in which they are indexed: amounts first, for numbers recur among unrelated invoices.
#: Weights are fixed, so that neither the number of rows nor a group of near-copies changes a cosine.
WEIGHTS = {
    "total_amount": 2.5, "subtotal_amount": 2.0, "tax_amount": 1.5, "number": 2.0, "date": 1.5, "customer_tax_id": 1.0, "customer": 1.0, "tax_id": 0.5, "supplier": 0.5,
}


def plain(text: Column) -> Column:
    return F.replace(F.translate(F.lower(text), ACCENTED, UNACCENTED), F.lit("ß"), F.lit("ss"))


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def amount(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(18,4)")


def labels(cases: DataFrame, stages: Stages) -> DataFrame:
    """``case_id, side (train or eval), split, source`` and the fields of ``expected`` in one form.

    Of a case delivered several times the last delivery holds. Cases with another or no split are left out, and so are
    those with neither number nor date, which nothing could prove to be the same invoice.
    """
    flat = cases.select("case_id", "loaded_at", "split", "source", *[F.col(f"expected.{f}").alias(f) for f in FIELDS])
    last = first_delivery(flat, "case_id", "loaded_at", ["split", "source", *FIELDS], stages, last=True).where(F.col("split").isin("train", "dev", "test"))
    # Letters and figures that are taken for each other become one; what a copy adds goes.
    number = F.translate(F.regexp_replace(plain(F.col("invoice_number")), r"\(?\bcopy\b\)?|\(?\bcopia\b\)?", ""), "oilsbz", "011582")
    date = F.regexp_extract("invoice_date", r"^\s*(\d{4}[-/.]?\d{2}[-/.]?\d{2})", 1)
    words = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(F.replace(plain(F.col(c)), F.lit("."), F.lit("")), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) > 1)), " ")
    tight = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", "")
    return last.select(
        "case_id", F.when(F.col("split") == "train", "train").otherwise("eval").alias("side"), "split", "source",
        or_null(F.regexp_replace(number, r"[^\p{L}\p{N}]+", "")).alias("number"),
        or_null(F.regexp_replace(F.when(date != "", date).otherwise(plain(F.col("invoice_date"))), r"[^\p{L}\p{N}]+", "")).alias("date"),
        *[F.round(amount(F.col(f)), 2).alias(f) for f in AMOUNTS],
        or_null(tight("tax_id")).alias("tax_id"), or_null(tight("customer_tax_id")).alias("customer_tax_id"), or_null(tight("currency")).alias("currency"),
        or_null(words("supplier_name")).alias("supplier"), or_null(words("customer_name")).alias("customer"),
    ).where("number is not null or date is not null")


KEYS = ("number", "date", *AMOUNTS, "tax_id", "customer_tax_id", "currency", "supplier", "customer")


def classes(rows: DataFrame) -> DataFrame:
    """Adds ``cid``, 16 bytes: equal for cases whose labels are equal in every field, so that copies are compared once."""
    whole = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in KEYS])
    return rows.withColumn("cid", F.unhex(F.md5(whole)))


def vector() -> Column:
    """``ARRAY<STRUCT<kind, term, w>>`` of a label, of length one: each field is a term, names are a term for each word; amounts of zero are none."""
    there = {f: F.col(f).isNotNull() & (F.col(f) != 0) if f in AMOUNTS else F.col(f).isNotNull() for f in WEIGHTS}
    square = reduce(lambda a, b: a + b, [F.when(there[f], w).otherwise(0.0) for f, w in WEIGHTS.items()])

    def one(kind: int, field: str) -> Column:
        c, made = F.col(field), lambda x, w: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(field), x).alias("term"), F.sqrt(w / square).alias("w"))
        if field in ("supplier", "customer"):
            words = F.array_distinct(F.split(c, " "))
            return F.transform(words, lambda w: made(w, F.lit(WEIGHTS[field]) / F.size(words)))
        return F.when(there[field], F.array(made(c, F.lit(WEIGHTS[field]))))

    none = F.array().cast("array<struct<kind:int,term:bigint,w:double>>")
    return F.concat(*[F.coalesce(one(k, f), none) for k, f in enumerate(WEIGHTS)])


def cosine_join(rows: DataFrame, least: float, stages: Stages) -> DataFrame:
    """``(a, b, cosine, x, y)``: pairs of a ``train`` and an ``eval`` row with a cosine of at least ``least`` or a link in common.

    ``rows`` is a staged table of ``cid, side, x, v ARRAY<STRUCT<kind, term, w>>, links ARRAY<BIGINT>``, each ``(cid, side)`` once;
    ``x`` comes out for both sides. Vectors have length one; a term is of one kind. Terms are in one global order: those of the longest lists
    last, all others by kind. A vector is indexed by its first terms only, up to where what remains can give no more than ``least``:
    neither by the norm of the remaining weights, nor by their sum against the greatest weight that terms of their kind have on
    the other side. Two vectors with that cosine share an indexed term of both, so no pair is lost; links are
    listed whole. For all candidates the exact dot product is taken. Lists of more than LIST rows are cut on both
    sides, and each piece of the one meets each piece of the other, so no term is a burden to one task.
    """
    counted = rows.select("side", F.inline("v")).groupBy("term").agg(
        F.count("*").alias("n"), F.max("kind").alias("kind"), *[F.max(F.when(F.col("side") == s, F.col("w"))).alias(s) for s in ("train", "eval")]
    )
    counted = stages.cut(counted)
    most = {r["kind"]: r for r in counted.groupBy("kind").agg(F.max("train").alias("train"), F.max("eval").alias("eval")).collect()}  # one row a kind
    longest = counted.where(F.col("n") > LIST).orderBy(F.desc("n"), "term").limit(HOT_KEYS)
    hot = longest.groupBy().agg(F.coalesce(F.collect_list("term"), F.array().cast("array<bigint>")).alias("hot"))  # one row
    other = {"train": "eval", "eval": "train"}
    of_kind = lambda side: F.create_map(*[F.lit(x) for k, r in most.items() for x in (k, float(r[other[side]] or 0))]) if most else F.lit(None).cast("map<int,double>")
    bound = F.when(F.col("side") == "train", of_kind("train")).otherwise(of_kind("eval"))
    greatest = lambda t: F.coalesce(F.try_element_at(bound, t["kind"]), F.lit(0.0))
    # Last terms first; a term is indexed if it and those after it can still give ``least``.
    order = F.transform("v", lambda t: F.struct(F.array_contains("hot", t["term"]).alias("hot"), t["kind"].alias("kind"), t["term"].alias("term"), t["w"].alias("w"), greatest(t).alias("m")))
    start = F.struct(F.lit(0.0).alias("square"), F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, t: Column) -> Column:
        square, total = s["square"] + t["w"] * t["w"], s["sum"] + t["w"] * t["m"]
        fits = F.least(F.sqrt(square), total) >= least - 1e-9
        return F.struct(square.alias("square"), total.alias("sum"), F.when(fits, F.array_append(s["kept"], t["term"])).otherwise(s["kept"]).alias("kept"))

    indexed = F.aggregate(F.reverse(F.array_sort(order)), start, step)["kept"]
    ready = rows.crossJoin(F.broadcast(hot)).withColumn("keys", F.array_distinct(F.concat(indexed, "links")))
    listed = stages.cut(ready.select("cid", "side", F.explode("keys").alias("key")))
    sizes = listed.groupBy("key").agg(*[F.ceil(F.count_if(F.col("side") == s) / LIST).cast("int").alias(s) for s in other])
    long = stages.cut(sizes.where("train > 0 and eval > 0 and train + eval > 2"))
    cut = listed.join(F.broadcast(long) if is_small(long) else long, "key", "left")
    pieces = lambda side: F.coalesce(F.col(side), F.lit(1))
    mine = lambda side: F.pmod(F.xxhash64("cid"), pieces(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), pieces(side) - 1))
    index = cut.where("side = 'train'").select(F.col("cid").alias("a"), "key", mine("train").alias("i"), every("eval").alias("j"))
    asked = cut.where("side = 'eval'").select(F.col("cid").alias("b"), "key", every("train").alias("i"), mine("eval").alias("j"))
    pairs = index.join(asked, ["key", "i", "j"]).select("a", "b").distinct()
    of = lambda side, cid, v: rows.where(F.col("side") == side).select(F.col("cid").alias(cid), F.col("v").alias(v), F.col("links").alias(f"l{v}"))
    both = pairs.join(of("train", "a", "va"), "a").join(of("eval", "b", "vb"), "b")
    dot = F.aggregate("va", F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.get(F.filter("vb", lambda u: u["term"] == t["term"]), F.lit(0))["w"], F.lit(0.0)))
    near = both.select("a", "b", dot.alias("cosine"), F.arrays_overlap("lva", "lvb").alias("linked")).where((F.col("cosine") >= least - 1e-9) | F.col("linked"))
    value = lambda side, cid, x: rows.where(F.col("side") == side).select(F.col("cid").alias(cid), F.col("x").alias(x))
    return near.select("a", "b", "cosine").join(value("train", "a", "x"), "a").join(value("eval", "b", "y"), "b")


def day_month(x: Column, y: Column) -> Column:
    """Whether two dates in figures differ by day and month in exchanged places."""
    return (F.length(x) == 8) & (F.concat(F.substring(x, 1, 4), F.substring(x, 7, 2), F.substring(x, 5, 2)) == y)


def same_invoice() -> Column:
    """Whether the labels ``x`` and ``y`` describe one invoice.

    Equal numbers need parties that agree, and an equal, missing or mistyped date and an amount other than zero, or an equal total under a long number. A number with a
    slip needs an equal date. With a missing number, date, total and parties must agree.
    """
    x, y = (lambda k: F.col(f"x.{k}")), (lambda k: F.col(f"y.{k}"))
    false = lambda c: F.coalesce(c, F.lit(False))
    near = lambda k, most: false(F.levenshtein(x(k), y(k), most).between(0, most))
    swapped = lambda k: false((F.levenshtein(x(k), y(k), 2) == 2) & (F.array_sort(F.split(x(k), "")) == F.array_sort(F.split(y(k), ""))))
    equal = lambda k: false(x(k) == y(k))
    either_null = lambda k: x(k).isNull() | y(k).isNull()
    number, date = equal("number"), equal("date")
    long_number = false(F.length(x("number")) >= LONG)
    number_slip = ~number & (near("number", 1) | swapped("number")) & false(F.least(F.length(x("number")), F.length(y("number"))) >= 3)
    exchanged = false(day_month(x("date"), y("date")))
    date_slip = either_null("date") | near("date", 1) | swapped("date") | exchanged
    money = lambda k: false(F.abs(F.abs(x(k)) - F.abs(y(k))) <= 0.02) | false((F.abs(x(k) - y(k)) <= 0.5) & ((x(k) == F.round(x(k))) | (y(k) == F.round(y(k)))))
    amounts = reduce(lambda a, b: a + b, [money(k).cast("int") for k in AMOUNTS])
    # Taxes of zero agree between most invoices and prove nothing where the date differs.
    paid = reduce(lambda a, b: a + b, [(money(k) & false((x(k) != 0) | (y(k) != 0))).cast("int") for k in AMOUNTS])
    tax = near("tax_id", 1) | swapped("tax_id")
    # A slip or two, a blank at another place or a legal form left out.
    name = lambda k: false(F.levenshtein(x(k), y(k)) <= F.greatest(F.lit(3), F.length(x(k)) / 4))
    supplier = name("supplier")
    customer = name("customer") | near("customer_tax_id", 1)
    supplier_differs = ~either_null("supplier") & ~supplier & ~tax
    customer_differs = ~either_null("customer") & ~customer
    parties = (supplier | tax | customer) & ~supplier_differs & ~customer_differs
    total = money("total_amount")
    return (
        (number & date & parties & ((amounts >= 1) | either_null("total_amount") | long_number))
        | (number & date_slip & parties & (paid >= 1))
        | (number & long_number & parties & (total | (amounts >= 2)))
        | (number_slip & date & parties & (amounts >= 1))
        | (either_null("number") & date & parties & (total | (amounts >= 2)))
    )


def hashed(kind: str, *parts: Column) -> Column:
    """A key of one ``kind``, null if a part is null. Two keys that fall together only add a candidate."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.xxhash64(F.lit(kind), *parts))


def slip_keys(kept: str, slipped: str) -> Column:
    """Keys of which two strings share one if ``kept`` is equal and ``slipped`` has one letter changed, added or lost, or the same letters in another order."""
    whole, letters = F.col(slipped), F.array_join(F.array_sort(F.split(slipped, "")), "")
    without = lambda i: F.concat(F.substring(whole, F.lit(1), i - 1), F.substring(whole, i + 1, F.length(whole)))
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole))), lambda i: F.xxhash64(F.lit("less"), F.col(kept), without(i)))
    return F.array_distinct(F.concat(F.array(F.xxhash64(F.lit("less"), F.col(kept), whole), F.xxhash64(F.lit("order"), F.col(kept), letters)), less))


def link_keys() -> Column:
    """``ARRAY<BIGINT>``: of any two labels of a train and an eval row that ``same_invoice()`` can accept, both have one of these
    keys; there is no rarity and no threshold.

    Its branches need one of these: an equal number and the date or one amount; an equal date and a slip in the number; an equal date
    beside a missing number, and the total or both other amounts. Equal amounts differ by a half at most, so they lie in the same
    or the next whole number.
    """
    number, date, probing = F.col("number"), F.col("date"), F.col("side") == "eval"
    none = F.array().cast("array<bigint>")
    # The probing side has the neighbours too.
    near = lambda k: F.when(probing, F.array(F.floor(F.abs(F.col(k)) - 0.5), F.floor(F.abs(F.col(k)) + 0.5))).otherwise(F.array(F.floor(F.abs(F.col(k)))))
    whole = {k: near(k) for k in AMOUNTS}

    def by_number(k: str) -> Column:
        return F.coalesce(F.transform(whole[k], lambda n: hashed(f"number {k}", number, n)), none)

    def by_date(kind: str) -> Column:
        total = F.transform(whole["total_amount"], lambda n: hashed(f"{kind} total", date, n))
        both = F.flatten(F.transform(whole["subtotal_amount"], lambda n: F.transform(whole["tax_amount"], lambda m: hashed(f"{kind} both", date, n, m))))
        return F.concat(F.coalesce(total, none), F.coalesce(both, none))

    # A number is missing on the train side or on the eval side, and anything is on the other.
    gone = lambda side: F.when((F.col("side") != side) | number.isNull(), by_date(f"no number, {side}")).otherwise(none)
    slips = F.when(number.isNotNull() & date.isNotNull(), slip_keys("date", "number")).otherwise(none)
    return F.array_distinct(F.array_compact(F.concat(slips, F.array(hashed("number date", number, date)), *map(by_number, AMOUNTS), gone("train"), gone("eval"))))


def overlaps(spark: SparkSession, cases: DataFrame, least: float = COSINE) -> DataFrame:
    """``(case_a, case_b, split, source, cosine)``: one row for each pair of a training case and an evaluation case of one invoice.

    Candidates are the pairs of the cosine join and all others that the check by field can accept, whatever their cosine.
    ``split`` and ``source`` are those of the evaluation case. Null labels and null fields agree with nothing; empty tables
    give an empty result; other columns are not read.
    """
    stages = Stages(spark)
    rows = stages.cut(classes(labels(cases, stages)))
    one = stages.cut(rows.dropDuplicates(["cid", "side"]).drop("case_id", "split", "source"))
    ready = stages.cut(one.select("cid", "side", F.struct(*KEYS).alias("x"), vector().alias("v"), link_keys().alias("links")), one)
    same = stages.cut(cosine_join(ready, least, stages).where(same_invoice()).select("a", "b", "cosine"), ready)
    members = lambda side, key, name: rows.where(F.col("side") == side).select(F.col("cid").alias(key), F.col("case_id").alias(name), *(["split", "source"] if side == "eval" else []))
    pairs = same.join(members("train", "a", "t"), "a").join(members("eval", "b", "e"), "b")
    return pairs.select(F.least("t", "e").alias("case_a"), F.greatest("t", "e").alias("case_b"), "split", "source", "cosine")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of cases, one in train and one in dev or test, whose labels describe the same invoice."""
    return overlaps(spark, table(spark, folder, "cases")).select("case_a", "case_b")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """``(split, source, pairs)``: overlaps of each evaluation split and source; null sources are a group."""
    found = overlaps(spark, table(spark, folder, "cases"))
    return found.groupBy("split", source_key(F.col("source")).alias("source")).agg(F.count("*").alias("pairs"))
