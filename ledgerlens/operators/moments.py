"""Problem 2: dates and moments in mixed forms, precisions and zones, brought to one form.

Everything is a column expression: the string is matched once against each form and rewritten to ``form|a|b|c|rest``, the
rest once to its time and zone, and zones are applied by the JVM's rules.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import real_date
from ledgerlens.functions.words import ACCENTED, MONTHS, MORE_MONTHS, UNACCENTED
from ledgerlens.plans.runtime import Stages, table, with_value

_REST = r"((?:[t ,]|$).*)$"
# The forms of dates, and how each is rewritten.
FORMS = (
    ("ymd", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _REST, "ymd|$1|$3|$4|$5"),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})(t\d.*|)$", "ymd|$1|$2|$3|$4"),
    ("num", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _REST, "num|$1|$3|$4|$5"),
    ("day", r"^(?:\p{L}+\.?,? +)?(\d{1,2})(?:st|nd|rd|th|er|º|ª|\.)?[ -]+(?:de +|of +)?(\p{L}{3,})\.?,?[ -]+(?:de +|del +)?(\d{4}|\d{2})" + _REST, "day|$1|$2|$3|$4"),
    ("mon", r"^(?:\p{L}+\.?,? +)?(\p{L}{3,})\.?[ -]+(\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4}|\d{2})" + _REST, "day|$2|$1|$3|$4"),
    ("ymd", r"^(\d{4})\s?年\s?(\d{1,2})\s?月\s?(\d{1,2})\s?日(.*)$", "ymd|$1|$2|$3|$4"),
)
TIME = (
    r"^[t ,]*(?:(?:à|a las|um|at|às|alle|o|om) +)?(\d{1,2})(?:[:h時]|(?=\d{4}(?!\d))|(?=\d{2}(?!\d)))(\d{2})(?:[:分]?(\d{2})秒?(?:[.,]\d{1,9})?)?分?"
    r" ?((?:am|pm)(?![a-z])|a\. ?m\.?|p\. ?m\.?)?(?: ?(?:uhr|h|hrs)(?![a-z]))?"
    r" ?((?:(?:z|utc|gmt)(?![a-z/]))?)((?:[+-]\d{1,2}(?::?\d{2})?)?) ?((?:[a-z]{2,5}(?![a-z/_]))?)"
    r" ?\[?((?:[a-z]+(?:/[a-z0-9_+-]+)+)?)\]?$"
)
UNIX = r"^(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:[.,]\d+)?$"
# Arabic-Indic, Persian and full-width figures, and full-width marks between them.
FIGURES = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９：／－．，＋"
# German short forms of zones that the zone database has in English only.
ALIASES = {"mez": "CET", "mesz": "CEST"}


def cleaned(raw: Column) -> Column:
    """Lower case, figures and their marks as plain ones, one plain blank between words, without blanks and marks around the text."""
    text = F.regexp_replace(F.translate(F.lower(raw), FIGURES, "0123456789" * 3 + ":/-.,+"), r"[\s\p{Z}\p{Cf}]+", " ")
    text = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\]]+$", "")
    return F.when(F.contains(text, F.lit("[")), text).otherwise(F.regexp_replace(text, r"[^\p{L}\p{N}]+$", ""))


def zone_names(spark: SparkSession) -> list[str]:
    """The region names that the JVM knows."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z or z in ("UTC", "GMT"))


def abbreviations(spark: SparkSession) -> DataFrame:
    """``(zone, abbr, offset)``: what an abbreviation means in a zone, in seconds; as the zone database has it since 2000.

    At most a few thousand rows, whatever the data.
    """
    rows = set()
    moments = [dt.datetime(y, m, 15, tzinfo=dt.UTC) for y in range(2000, 2031, 2) for m in (1, 4, 7, 10)]
    for name in zone_names(spark):
        try:
            zone = zoneinfo.ZoneInfo(name)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError):
            continue
        for at in moments:
            local = at.astimezone(zone)
            if local.tzname() and local.tzname().isalpha():
                rows.add((name, local.tzname().lower(), int(local.utcoffset().total_seconds())))
    meant: dict[tuple[str, str], set[int]] = {}
    for name, abbr, offset in rows:
        meant.setdefault((name, abbr), set()).add(offset)
    out = [(z, a, o.copy().pop()) for (z, a), o in meant.items() if len(o) == 1]
    out += [(z, alias, o) for alias, short in ALIASES.items() for z, a, o in out if a == short.lower()]
    return spark.createDataFrame(sorted(out), "zone string, abbr string, offset int")


def month_number(name: Column) -> Column:
    table_ = F.create_map(*[F.lit(x) for kv in (MORE_MONTHS | MONTHS).items() for x in kv])
    return F.try_element_at(table_, F.translate(name, ACCENTED, UNACCENTED))


def read(rows: DataFrame, raw: str, order: str) -> DataFrame:
    """Adds ``day`` (the one real date, else null), ``clock`` (seconds of the day, null without time), and of the zone
    ``offset_text``, ``abbr``, ``region`` and ``utc``; ``timed`` tells if anything follows the date; ``unix`` has the seconds
    of a Unix time.

    In figures, day and month follow ``order`` (DMY or MDY); with none, a date counts if only one reading is real or both
    are the same day.
    """
    text = F.col("_text")
    shaped = F.lit(None).cast("string")
    for _, pattern, to in reversed(FORMS):
        shaped = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, to)).otherwise(shaped)
    df = rows.withColumn("_text", cleaned(F.col(raw)))
    # Each step is a projection of its own: what later steps use more than once is computed once.
    df = df.withColumn("_f", F.split(shaped, r"\|", 5))
    f = lambda k: F.get("_f", F.lit(k))
    number = lambda c: c.try_cast("int")
    df = df.withColumns({
        "_kind": f(0), "_rest": F.trim(f(4)), "_month": month_number(f(2)), "_short": F.length(f(3)) == 2,
        **{f"_n{k}": number(f(k)) for k in (1, 2, 3)}, "_digits": F.regexp_extract("_text", UNIX, 1),
    })
    df = df.withColumns({
        "_t": F.when(F.col("_rest").rlike(TIME), F.split(F.regexp_replace("_rest", TIME, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|", 8)),
        "_year": F.col("_n3") + F.when(F.col("_short"), 2000).otherwise(0),
    })
    t = lambda k: F.get("_t", F.lit(k))
    df = df.withColumns({
        "_iso": real_date(F.col("_n1"), F.col("_n2"), F.col("_n3")),
        "_dmy": real_date(F.col("_year"), F.col("_n2"), F.col("_n1")),
        "_mdy": real_date(F.col("_year"), F.col("_n1"), F.col("_n2")),
        "_named": real_date(F.col("_year"), F.col("_month"), F.col("_n1")),
        "_h": number(t(0)), "_m": number(t(1)), "_s": F.when(t(2) == "", 0).otherwise(number(t(2))), "_half": F.substring(t(3), 1, 1),
        "_scale": F.when(F.length("_digits") <= 10, 0).when(F.length("_digits") <= 13, 3).when(F.length("_digits") <= 16, 6).otherwise(9),
    })
    one = F.when(F.col("_dmy").isNull() | F.col("_mdy").isNull() | (F.col("_dmy") == F.col("_mdy")), F.coalesce("_dmy", "_mdy"))
    by_order = F.when(F.col(order) == "DMY", F.col("_dmy")).when(F.col(order) == "MDY", F.col("_mdy")).otherwise(one)
    df = df.withColumn(
        "_hour", F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    )
    clock = F.when(F.col("_hour").between(0, 23) & F.col("_m").between(0, 59) & F.col("_s").between(0, 59), F.col("_hour") * 3600 + F.col("_m") * 60 + F.col("_s"))
    whole = F.when(F.col("_digits") != "", F.expr("substring(_digits, 1, length(_digits) - _scale)").try_cast("bigint"))
    return df.select(
        *rows.columns,
        F.when(F.col("_kind") == "ymd", F.col("_iso")).when(F.col("_kind") == "num", by_order).when(F.col("_kind") == "day", F.col("_named")).alias("day"),
        clock.alias("clock"),
        (F.col("_rest") != "").alias("timed"),
        F.nullif(t(5), F.lit("")).alias("offset_text"),
        F.nullif(t(6), F.lit("")).alias("abbr"),
        F.nullif(t(7), F.lit("")).alias("region"),
        F.coalesce(t(4) != "", F.lit(False)).alias("utc"),
        whole.alias("unix"),
    )


def offset_seconds(text: Column) -> Column:
    """Seconds of +1, +01, +0100 or +01:00; null beyond 18 hours."""
    digits = F.regexp_replace(F.substring(text, 2, 6), ":", "")
    hours = F.when(F.length(digits) <= 2, digits.cast("int")).otherwise((digits.cast("int") / 100).cast("int"))
    minutes = F.when(F.length(digits) <= 2, 0).otherwise(digits.cast("int") % 100)
    size = hours * 3600 + minutes * 60
    return F.when((size <= 18 * 3600) & (minutes < 60), F.when(F.substring(text, 1, 1) == "-", -size).otherwise(size))


#: Seconds before and after a local time at which the offset of its zone is looked up: farther than any zone is from UTC.
AROUND = 36 * 3600


def shown(moment: Column, zone: Column) -> Column:
    """The local seconds that the clocks of a region show at a moment."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(moment), zone))


def with_utc(df: DataFrame, local: str, zone: str, to: str) -> DataFrame:
    """Adds the UTC seconds of local seconds in a region; null if the clocks skipped that time or showed it twice.

    The offsets before and after, AROUND apart, are the only ones that can have held, whatever a change of the clocks comes to.
    """
    at = F.coalesce(zone, F.lit("UTC"))
    df = df.withColumns({f"_u{k}": F.col(local) - (shown(F.col(local) + x, at) - F.col(local) - x) for k, x in enumerate((-AROUND, AROUND))})
    fits = [shown(F.col(f"_u{k}"), at) == F.col(local) for k in (0, 1)]
    once = F.when(F.col("_u0") == F.col("_u1"), F.when(fits[0], F.col("_u0"))).when(fits[0] & ~fits[1], F.col("_u0")).when(fits[1] & ~fits[0], F.col("_u1"))
    return df.withColumn(to, F.when(F.col(zone).isNotNull(), once)).drop("_u0", "_u1")


def normalise(spark: SparkSession, rows: DataFrame, raw: str = "raw", zone: str = "zone", order: str = "date_order") -> DataFrame:
    """``rows`` with ``normal``: ``YYYY-MM-DD``, or the moment as ``YYYY-MM-DDTHH:MM:SSZ``, or null without one meaning.

    Null, empty, overlong and meaningless texts have none; so have zoneless times whose zone is null or unknown to the JVM,
    and local times that the clocks skipped or showed twice. An offset decides over a region beside it, an abbreviation
    means what it means in ``zone``. Repeated rows stay repeated; other columns stay as they are.
    """
    own = rows.columns
    df = with_parts(spark, rows, raw, zone, order)
    return df.select(*own, F.when(F.col("moment").isNotNull(), stamp(F.col("moment"))).when(~F.coalesce("timed", F.lit(True)), F.col("day").cast("string")).alias("normal"))


def stamp(moment: Column) -> Column:
    """UTC seconds as ``YYYY-MM-DDTHH:MM:SSZ``; null outside the years 1 to 9999."""
    of_day = F.pmod(moment, F.lit(86400))  # no timestamp is formatted, for that would use the session's zone
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60)
    return F.when(moment.between(-62135596800, 253402300799), F.concat(F.date_from_unix_date(F.floor(moment / 86400).cast("int")).cast("string"), clock))


def with_parts(spark: SparkSession, rows: DataFrame, raw: str = "raw", zone: str = "zone", order: str = "date_order") -> DataFrame:
    """``rows`` with ``day``, ``timed``, ``local`` (seconds of the local time, if a zoneless one) and ``moment`` (UTC seconds)."""
    names = zone_names(spark)
    regions = spark.createDataFrame([(n.lower(), n) for n in names], "region string, region_name string")
    df = read(rows.withColumn("_zone", F.when(F.col(zone).isin(names), F.col(zone))), raw, order)
    df = df.join(F.broadcast(regions), "region", "left")  # some 600 rows
    short = abbreviations(spark).select(F.col("zone").alias("_zone"), "abbr", F.col("offset").alias("_abbr_offset"))
    df = df.join(F.broadcast(short), ["_zone", "abbr"], "left")  # some thousand rows
    offset = F.when(F.col("offset_text").isNotNull(), offset_seconds(F.col("offset_text"))).when(F.col("utc"), 0)
    df = df.withColumns({
        "_local": F.unix_date("day").cast("bigint") * 86400 + F.col("clock"),
        "_offset": offset,
        "_stated": F.col("offset_text").isNotNull() | F.col("utc"),
        "_region": F.when(F.col("abbr").isNotNull(), None).when(F.col("region").isNotNull(), F.col("region_name")).otherwise(F.col("_zone")),
    })
    df = with_utc(df, "_local", "_region", "_by_region")
    utc = F.when(F.col("_stated"), F.col("_local") - F.col("_offset")).when(F.col("abbr").isNotNull(), F.col("_local") - F.col("_abbr_offset")).otherwise(F.col("_by_region"))
    zoneless = ~F.col("_stated") & F.col("abbr").isNull() & F.col("region").isNull()
    return df.select(
        *rows.columns, "day", "timed", F.when(zoneless, F.col("_local")).alias("local"), F.coalesce("unix", F.when(F.col("timed"), utc)).alias("moment")
    )


def dated(spark: SparkSession, folder: str) -> DataFrame:
    """``(origin, row_id, extraction_id, raw, zone, date_order)`` of all values with a date, once for each delivery's text."""
    extractions = table(spark, folder, "extractions").select(
        "extraction_id", F.col("invoice_date.value").alias("raw"), F.col("issuer_zone").alias("zone"), "date_order"
    ).where("extraction_id is not null").distinct()
    issuers = extractions.groupBy("extraction_id").agg(F.first(F.struct("zone", "date_order")).alias("i"))
    candidates = (
        table(spark, folder, "candidates").where("field = 'invoice_date' and candidate_id is not null and raw is not null")
        .select("candidate_id", "extraction_id", "raw").distinct()
        .join(issuers, "extraction_id", "left")
        .select(F.lit("candidate").alias("origin"), F.col("candidate_id").alias("row_id"), "extraction_id", "raw", "i.zone", "i.date_order")
    )
    own = extractions.where("raw is not null").select(
        F.lit("extraction").alias("origin"), F.col("extraction_id").alias("row_id"), "extraction_id", "raw", "zone", "date_order"
    )
    return own.unionByName(candidates)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """``(origin, row_id, normal)`` of each value that has exactly one meaning."""
    return normalise(spark, dated(spark, folder)).where("normal is not null").select("origin", "row_id", "normal").distinct()


#: Seconds to which local times are counted together: clocks change at multiples of it.
GRAIN = 900


def zone_violations(spark: SparkSession, pairs: DataFrame, zones: list[str], slack: int = 60) -> DataFrame:
    """``(key, zone, n, violations)`` for every candidate zone, from ``pairs (key, local, known, ingested)`` in seconds.

    ``local`` is a zoneless time; ``known`` the moment in UTC that another record states for the same event, if any;
    ``ingested`` when the record arrived. A zone's whole history of offsets is applied. It is violated by a local
    time that its clocks never showed, by one more than ``slack`` seconds off the known moment, and by one after the arrival.
    Pairs are counted by their quarter of an hour and their distance from the known moment before the zones, which are a list as long
    as the caller's, are tried, so a key with a third of all rows is no burden.
    """
    start = (F.floor(F.col("local") / GRAIN) * GRAIN).cast("bigint")
    counted = pairs.groupBy("key", start.alias("local"), (F.col("known") - F.col("local")).alias("known_in")).agg(
        F.count("*").alias("n"), F.collect_set(F.when(F.col("ingested") - F.col("local") < 2 * AROUND, F.floor((F.col("ingested") - F.col("local")) / 60))).alias("early"),
    )  # a set of at most some thousand minutes
    at = F.explode(F.array(*map(F.lit, zones)) if zones else F.array().cast("array<string>"))
    tried = counted.select("key", "local", "known_in", "n", "early", at.alias("zone"))
    for k, x in enumerate((-AROUND, AROUND)):
        tried = tried.withColumn(f"_o{k}", shown(F.col("local") + x, F.col("zone")) - F.col("local") - x)
    tried = tried.withColumns({f"_f{k}": shown(F.col("local") - F.col(f"_o{k}"), F.col("zone")) == F.col("local") for k in (0, 1)})
    # Where the clocks showed the time twice, either moment will do.
    def miss(fits: Column, offset: Column) -> Column:
        return ~fits | F.coalesce(F.abs(F.col("known_in") + offset) > slack, F.lit(False)) | F.exists("early", lambda m: m * 60 + offset < -slack)

    misses = [miss(F.col(f"_f{k}"), F.col(f"_o{k}")) for k in (0, 1)]
    return tried.groupBy("key", "zone").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(misses[0] & misses[1], F.col("n"))), F.lit(0)).alias("violations"))


def estimate_zones(spark: SparkSession, pairs: DataFrame, zones: list[str]) -> DataFrame:
    """``(key, zone, tied, n, violations)``: the zone with the fewest violations of each key; if several tie, ``zone`` is null
    and ``tied`` tells how many do.

    Rows with a null key or local time don't count; a key without rows does not come out.
    """
    counted = zone_violations(spark, pairs.where("key is not null and local is not null"), zones)
    by = counted.groupBy("key", "violations").agg(F.count("*").alias("tied"), F.min("zone").alias("zone"), F.first("n").alias("n"))
    best = by.groupBy("key").agg(F.min(F.struct("violations", "tied", "zone", "n")).alias("b"))
    return best.select("key", F.when(F.col("b.tied") == 1, F.col("b.zone")).alias("zone"), "b.tied", "b.n", "b.violations")


def zone_evidence(spark: SparkSession, folder: str, stages: Stages) -> tuple[DataFrame, list[str]]:
    """``(origin, row_id, key, local, known, ingested)`` of all zoneless times of documents that state no zone, and the candidate zones.

    ``key`` is the issuer's tax id. ``known`` is a moment that the same document states elsewhere, within a day of the local time.
    Candidates are the zones that other rows of the table state, which the time zone database bounds.
    """
    extractions = table(spark, folder, "extractions")
    parsed = stages.cut(with_parts(spark, dated(spark, folder)).select("origin", "row_id", "extraction_id", "zone", "local", "moment"))
    issuer = extractions.groupBy("extraction_id").agg(
        F.min(F.upper(F.regexp_replace(F.col("tax_id.value"), r"[^\p{L}\p{N}]", ""))).alias("key"), F.min(F.unix_seconds("ingested_at")).alias("ingested")
    )
    stated = parsed.where("moment is not null").groupBy("extraction_id").agg(F.min("moment").alias("known"))
    local = parsed.where("zone is null and moment is null and local is not null").select("origin", "row_id", "extraction_id", "local").distinct()
    near = F.when(F.abs(F.col("known") - F.col("local")) <= 86400, F.col("known"))
    rows = local.join(issuer, "extraction_id").join(stated, "extraction_id", "left").select("origin", "row_id", "key", "local", near.alias("known"), "ingested")
    zones = [r[0] for r in extractions.where(F.col("issuer_zone").isin(zone_names(spark))).select("issuer_zone").distinct().collect()]
    return stages.cut(rows), sorted(zones)


def p2_zones(spark: SparkSession, folder: str) -> DataFrame:
    """``(tax_id, zone, tied, n, violations)`` of issuers some of whose documents state no zone.

    Evidence are the zoneless times of such documents, the moments that the same document states with a zone elsewhere,
    and the times of arrival; without any that tells zones apart the zone is null.
    """
    rows, zones = zone_evidence(spark, folder, Stages(spark))
    return estimate_zones(spark, rows, zones).withColumnRenamed("key", "tax_id")


def p2_estimated(spark: SparkSession, folder: str) -> DataFrame:
    """``(origin, row_id, zone, violations, normal)``: the zoneless times that p2_found leaves out for want of a zone, converted by
    the zone that was estimated for their issuer; ``normal`` is null if its clocks skipped that time or showed it twice.

    Rows whose issuer is null or has no zone of its own (ties) do not come out.
    """
    stages = Stages(spark)
    rows, zones = zone_evidence(spark, folder, stages)
    found = stages.cut(estimate_zones(spark, rows, zones).where("zone is not null").select("key", "zone", "n", "violations"))
    df = with_utc(with_value(rows.select("origin", "row_id", "key", "local"), found, "key", "n"), "local", "zone", "_utc")
    return df.select("origin", "row_id", "zone", "violations", stamp(F.col("_utc")).alias("normal"))
