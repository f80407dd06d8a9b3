"""The queries of the core and their SQL. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import amounts as A
from ledgerlens.functions import dates as D
from ledgerlens.functions import text as T
from ledgerlens.functions.words import AMOUNT_FIELDS, FIELDS
from ledgerlens.operators import jobs, labels, metrics, moments, replies
from ledgerlens.operators.lines import block_flags, lines_of, paired_rows
from ledgerlens.operators.resolve import extract
from ledgerlens.plans.render import invoices
from ledgerlens.plans.pipeline import run
from ledgerlens.plans.runtime import Stages, first_delivery, spread, table
from ledgerlens.sources import documents as sources
from ledgerlens.sources.tables import read_recordings, upsert, write_recordings
from ledgerlens.streaming.monitor import signals as monitor_signals
from ledgerlens.streaming.monitor import windowed

Spark = SparkSession


def extracted(spark: Spark, folder: str) -> DataFrame:
    """Text in, ten typed fields out, on invoices rendered from all orders."""
    done = extract(spread(invoices(spark, folder)), candidates=False)
    value = lambda f: F.col(f"fields.{f}.value").cast("decimal(18,2)") if f in AMOUNT_FIELDS else F.col(f"fields.{f}.value")
    least = F.array_min(F.array(*[F.col(f"fields.{f}.confidence") for f in FIELDS]))
    return done.select("o_orderkey", *[value(f).alias(f) for f in FIELDS], least.alias("least_confidence"))


def flagship(spark: Spark, folder: str) -> DataFrame:
    """The query of ``entry``."""
    return extracted(spark, folder)


def lines_report(spark: Spark, folder: str) -> DataFrame:
    """Lines, lines in customer blocks and label-value pairs of each rendered invoice."""
    df = invoices(spark, folder).withColumn("l", lines_of(F.col("pages")))
    df = df.withColumn("inside", block_flags(F.col("l")))
    own = F.filter("l", lambda x, i: ~F.get(F.col("inside"), i))
    df = df.withColumn("own", own)
    return df.select(
        "o_orderkey", F.size("l").alias("n_lines"), F.size(F.filter("inside", lambda x: x)).alias("block_lines"), F.size(paired_rows(F.col("own"))).alias("pairs")
    )


def once(spark: Spark, folder: str) -> DataFrame:
    """Each extraction once: the first delivery holds."""
    return first_delivery(table(spark, folder, "extractions"), "extraction_id", "ingested_at", ["client_id", "used", *FIELDS], Stages(spark))


def normalised(spark: Spark, folder: str) -> DataFrame:
    """Every text and id field of the extractions in its normal form."""
    e = once(spark, folder)
    v = lambda f: F.col(f"{f}.value")
    return e.select(
        "extraction_id", *[T.normalize_text(v(f)).alias(f) for f in ("supplier_name", "invoice_number", "customer_name")],
        *[A.normalize_tax_id(v(f)).alias(f) for f in ("tax_id", "customer_tax_id")],
        F.coalesce(A.same_tax_id(A.normalize_tax_id(v("tax_id")), A.normalize_tax_id(v("customer_tax_id"))), F.lit(False)).alias("one_party"),
    )


def candidate_values(spark: Spark, folder: str) -> DataFrame:
    """Amounts, tax ids and names of all candidates, typed, with the flags of their format.

    ``amount``, ``ambiguous`` and ``token`` are of the last amount of a total, ``amounts`` has all; dates are in ``candidate_dates``.
    """
    c = table(spark, folder, "candidates").where("candidate_id is not null").select("candidate_id", "field", "raw").distinct()
    of = lambda field, typed: F.when(F.col("field") == field, typed)
    found = c.where(F.col("field").isin("total_amount", "tax_id", "supplier_name")).withColumn("amounts", of("total_amount", A.find_amounts(F.col("raw"))))
    found = found.withColumn("a", F.try_element_at("amounts", F.lit(-1)))
    return found.select(
        "candidate_id", F.col("a.value").cast("decimal(18,2)").alias("amount"), F.col("a.ambiguous").alias("ambiguous"), F.col("a.token").alias("token"),
        "field", "amounts", of("tax_id", A.normalize_tax_id(F.col("raw"))).alias("tax_id"), of("supplier_name", T.normalize_text(F.col("raw"))).alias("name"),
    )


def date_values(spark: Spark, folder: str) -> DataFrame:
    """The first date in the raw text of each date candidate, and whether it can be read in two ways."""
    c = table(spark, folder, "candidates").where("field = 'invoice_date' and candidate_id is not null").select("candidate_id", "raw").distinct()
    return c.withColumn("d", F.get(D.find_dates(F.col("raw")), F.lit(0))).select("candidate_id", F.col("d.date").alias("day"), F.col("d.matched").alias("matched"), F.col("d.ambiguous").alias("ambiguous"))


def currency_scan(spark: Spark, folder: str) -> DataFrame:
    """Currencies named in all documents: how often, and in how many documents."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(A.find_currencies(F.col("text"))).alias("c"))
    return docs.groupBy(F.col("c.code").alias("code"), F.col("c.ambiguous").alias("ambiguous")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def ingest_status(spark: Spark, folder: str) -> DataFrame:
    """Of each document whether it can be read, and its length after cleaning."""
    df = sources.from_text(table(spark, folder, "documents").select("doc_id", "text"))
    return df.select("doc_id", "error", F.length(F.get("pages", F.lit(0))).cast("bigint").alias("chars"))


def request_log(spark: Spark, folder: str) -> DataFrame:
    """What the log keeps of each document: its length and the first 16 figures of its hash."""
    return table(spark, folder, "documents").where("text is not null").select(
        "doc_id", F.length("text").cast("bigint").alias("chars"), F.substring(F.sha2("text", 256), 1, 16).alias("document_hash")
    )


def credit_notes(spark: Spark, folder: str) -> DataFrame:
    """Documents with the title of a credit note, with the order of their dates and their decimals."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", D.is_credit_note(F.col("text")).alias("credit_note"), D.date_order(F.col("text")).alias("date_order"), A.has_three_decimals(F.col("text")).alias("three_decimals"))


def reply_check(spark: Spark, folder: str) -> DataFrame:
    """Of each recorded reply text whether it is strict, and how many candidates it has."""
    r = table(spark, folder, "llm_responses").where("response_id is not null and text is not null").groupBy("response_id").agg(F.min_by("text", "received_at").alias("text"))
    c = r.select("response_id", replies.is_strict(F.col("text")).alias("strict"), replies.reply_candidates(F.col("text")).alias("c"))
    return c.select("response_id", "strict", F.when(F.col("strict"), sum((F.col(f"c.{f}.raw").isNotNull().cast("int") for f in FIELDS), F.lit(0))).alias("candidates"))


def reply_misses(spark: Spark, folder: str) -> DataFrame:
    """Extractions of each client without a recorded reply."""
    e = table(spark, folder, "extractions").where("extraction_id is not null").select("extraction_id", "client_id").distinct()
    r = table(spark, folder, "llm_responses").where("recorded and extraction_id is not null").select("extraction_id")
    return replies.missed(e, r, "extraction_id").groupBy("client_id").agg(F.count("*").alias("misses"))


def hybrid(spark: Spark, folder: str) -> DataFrame:
    """The cascade over rendered invoices: those in the third layout lose their total line, and every second one of them has a reply."""
    df = spread(invoices(spark, folder))
    cut = F.transform("pages", lambda p: F.regexp_replace(p, r"(?s)SUMMARY.*$", ""))
    df = df.withColumn("pages", F.when(F.col("layout") == 2, cut).otherwise(F.col("pages"))).withColumn("request_key", F.md5(F.col("o_orderkey").cast("string")))
    found = lambda v: F.struct(F.lit(v).alias("value"), F.lit(v).alias("evidence"))
    reply = {"invoice_date": found("1999-09-09"), "currency": found("EUR")}
    made = F.to_json(F.struct(*[reply.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})
    known = df.where((F.col("layout") == 2) & (F.pmod(F.col("o_orderkey"), F.lit(2)) == 0)).select("request_key", made.alias("text"))
    done = run(df, "hybrid", known, cut=Stages(spark).cut)
    return done.select("o_orderkey", "used", F.size("warnings").alias("n_warnings"), F.col("fields.total_amount.confidence").alias("total_confidence"), F.col("fields.invoice_number.value").alias("invoice_number"))


def agreement(spark: Spark, folder: str) -> DataFrame:
    """Each candidate against the extraction that it belongs to, field by field: ``candidate_id, used, field, predicted, expected, ok``."""
    c = table(spark, folder, "candidates").where("candidate_id is not null").select("candidate_id", "extraction_id", "field", "raw").distinct()
    e = once(spark, folder)
    of = F.create_map(*[x for f in ("invoice_date", "total_amount", "supplier_name", "tax_id") for x in (F.lit(f), F.col(f"{f}.value"))])
    j = c.join(e, "extraction_id").withColumn("expected", F.try_element_at(of, F.col("field")))
    return j.select("candidate_id", "used", "field", F.col("raw").alias("predicted"), "expected", metrics.values_match(F.col("field"), F.col("raw"), F.col("expected")).alias("ok"))


def field_stats(spark: Spark, folder: str) -> DataFrame:
    """Counts, rate, precision and recall of each field."""
    s = metrics.field_stats(agreement(spark, folder))
    return s.select("field", "total", "exact", "predicted", "expected", "hits", *[F.round(c, 9).alias(c) for c in ("rate", "precision", "recall")])


def failure_lines(spark: Spark, folder: str) -> DataFrame:
    return metrics.failures(agreement(spark, folder), "candidate_id")


def cases_once(spark: Spark, folder: str) -> DataFrame:
    """Each case once, last delivery, with the status that most often goes with its invoice number (the first by name if tied)."""
    stages = Stages(spark)
    one = stages.cut(first_delivery(table(spark, folder, "cases"), "case_id", "loaded_at", ["source", "split", "difficulty", "expected", "notes"], stages, last=True))
    votes = one.where("expected.invoice_number is not null and expected.verdict is not null").groupBy(F.col("expected.invoice_number").alias("number"), F.col("expected.verdict").alias("guess")).count()
    best = votes.groupBy("number").agg(F.min(F.struct(-F.col("count"), "guess")).alias("b")).select("number", "b.guess")
    return one.withColumn("number", F.col("expected.invoice_number")).join(best, "number", "left").withColumn("verdict", F.col("expected.verdict"))


def confusion(spark: Spark, folder: str) -> DataFrame:
    return metrics.confusion(cases_once(spark, folder).where("verdict is not null"), "verdict", "guess")


def tags(spark: Spark, folder: str) -> DataFrame:
    return metrics.by_tag(cases_once(spark, folder), "difficulty", F.coalesce(F.col("verdict") == F.col("guess"), F.lit(False)))


def source_roll_up(spark: Spark, folder: str) -> DataFrame:
    df = cases_once(spark, folder).withColumn("config", F.coalesce("split", F.lit("none")))
    return metrics.roll_up(df, "config", "source", cases=F.count("*"), agreed=F.count_if(F.col("verdict") == F.col("guess")))


def quality_gate(spark: Spark, folder: str) -> DataFrame:
    """Sources whose dev or test cases agree less than their training cases do."""
    df = cases_once(spark, folder).where("source is not null and split is not null")
    ok = F.coalesce(F.col("verdict") == F.col("guess"), F.lit(False)).cast("double")
    of = lambda cond, name: F.avg(F.when(cond, ok)).alias(name)
    stats = Stages(spark).cut(df.groupBy(F.col("source").alias("name")).agg(of(F.col("split") != "train", "now"), of(F.col("split") == "train", "base")))
    side = lambda c: stats.where(F.col(c).isNotNull()).select("name", F.col(c).alias("agreement"))
    return metrics.gate(side("now"), side("base"), ["agreement"]).select("name", "metric", F.round("value", 9).alias("value"), F.round("least", 9).alias("least"))


def latency(spark: Spark, folder: str) -> DataFrame:
    """Calls of each model, mean and 95th percentile by nearest rank; lost measurements (null, 0, -1) are no calls."""
    r = first_delivery(table(spark, folder, "llm_responses"), "response_id", "received_at", ["model", "latency_ms"], Stages(spark))
    m = metrics.calls(r.withColumn("latency_ms", F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), "latency_ms", "model")
    return m.withColumn("mean_ms", F.round("mean_ms", 6))


def monitor(spark: Spark, folder: str) -> DataFrame:
    """Events by hour and kind, with the mean of their value."""
    return windowed(table(spark, folder, "events"), "ts", "event_type", n=F.count("*"), mean_value=F.round(F.avg("value"), 6))


def scenarios(spark: Spark, folder: str) -> DataFrame:
    """Scenario, reference date and half of every order, dealt out for each customer."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return labels.halves(labels.with_scenario(o, "o_orderkey", "day", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "scenario", "reference_date", "half")


def repeated_labels(spark: Spark, folder: str) -> DataFrame:
    """Labels of the same supplier, total and tax that come more than once."""
    c = table(spark, folder, "cases").where("case_id is not null").select("case_id", "expected.supplier_name", "expected.total_amount", "expected.tax_amount").distinct()
    return labels.repeated(c, "supplier_name", "total_amount", "tax_amount")


def arithmetic(spark: Spark, folder: str) -> DataFrame:
    """Labels of each split whose subtotal and tax make the total, and those where they don't."""
    e = lambda f: F.col(f"expected.{f}").try_cast("decimal(18,4)")
    c = table(spark, folder, "cases").where("case_id is not null").groupBy("case_id").agg(F.max_by(F.struct("split", "expected"), "loaded_at").alias("r")).select("r.*")
    ok = labels.adds_up(e("subtotal_amount"), e("tax_amount"), e("total_amount"))
    return c.groupBy("split").agg(F.count_if(ok).alias("adds_up"), F.count_if(~ok).alias("differs"), F.count_if(ok.isNull()).alias("unknown"))


def printed_check(spark: Spark, folder: str) -> DataFrame:
    """Of each field of the extractions how many values are printed in their own evidence."""
    e = once(spark, folder)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), labels.printed(f, F.col(f"{f}.value"), F.col(f"{f}.evidence")).alias("ok")) for f in FIELDS])
    long = e.select(F.inline(rows)).where("value is not null")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("ok").alias("printed"))


def latest_deliveries(spark: Spark, folder: str) -> DataFrame:
    """The responses' tokens with the later delivery written over the first one, where it has a value."""
    r = table(spark, folder, "llm_responses").where("response_id is not null").select("response_id", "received_at", "input_tokens", "output_tokens")
    pick = lambda by, name: r.groupBy("response_id").agg(by(F.struct("input_tokens", "output_tokens"), "received_at").alias("r")).select("response_id", "r.*")  # noqa: E731, ARG005
    return upsert(pick(F.min_by, "old"), pick(F.max_by, "new"), "response_id")


def requests(spark: Spark, folder: str) -> DataFrame:
    """Request bodies made from all orders in twelve forms, sound and faulty, and what is read of them."""
    k = F.pmod(F.col("o_orderkey"), F.lit(12))
    forms = (
        '{"document":{"text":"No %d"}}', '{"document":{"text":"No %d","media_type":"text/plain"},"config":{"max_age_days":9},"reference_date":"2024-02-29"}',
        '{"document":{"base64":"SW52b2ljZQ=="},"config":null}', '{"document":{"text":5}}', '{"document":{"text":"x","more":1}}', '{"document":{"text":"x"},"config":7}',
        '{"document":{"text":"x","base64":"SQ=="}}', '{"document":{}}', '{"document":{"text":"x"},"reference_date":"2023-02-29"}', '{"document":{"base64":"%%%"}}', '{"document":{"text":"x"},"extra":1}', 'no json',
    )
    body = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        made = F.format_string(form, F.col("o_orderkey")) if "%d" in form else F.lit(form)
        body = F.when(k == i, made).otherwise(body)
    done = sources.from_requests(table(spark, folder, "orders").select("o_orderkey", body.alias("body")))
    return done.select("o_orderkey", "text", F.decode("content", "UTF-8").alias("content"), "media_type", "config", "reference_date", "error")


def pdf_rows(spark: Spark, folder: str) -> DataFrame:
    """All documents as bytes, a third of them as PDF for a reader that parts pages at form feeds and fails on every second one; and their pages and errors."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    pdf = F.pmod("doc_id", F.lit(3)) == 0
    head = F.when(F.pmod("doc_id", F.lit(2)) == 0, "%PDF-1.7 broken ").otherwise("%PDF-1.7 ")
    rows = d.withColumns({
        "content": F.when(pdf, F.concat(head, F.coalesce("text", F.lit("")), F.lit("\x0cend"))).otherwise(F.col("text")).cast("binary"),
        "media_type": F.when(F.pmod("doc_id", F.lit(5)) == 1, "image/png").when(F.pmod("doc_id", F.lit(5)) == 2, "text/x-log; charset=utf-8"),
    })

    def reader(content: bytes) -> list[str]:
        if content[9:15] == b"broken":
            raise ValueError
        return content[9:].decode().split("\x0c")

    done = sources.with_pdf_pages(sources.from_bytes(rows), reader)
    return done.select("doc_id", "media_type", "error", (F.element_at("pages", -1) == "end").alias("has_end"))


def recordings(spark: Spark, folder: str) -> DataFrame:
    """Reply texts written as recordings and read back, by model: how many, how many keys, and their characters."""
    r = table(spark, folder, "llm_responses").where("text is not null and request_key is not null and model is not null").withColumn("asked_model", F.col("model"))
    path = f"{Stages(spark).root}/recordings"
    write_recordings(r.select("request_key", "asked_model", "text", "model", "input_tokens", "output_tokens", "latency_ms", "cache_read_tokens", "cache_write_tokens", "recorded"), path)
    back = read_recordings(spark, path)
    return back.groupBy("asked_model").agg(F.count("*").alias("n"), F.count_distinct("request_key").alias("keys"), F.sum(F.length("text")).alias("chars"), F.sum("input_tokens").alias("input_tokens"))


def text_functions(spark: Spark, folder: str) -> DataFrame:
    """Small text functions over all extractions: the part of a name before a comma, figures, page of the evidence, money by currency."""
    e = once(spark, folder)
    name, amount = F.col("supplier_name.value"), F.col("total_amount.value")
    pages = F.array(F.lit("first page"), F.coalesce("supplier_name.evidence", F.lit("")))
    return e.select(
        "extraction_id", T.before_comma(name).alias("short_name"), T.western_digits(F.translate(amount, "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("figures"),
        T.page_of(pages, F.col("supplier_name.evidence")).alias("page"), A.minor_units(amount.try_cast("decimal(38,6)"), F.when(F.pmod("extraction_id", F.lit(2)) == 0, "KWD").otherwise("EUR")).alias("money"),
        (F.length(T.request_id(F.when(F.pmod("extraction_id", F.lit(2)) == 0, F.concat(F.lit("id-"), F.col("extraction_id").cast("string"))).otherwise("no id"))) == 32).alias("new_id"),
    )


def results_of_cases(spark: Spark, folder: str) -> DataFrame:
    """Cases as results of a run: the split is the configuration, the vote on the invoice number the prediction."""
    return cases_once(spark, folder).select(
        "case_id", F.coalesce("split", F.lit("none")).alias("config"), F.col("verdict").alias("expected"), F.col("guess").alias("predicted"), F.length("notes").alias("latency_ms"),
        F.when(F.col("guess").isNull(), "heuristic:fallback").otherwise("heuristic").alias("used"),
    )


def comparison(spark: Spark, folder: str) -> DataFrame:
    """The splits side by side."""
    r = Stages(spark).cut(results_of_cases(spark, folder))
    stats = r.groupBy("config").agg(F.count("*").alias("total"), F.count_if(F.col("expected") == F.col("predicted")).alias("exact"))
    return metrics.comparison(r, stats, "config")


def micro_rate(spark: Spark, folder: str) -> DataFrame:
    """The exact rate over all fields of the candidates, by extractor."""
    m = metrics.micro_rate(metrics.field_stats(agreement(spark, folder), "used"), "used")
    return m.withColumn("field_exact_rate", F.round("field_exact_rate", 9))


def verdict_lines(spark: Spark, folder: str) -> DataFrame:
    return metrics.verdict_failures(results_of_cases(spark, folder))


def fallbacks(spark: Spark, folder: str) -> DataFrame:
    """Configurations that the gate stops for their fallbacks; that of the training cases may have some."""
    s = metrics.summary(results_of_cases(spark, folder), "config")
    return metrics.fallback_gate(s.select(F.when(F.col("config") == "train", "heuristic@train").otherwise(F.col("config")).alias("name"), "fallbacks"))


def split_check(spark: Spark, folder: str) -> DataFrame:
    """What is wrong with the splits of the cases, as faults of each kind."""
    c = cases_once(spark, folder)
    found = metrics.split_faults(c, c.where("split is not null").select("case_id", "split"))
    return found.groupBy("fault").agg(F.count("*").alias("faults"), F.sum("n").alias("n"))


def samples(spark: Spark, folder: str) -> DataFrame:
    """Five orders of each status, the first by key."""
    return labels.sample_of_each(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), 5, "o_orderkey", "o_orderstatus", seed=None)


def bills(spark: Spark, folder: str) -> DataFrame:
    """Spanish bills made of all orders: some lack a tax line, the customer or the date in words; their labels and discrepancies."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("sub"))
    es = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    low, high = F.round(F.col("sub") * F.lit("0.05").cast("decimal(4,2)"), 2).cast("decimal(18,2)"), F.round(F.col("sub") * F.lit("0.21").cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    o = o.withColumns({"low": F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit(0).cast("decimal(18,2)")).otherwise(low), "high": high})
    word = F.element_at(F.array(*map(F.lit, jobs.SPANISH_MONTHS)), F.month("day"))
    o = o.withColumns({"words": F.concat(F.dayofmonth("day").cast("string"), F.lit(" de "), word, F.lit(" de "), F.year("day").cast("string")), "all": F.col("sub") + F.col("low") + F.col("high")})
    gt = {
        "C1": F.lit(" Luz del Norte S.A. "), "F1": F.concat(F.lit("LN"), F.col("o_orderkey").cast("string")), "F3": F.col("words"), "J5": es("all"), "C2": F.lit("A12345678"), "J4": es("sub"),
        "N5": es("low"), "N8": es("high"), "A1": F.concat(F.lit("Casa "), F.col("o_custkey").cast("string")), "A2": F.format_string("%08dZ", F.col("o_custkey")),
    }
    text = F.concat_ws(
        "\n", F.lit("Luz del\nNorte S.A."), F.lit("CIF A-12345678"), F.concat(F.lit("Factura "), gt["F1"]), F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.date_format("day", "dd/MM/yyyy")).otherwise(F.col("words")),
        F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.concat(gt["A1"], F.lit(" NIF "), gt["A2"])), F.concat(F.lit("Base "), es("sub")),
        F.concat(F.lit("IVA 5% "), es("low")), F.when(F.pmod("o_orderkey", F.lit(11)) != 0, F.concat(F.lit("IVA 21% "), es("high"))), F.concat(F.lit("Total "), es("all"), F.lit(" €")),
    )
    done = jobs.idsem(o.withColumns({"gt": F.create_map(*[x for k, v in gt.items() for x in (F.lit(k), v)]), "text": text, "template": F.lit(2)}))
    e = lambda f: F.col(f"expected.{f}").alias(f)
    return done.select("o_orderkey", *map(e, ("supplier_name", "invoice_date", "total_amount", "tax_amount", "customer_name", "customer_tax_id")), F.size("discrepancies").alias("n_discrepancies"), "checks", F.array_contains("tags", "textual_spanish_date").alias("textual"))


def signals(spark: Spark, folder: str) -> DataFrame:
    """The named signals over the events as a log of documents, by day."""
    e = table(spark, folder, "events").where("ts is not null")
    log = e.select(
        "ts", F.when(F.col("event_type") == "purchase", "REVIEW").otherwise("PASS").alias("verdict"), F.when(F.pmod("event_id", F.lit(7)) == 0, "heuristic:fallback").otherwise("heuristic").alias("used"),
        F.pmod("event_id", F.lit(1000)).alias("latency_ms"), F.when(F.pmod("event_id", F.lit(4)) == 0, 0.3).otherwise(1.0).alias("least_confidence"),
    )
    found = windowed(log, "ts", width="1 day", **monitor_signals())
    return found.drop("p95_ms")


_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"
_ONCE = "(SELECT extraction_id, min_by(struct_pack({columns}), ingested_at) AS r FROM extractions WHERE extraction_id IS NOT NULL GROUP BY extraction_id)"


def _text_sql(x: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace({x}, '{_BLANKS}+', ' ', 'g'), '^[ :;,]+|[ :;,]+$', '', 'g'), '')"


def _tax_sql(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace(upper({x}), '^\s*\([A-Z]{{2}}\)\s*', ''), '(?s){_BLANKS}+(?:NIF|CIF|VAT|TVA|IVA|UID|NIP|TIN|TRN|UST-?IDNR)\b.*$', '')"
    return rf"regexp_extract(regexp_replace({cut}, '{_BLANKS}|[.\-]', '', 'g'), '^([A-Z0-9]+)', 1)"


def _accept_sql(c: str) -> str:
    prefixes = "'" + "','".join("AT BE BG CY CZ DE DK EE EL ES FI FR GB HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK XI CH NO".split()) + "'"
    return (
        f"CASE WHEN (substr({c},1,2) IN ({prefixes}) AND length({c}) BETWEEN 10 AND 14) OR regexp_full_match({c}, '[A-Z]\\d{{7}}[A-Z0-9]|\\d{{8}}[A-Z]|\\d{{9}}') "
        f"OR (length({c}) BETWEEN 8 AND 20 AND length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 5) THEN {c} END"
    )


def _same_sql(a: str, b: str) -> str:
    prefixes = "'" + "','".join("AT BE BG CY CZ DE DK EE EL ES FI FR GB HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK XI CH NO".split()) + "'"
    longer, shorter = f"CASE WHEN length({a}) > length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) > length({b}) THEN {b} ELSE {a} END"
    return f"coalesce({a} = {b} OR (substr({longer},1,2) IN ({prefixes}) AND substr({longer},3) = {shorter}), false)"


_SOFT = lambda x: rf"regexp_replace(trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '{_BLANKS}+', ' ', 'g')), '[.,]+$', '')"
_AGREE = f"""
    WITH c AS (SELECT DISTINCT candidate_id, extraction_id, field, raw FROM candidates WHERE candidate_id IS NOT NULL),
    e AS {_ONCE.format(columns="used := used, invoice_date := invoice_date.value, total_amount := total_amount.value, supplier_name := supplier_name.value, tax_id := tax_id.value")},
    j AS (SELECT candidate_id, r.used AS used, field, raw AS predicted,
        CASE field WHEN 'invoice_date' THEN r.invoice_date WHEN 'total_amount' THEN r.total_amount WHEN 'supplier_name' THEN r.supplier_name WHEN 'tax_id' THEN r.tax_id END AS expected
        FROM c JOIN e USING (extraction_id)),
    a AS (SELECT *, CASE WHEN predicted IS NULL AND expected IS NULL THEN true WHEN predicted IS NULL OR expected IS NULL THEN false
        WHEN field = 'total_amount' THEN coalesce(try_cast(predicted AS DECIMAL(38,6)) = try_cast(expected AS DECIMAL(38,6)), false)
        ELSE {_SOFT('predicted')} = {_SOFT('expected')} END AS ok FROM j)
"""
_CASES = """
    WITH one AS (SELECT case_id, max_by(struct_pack(source := source, split := split, difficulty := difficulty, expected := expected), loaded_at) AS r FROM cases WHERE case_id IS NOT NULL GROUP BY case_id),
    votes AS (SELECT r.expected.invoice_number AS number, r.expected.verdict AS guess, count(*) AS n FROM one WHERE r.expected.invoice_number IS NOT NULL AND r.expected.verdict IS NOT NULL GROUP BY 1, 2),
    best AS (SELECT number, guess FROM votes QUALIFY row_number() OVER (PARTITION BY number ORDER BY n DESC, guess) = 1),
    k AS (SELECT case_id, r.source AS source, r.split AS split, r.difficulty AS difficulty, r.expected.verdict AS verdict, guess FROM one LEFT JOIN best ON number = r.expected.invoice_number)
"""
_CASES_NOTES = _CASES.replace("difficulty := difficulty,", "difficulty := difficulty, notes := notes,") + """,
    m AS (SELECT case_id, coalesce(r.split, 'none') AS config, r.expected.verdict AS verdict, guess, length(r.notes) AS ms FROM one LEFT JOIN best ON number = r.expected.invoice_number)
"""
_FIELD_KINDS = " AND ".join(
    f"(json_type(text, '$.{f}') = 'NULL' OR (json_type(text, '$.{f}') = 'OBJECT' AND list_sort(json_keys(text, '$.{f}')) = ['evidence', 'value'] "
    f"AND json_type(text, '$.{f}.value') = 'VARCHAR' AND json_type(text, '$.{f}.evidence') = 'VARCHAR'))"
    for f in FIELDS
)
_FIELD_COUNT = " + ".join(f"CASE WHEN trim(coalesce(json_extract_string(text, '$.{f}.value'), '')) <> '' THEN 1 ELSE 0 END" for f in FIELDS)
_FIELD_LIST = "[" + ", ".join(f"'{f}'" for f in sorted(FIELDS)) + "]"

QUERIES = {
    "extract_rendered": extracted,
    "line_blocks": lines_report,
    "normal_texts_and_ids": normalised,
    "candidate_amounts": candidate_values,
    "candidate_dates": date_values,
    "currency_scan": currency_scan,
    "ingest_status": ingest_status,
    "request_log": request_log,
    "document_signals": credit_notes,
    "reply_strict": reply_check,
    "reply_misses": reply_misses,
    "hybrid_cascade": hybrid,
    "field_stats": field_stats,
    "failure_lines": failure_lines,
    "confusion": confusion,
    "by_tag": tags,
    "by_source": source_roll_up,
    "quality_gate": quality_gate,
    "latency_p95": latency,
    "monitor_windows": monitor,
    "scenario_and_halves": scenarios,
    "repeated_labels": repeated_labels,
    "arithmetic_check": arithmetic,
    "printed_check": printed_check,
    "upsert_deliveries": latest_deliveries,
    "requests_strict": requests,
    "pdf_rows": pdf_rows,
    "recordings_back": recordings,
    "text_functions": text_functions,
    "comparison_table": comparison,
    "micro_rate": micro_rate,
    "verdict_lines": verdict_lines,
    "fallback_gate": fallbacks,
    "split_faults": split_check,
    "samples_of_each": samples,
    "label_bills": bills,
    "monitor_signals": signals,
    "p2_found": moments.p2_found,
    "p2_zones": moments.p2_zones,
    "p2_estimated": moments.p2_estimated,
}

ORACLES: dict[str, str] = {
    "extract_rendered": """
        SELECT o_orderkey, printf('Nation %02d Works Ltd', c_nationkey) AS supplier_name, printf('INV-%08d', o_orderkey) AS invoice_number, cast(o_orderdate AS DATE) AS invoice_date,
            cast(o_totalprice AS DECIMAL(18,2)) AS total_amount, CASE WHEN o_orderkey % 3 = 2 THEN 'GBP' ELSE 'EUR' END AS currency, printf('GB%09d', (o_custkey * 7919) % 1000000000) AS tax_id,
            sub AS subtotal_amount, cast(o_totalprice AS DECIMAL(18,2)) - sub AS tax_amount, printf('Harbour House %d GmbH', o_custkey) AS customer_name, printf('DE%09d', o_custkey) AS customer_tax_id,
            1.0::DOUBLE AS least_confidence
        FROM (SELECT *, cast(round(cast(cast(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) * 100.0 / 121 / 100, 2) AS DECIMAL(18,2)) AS sub FROM orders) JOIN customer ON c_custkey = o_custkey
    """,
    "line_blocks": """
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 15 ELSE 18 END AS n_lines, CASE o_orderkey % 3 WHEN 2 THEN 2 ELSE 3 END AS block_lines,
            CASE o_orderkey % 3 WHEN 2 THEN 3 ELSE 0 END AS pairs
        FROM orders JOIN customer ON c_custkey = o_custkey
    """,
    "normal_texts_and_ids": f"""
        WITH e AS {_ONCE.format(columns=", ".join(f"{f} := {f}.value" for f in FIELDS))},
        t AS (SELECT extraction_id, {", ".join(f"{_text_sql(f'r.{f}')} AS {f}" for f in ("supplier_name", "invoice_number", "customer_name"))}, {_tax_sql("r.tax_id")} AS a, {_tax_sql("r.customer_tax_id")} AS b FROM e),
        u AS (SELECT extraction_id, supplier_name, invoice_number, customer_name, {_accept_sql("a")} AS tax_id, {_accept_sql("b")} AS customer_tax_id FROM t)
        SELECT *, {_same_sql("tax_id", "customer_tax_id")} AS one_party FROM u
    """,
    "ingest_status": f"""
        SELECT doc_id, CASE WHEN strlen(text) > 5242880 THEN 'document_too_large' WHEN text IS NULL OR NOT regexp_matches(text, '[^' || substr('{_BLANKS}', 2)) THEN 'unreadable_document' END AS error,
            CASE WHEN strlen(text) <= 5242880 AND regexp_matches(text, '[^' || substr('{_BLANKS}', 2)) THEN length(replace(text, chr(13) || chr(10), chr(10))) END AS chars
        FROM documents
    """,
    "request_log": "SELECT doc_id, length(text) AS chars, substr(sha256(text), 1, 16) AS document_hash FROM documents WHERE text IS NOT NULL",
    "reply_strict": f"""
        WITH r AS (SELECT response_id, min_by(text, received_at) AS text FROM llm_responses WHERE response_id IS NOT NULL AND text IS NOT NULL GROUP BY response_id),
        s AS (SELECT *, CASE WHEN NOT json_valid(text) THEN false WHEN json_type(text) <> 'OBJECT' THEN false ELSE coalesce(
            list_sort(list_filter(json_keys(text), lambda k: k NOT IN ('issuer_country', 'date_format'))) = {_FIELD_LIST} AND {_FIELD_KINDS}, false) END AS strict FROM r)
        SELECT response_id, strict, CASE WHEN strict THEN {_FIELD_COUNT} END AS candidates FROM s
    """,
    "reply_misses": """
        WITH e AS (SELECT DISTINCT extraction_id, client_id FROM extractions WHERE extraction_id IS NOT NULL)
        SELECT client_id, count(*) AS misses FROM e WHERE extraction_id NOT IN (SELECT extraction_id FROM llm_responses WHERE recorded AND extraction_id IS NOT NULL) GROUP BY client_id
    """,
    "hybrid_cascade": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'hybrid:heuristic_only' WHEN o_orderkey % 2 = 0 THEN 'hybrid:llm_called' ELSE 'heuristic:fallback' END AS used,
            CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 1 THEN 1 ELSE 0 END AS n_warnings, CASE WHEN o_orderkey % 3 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS total_confidence,
            printf('INV-%08d', o_orderkey) AS invoice_number
        FROM orders JOIN customer ON c_custkey = o_custkey
    """,
    "field_stats": f"""{_AGREE}
        SELECT field, count(*) AS total, count(*) FILTER (ok) AS exact, count(predicted) AS predicted, count(expected) AS expected, count(*) FILTER (ok AND predicted IS NOT NULL) AS hits,
            round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS rate, round(count(*) FILTER (ok AND predicted IS NOT NULL)::DOUBLE / nullif(count(predicted), 0), 9) AS precision,
            round(count(*) FILTER (ok AND predicted IS NOT NULL)::DOUBLE / nullif(count(expected), 0), 9) AS recall
        FROM a GROUP BY field
    """,
    "failure_lines": f"""{_AGREE}
        SELECT candidate_id, field, field || ': expected ' || coalesce(expected, 'None') || ', got ' || coalesce(predicted, 'None') AS message FROM a WHERE NOT ok
    """,
    "confusion": f"""{_CASES}
        SELECT s AS expected, count(*) FILTER (guess = 'PASS') AS "PASS", count(*) FILTER (guess = 'FAIL') AS "FAIL", count(*) FILTER (guess = 'REVIEW') AS "REVIEW"
        FROM (SELECT unnest(['PASS', 'FAIL', 'REVIEW']) AS s) LEFT JOIN k ON verdict = s GROUP BY s
    """,
    "by_tag": f"{_CASES} SELECT tag, count(*) AS cases, count(*) FILTER (verdict = guess) AS agreed FROM (SELECT unnest(difficulty) AS tag, verdict, guess FROM k) GROUP BY tag",
    "by_source": f"""{_CASES}
        SELECT coalesce(split, 'none') || '/all' AS name, count(*) AS cases, count(*) FILTER (verdict = guess) AS agreed FROM k GROUP BY 1
        UNION ALL SELECT coalesce(split, 'none') || '/' || source, count(*), count(*) FILTER (verdict = guess) FROM k WHERE source IS NOT NULL GROUP BY 1
    """,
    "quality_gate": f"""{_CASES},
        n AS (SELECT source AS name, avg(CASE WHEN verdict = guess THEN 1.0 ELSE 0.0 END) AS v FROM k WHERE source IS NOT NULL AND split IS NOT NULL AND split <> 'train' GROUP BY 1),
        b AS (SELECT source AS name, avg(CASE WHEN verdict = guess THEN 1.0 ELSE 0.0 END) AS v FROM k WHERE source IS NOT NULL AND split = 'train' GROUP BY 1)
        SELECT name, 'agreement' AS metric, round(n.v, 9) AS value, round(b.v, 9) AS least FROM n LEFT JOIN b USING (name) WHERE b.v IS NULL OR n.v < b.v - 1e-9
    """,
    "latency_p95": """
        WITH o AS (SELECT min_by(struct_pack(model := model, ms := latency_ms), received_at) AS r FROM llm_responses WHERE response_id IS NOT NULL GROUP BY response_id),
        m AS (SELECT r.model AS model, CASE WHEN r.ms > 0 THEN r.ms END AS ms FROM o)
        SELECT model, count(*) AS documents, count(ms) AS calls, round(avg(ms), 6) AS mean_ms, cast(quantile_disc(ms, 0.95) AS DOUBLE) AS p95_ms FROM m GROUP BY model
    """,
    "monitor_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "scenario_and_halves": """
        WITH o AS (SELECT o_orderkey, cast(o_orderdate AS DATE) AS day, (row_number() OVER w - 1) % 4 AS turn, ntile(2) OVER w AS h FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT o_orderkey, ['valid', 'old_date', 'currency', 'customer'][turn + 1] AS scenario, day + CASE WHEN turn = 1 THEN 120 ELSE 30 END::INT AS reference_date,
            CASE WHEN h = 1 THEN 'dev' ELSE 'test' END AS half FROM o
    """,
    "repeated_labels": """
        WITH c AS (SELECT DISTINCT case_id, expected.supplier_name AS supplier_name, expected.total_amount AS total_amount, expected.tax_amount AS tax_amount FROM cases WHERE case_id IS NOT NULL)
        SELECT supplier_name, total_amount, tax_amount, count(*) AS n FROM c WHERE supplier_name IS NOT NULL AND total_amount IS NOT NULL AND tax_amount IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    """,
    "arithmetic_check": """
        WITH c AS (SELECT max_by(struct_pack(split := split, e := expected), loaded_at) AS r FROM cases WHERE case_id IS NOT NULL GROUP BY case_id),
        k AS (SELECT r.split AS split, abs(try_cast(r.e.subtotal_amount AS DECIMAL(18,4)) + try_cast(r.e.tax_amount AS DECIMAL(18,4)) - try_cast(r.e.total_amount AS DECIMAL(18,4))) <= 0.01 AS ok FROM c)
        SELECT split, count(*) FILTER (ok) AS adds_up, count(*) FILTER (NOT ok) AS differs, count(*) FILTER (ok IS NULL) AS unknown FROM k GROUP BY split
    """,
    "upsert_deliveries": """
        SELECT response_id, coalesce(n.i, o.i) AS input_tokens, coalesce(n.t, o.t) AS output_tokens FROM (
            SELECT response_id, min_by(struct_pack(i := input_tokens, t := output_tokens), received_at) AS o, max_by(struct_pack(i := input_tokens, t := output_tokens), received_at) AS n
            FROM llm_responses WHERE response_id IS NOT NULL GROUP BY response_id)
    """,
    "requests_strict": """
        SELECT o_orderkey, CASE k WHEN 0 THEN 'No ' || o_orderkey WHEN 1 THEN 'No ' || o_orderkey END AS text, CASE k WHEN 2 THEN 'Invoice' END AS content, CASE k WHEN 1 THEN 'text/plain' END AS media_type,
            CASE k WHEN 1 THEN '{"max_age_days":9}' END AS config, CASE k WHEN 1 THEN DATE '2024-02-29' END AS reference_date, CASE WHEN k > 2 THEN 'invalid_request' END AS error
        FROM (SELECT o_orderkey, o_orderkey % 12 AS k FROM orders)
    """,
    "pdf_rows": f"""
        WITH d AS (SELECT doc_id, text, doc_id % 3 = 0 AS pdf, doc_id % 2 = 0 AS broken, CASE doc_id % 5 WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS kind, strlen(text) > 5242880 AS large FROM documents)
        SELECT doc_id, CASE WHEN pdf THEN 'application/pdf' ELSE kind END AS media_type,
            CASE WHEN pdf THEN CASE WHEN strlen(coalesce(text, '')) > 5242800 THEN 'document_too_large' WHEN broken THEN 'unreadable_document' END
                WHEN large THEN 'document_too_large' WHEN kind = 'image/png' THEN 'unsupported_media_type' WHEN text IS NULL OR NOT regexp_matches(text, '[^' || substr('{_BLANKS}', 2)) THEN 'unreadable_document' END AS error,
            CASE WHEN pdf AND NOT broken THEN true WHEN NOT pdf AND kind <> 'image/png' AND regexp_matches(text, '[^' || substr('{_BLANKS}', 2)) THEN false END AS has_end
        FROM d
    """,
    "recordings_back": """
        SELECT model AS asked_model, count(*) AS n, count(DISTINCT request_key) AS keys, sum(length(text))::BIGINT AS chars, sum(input_tokens)::BIGINT AS input_tokens
        FROM llm_responses WHERE text IS NOT NULL AND request_key IS NOT NULL AND model IS NOT NULL GROUP BY model
    """,
    "text_functions": f"""
        WITH e AS {_ONCE.format(columns="n := supplier_name.value, ev := supplier_name.evidence, a := total_amount.value")}
        SELECT extraction_id, trim(split_part(split_part(r.n, ',', 1), ' / ', 1)) AS short_name, r.a AS figures,
            CASE WHEN r.ev IS NULL OR NOT regexp_matches(r.ev, '[^' || substr('{_BLANKS}', 2)) THEN NULL WHEN contains('first page', {_SOFT("r.ev").replace("regexp_replace(", "(", 1).replace(", '[.,]+$', '')", ")")}) THEN 1 ELSE 2 END::INT AS page,
            CASE WHEN extraction_id % 2 = 0 THEN round(try_cast(r.a AS DECIMAL(38,6)), 3) ELSE round(try_cast(r.a AS DECIMAL(38,6)), 2) END::DECIMAL(38,3) AS money, extraction_id % 2 = 1 AS new_id
        FROM e
    """,
    "comparison_table": f"""{_CASES_NOTES}
        SELECT config, count(*) AS cases, round_even(count(*) FILTER (verdict = guess) * 100.0 / count(*), 0)::INT || '%' AS fields, round_even(count(*) FILTER (verdict = guess) * 100.0 / count(*), 0)::INT || '%' AS verdicts,
            count(ms) AS llm_calls, count(*) FILTER (guess IS NULL) AS fallbacks, round(avg(ms), 6) AS mean_ms, cast(quantile_disc(ms, 0.95) AS DOUBLE) AS p95_ms
        FROM m GROUP BY config
    """,
    "micro_rate": f"""{_AGREE}
        SELECT used, round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS field_exact_rate FROM a GROUP BY used
    """,
    "verdict_lines": f"""{_CASES_NOTES}
        SELECT case_id, 'verdict' AS field, 'verdict: expected ' || coalesce(verdict, 'None') || ', got ' || coalesce(guess, 'None') AS message FROM m WHERE verdict IS DISTINCT FROM guess
    """,
    "fallback_gate": f"""{_CASES_NOTES}
        SELECT config AS name, 'fallbacks' AS metric, count(*)::DOUBLE AS value, 0.0::DOUBLE AS least FROM m WHERE guess IS NULL AND config <> 'train' GROUP BY config
    """,
    "split_faults": f"""{_CASES},
        none AS (SELECT 'in no split' AS fault, count(*) AS faults, 0::BIGINT AS n FROM k WHERE split IS NULL HAVING count(*) > 0),
        per AS (SELECT source, split, count(*) AS size FROM k WHERE split IS NOT NULL GROUP BY ALL),
        un AS (SELECT source, max(size) - CASE WHEN count(*) < (SELECT count(DISTINCT split) FROM k) THEN 0 ELSE min(size) END AS n FROM per GROUP BY source)
        FROM none UNION ALL SELECT 'uneven', count(*), sum(n)::BIGINT FROM un WHERE n > 1 HAVING count(*) > 0
    """,
    "samples_of_each": "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 5",
    "label_bills": """
        WITH o AS (SELECT o_orderkey, o_custkey, cast(o_orderdate AS DATE) AS day, cast(o_totalprice AS DECIMAL(18,2)) AS sub,
            CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE cast(round(cast(o_totalprice AS DECIMAL(18,2)) * 0.05::DECIMAL(4,2), 2) AS DECIMAL(18,2)) END AS low, cast(round(cast(o_totalprice AS DECIMAL(18,2)) * 0.21::DECIMAL(4,2), 2) AS DECIMAL(18,2)) AS high FROM orders)
        SELECT o_orderkey, 'Luz del Norte S.A.' AS supplier_name, strftime(day, '%Y-%m-%d') AS invoice_date, cast(cast(sub + low + high AS DECIMAL(38,2)) AS VARCHAR) AS total_amount,
            CASE WHEN o_orderkey % 11 <> 0 THEN cast(cast(low + high AS DECIMAL(38,2)) AS VARCHAR) END AS tax_amount, CASE WHEN o_orderkey % 7 <> 0 THEN 'Casa ' || o_custkey END AS customer_name,
            CASE WHEN o_orderkey % 7 <> 0 THEN printf('%08dZ', o_custkey) END AS customer_tax_id, (CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END)::INT AS n_discrepancies,
            true AS checks, o_orderkey % 5 <> 0 AS textual
        FROM o
    """,
    "monitor_signals": """
        SELECT date_trunc('day', ts) AS window_start, count(*) AS documents, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 9) AS review_rate,
            round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 9) AS fallback_rate, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 9) AS ungrounded_rate
        FROM events WHERE ts IS NOT NULL GROUP BY 1
    """,
}
