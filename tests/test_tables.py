"""Sources, replies, metrics, labels and streams on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.words import FIELDS
from ledgerlens.operators import labels as B
from ledgerlens.operators import metrics as M
from ledgerlens.operators import replies as P
from ledgerlens.sources import documents as S
from ledgerlens.sources import tables as T
from ledgerlens.streaming import monitor


def test_documents(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc d"), (2, " \n"), (3, None), (4, "x" * 5_242_881)], "id int, text string")
    got = {r["id"]: (r["error"], r["pages"]) for r in S.from_text(df).collect()}
    assert got == {1: (None, ["a\nb\nc d"]), 2: (S.UNREADABLE, None), 3: (S.UNREADABLE, None), 4: (S.TOO_LARGE, None)}
    raw = [(1, b"%PDF-1.7", "text/plain"), (2, b"hi", "text/plain; charset=utf-8"), (3, b"\xff\xfe", ""), (4, b"hi", "image/png"), (5, b" ", None), (6, b"x", "application/pdf")]
    got = {r["id"]: (r["error"], r["media_type"], r["pages"]) for r in S.from_bytes(spark.createDataFrame(raw, "id int, content binary, media_type string")).collect()}
    assert got[1] == (None, "application/pdf", None) and got[2] == (None, "text/plain", ["hi"]) and got[6][1] == "application/pdf"
    assert [got[k][0] for k in (3, 4, 5)] == [S.UNREADABLE, S.UNSUPPORTED, S.UNREADABLE]
    bodies = ['{"document":{"text":"x"},"reference_date":"2026-01-02"}', '{"document":{"text":"x","base64":"eA=="}}', '{"document":{"base64":"eA=="},"config":{"a":1}}', "no", '{"document":{"text":"x"},"other":1}', None]
    rows = S.from_requests(spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "id int, body string")).orderBy("id").collect()
    assert [r["error"] for r in rows] == [None, S.INVALID, None, S.INVALID, S.INVALID, S.INVALID]
    assert str(rows[0]["reference_date"]) == "2026-01-02" and bytes(rows[2]["content"]) == b"x" and rows[2]["config"] == '{"a":1}'
    assert spark.range(1).select(S.layout(F.lit("\na     b  \n\n\n\nc\n"))).first()[0] == "a   b\n\nc"


def test_files(spark, tmp_path):
    label = {"document": "a.txt", "source": "s", "reference_date": "2026-01-02", "config": None, "difficulty": ["x"], "expected": dict.fromkeys(FIELDS) | {"verdict": "PASS"}, "notes": "n"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c1.expected.json").write_text(json.dumps(label, indent=1))
    got = T.read_labels(spark, str(tmp_path / "in")).collect()
    assert [(r["case_id"], r["expected"]["verdict"], r["config"]) for r in got] == [("c1", "PASS", None)]
    (tmp_path / "in" / "c0.expected.json").write_text(json.dumps(label | {"config": {"max_age_days": 5}}))
    (tmp_path / "in" / "c2.expected.json").write_text(json.dumps(label))
    members = spark.createDataFrame([("c0",), ("c1",), ("c1",), ("c9",)], "case_id string")
    cases = T.read_cases(spark, str(tmp_path / "in"), members, T.default_config()).collect()
    assert [(r["case_id"], r["config"]["max_age_days"]) for r in cases] == [("c0", 5), ("c1", 90)]
    replies = spark.createDataFrame([("{}", "m/1", "ab" * 16, 5), ("[]", "m 2", "cd" * 16, None)], "text string, asked_model string, request_key string, latency_ms long").withColumn("recorded", F.lit(True))
    for _ in range(2):
        T.write_recordings(replies, str(tmp_path / "rec"))
    back = T.read_recordings(spark, str(tmp_path / "rec"))
    assert sorted(set(back.select("text", "asked_model", "request_key", "latency_ms", "recorded").collect())) == sorted(set(replies.collect())) and back.count() == 4
    spark.createDataFrame([('{"gt_parse": {"total": "5"}}', 1), ("no", 2)], "ground_truth string, other int").coalesce(1).write.parquet(str(tmp_path / "gt"))
    gt = T.read_ground_truth(spark, str(tmp_path / "gt")).selectExpr("document", "try_variant_get(gt, '$.gt_parse.total', 'string') t").orderBy("document").collect()
    assert [r["t"] for r in gt] == ["5", None] and len({r["document"] for r in gt}) == 2
    (tmp_path / "r" / "model-x").mkdir(parents=True)
    (tmp_path / "r" / "model-x" / ("0f" * 16 + ".json")).write_text(json.dumps({"text": "{}", "model": "model-x", "input_tokens": 1, "output_tokens": 2, "latency_ms": 3}, indent=1))
    r = T.read_recording_files(spark, str(tmp_path / "r")).first()
    assert (r["asked_model"], r["request_key"], r["latency_ms"], r["recorded"]) == ("model-x", "0f" * 16, 3, True)
    xml = (
        '<x:I xmlns:x="u"><x:ExchangedDocument><x:ID>N1</x:ID><x:IssueDateTime><x:DateTimeString format="102">20260305</x:DateTimeString></x:IssueDateTime></x:ExchangedDocument>'
        '<x:SellerTradeParty><x:Name>S</x:Name><x:SpecifiedTaxRegistration><x:ID schemeID="FC">9</x:ID></x:SpecifiedTaxRegistration><x:SpecifiedTaxRegistration><x:ID schemeID="VA">DE1</x:ID></x:SpecifiedTaxRegistration>'
        "</x:SellerTradeParty><x:InvoiceCurrencyCode>EUR</x:InvoiceCurrencyCode><x:SpecifiedTradeSettlementHeaderMonetarySummation><x:TaxTotalAmount currencyID=\"GBP\">9</x:TaxTotalAmount>"
        '<x:TaxTotalAmount currencyID="EUR">19.00</x:TaxTotalAmount><x:GrandTotalAmount>119.00</x:GrandTotalAmount></x:SpecifiedTradeSettlementHeaderMonetarySummation></x:I>'
    )
    f = spark.createDataFrame([(xml,)], "x string").select(T.xml_fields(F.col("x")).alias("f")).first()["f"]
    assert (f["invoice_number"], str(f["invoice_date"]), f["tax_id"], f["currency"], float(f["tax_amount"]), float(f["total_amount"]), f["customer_name"]) == ("N1", "2026-03-05", "DE1", "EUR", 19.0, 119.0, None)


def test_replies(spark):
    good = dict.fromkeys(FIELDS) | {"total_amount": {"value": "5", "evidence": ""}, "currency": {"value": " ", "evidence": "x"}}
    cases = [
        (good, True), (good | {"issuer_country": "DE", "date_format": "x"}, True), (good | {"extra": None}, False), ({k: v for k, v in good.items() if k != "tax_id"}, False),
        (good | {"tax_id": {"value": 5, "evidence": "x"}}, False), (good | {"tax_id": {"value": "5"}}, False), (good | {"tax_id": {"value": "5", "evidence": "x", "more": 1}}, False), ([], False), ("x", False),
    ]
    rows = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(98, "{broken"), (99, None)]
    got = {r["id"]: (r["ok"], r["c"]) for r in spark.createDataFrame(rows, "id int, t string").select("id", P.is_strict(F.col("t")).alias("ok"), P.reply_candidates(F.col("t")).alias("c")).collect()}
    assert [got[k][0] for k in range(len(cases))] == [ok for _, ok in cases] and not got[98][0] and not got[99][0]
    assert got[0][1]["total_amount"]["raw"] == "5" and got[0][1]["total_amount"]["evidence"] is None and got[0][1]["currency"] is None and got[2][1] is None


def test_metrics(spark):
    s = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"

    def rec(**kw):
        return tuple(kw.get(f) for f in FIELDS)

    df = spark.createDataFrame(
        [("a", rec(total_amount="10.0", supplier_name="ACME  Ltd."), rec(total_amount="10.00", supplier_name="acme ltd")), ("b", rec(total_amount="x"), rec(total_amount="x", tax_id="1"))],
        f"case_id string, predicted {s}, expected {s}",
    )
    long = M.by_field(df)
    got = {r["field"]: r for r in M.field_stats(long).collect()}
    assert (got["total_amount"]["exact"], got["supplier_name"]["exact"], got["tax_id"]["exact"], got["currency"]["exact"]) == (1, 2, 1, 2)
    assert got["total_amount"]["precision"] == 0.5 and got["currency"]["precision"] is None and got["tax_id"]["recall"] == 0.0
    assert {r["message"] for r in M.failures(long).collect()} == {"total_amount: expected x, got x", "tax_id: expected 1, got None"}
    v = spark.createDataFrame([("PASS", "FAIL", ["t", "u"], "s"), ("PASS", "PASS", ["t"], None)], "e string, p string, tags array<string>, source string")
    assert {tuple(r) for r in M.confusion(v, "e", "p").collect()} == {("PASS", 1, 1, 0), ("FAIL", 0, 0, 0), ("REVIEW", 0, 0, 0)}
    assert {tuple(r) for r in M.by_tag(v, "tags", F.col("e") == F.col("p")).collect()} == {("t", 2, 1), ("u", 1, 0)}
    assert {tuple(r) for r in M.roll_up(v.withColumn("c", F.lit("x")), "c", "source", n=F.count("*")).collect()} == {("x/all", 2), ("x/s", 1)}
    ms = spark.createDataFrame([(k, ) for k in range(1, 81)] + [(None,)], "ms int")
    assert tuple(M.calls(ms, "ms").first()) == (81, 80, 40.5, 76.0)
    base = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "name string, m double")
    now = spark.createDataFrame([("a", 0.8), ("b", 0.5), ("c", 0.7)], "name string, m double")
    assert {(r["name"], r["least"]) for r in M.gate(now, base, ["m"]).collect()} == {("a", 0.9), ("c", None)}
    assert {tuple(r) for r in T.upsert(base, now, "name").collect()} == {("a", 0.8), ("b", 0.5), ("c", 0.7)}


def test_labels(spark):
    s = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
    lab = tuple({"total_amount": "1234.50", "invoice_date": "2026-03-05", "currency": "EUR", "tax_id": "DE 12", "supplier_name": "Gone Ltd"}.get(f) for f in FIELDS)
    df = spark.createDataFrame([(lab, "Acme\n05.03.2026 1.234,50 € VAT DE12")], f"expected {s}, text string")
    r = B.checked(df, "expected", "text").first()
    assert r["discrepancies"] == ["supplier_name"] and r["expected"]["supplier_name"] is None and r["expected"]["total_amount"] == "1234.50"
    d = spark.createDataFrame([(k, "g", "2026-01-01") for k in range(5)], "k int, g string, d string").withColumn("d", F.to_date("d"))
    got = B.halves(B.with_scenario(d, "k", "d", "g"), "k", "g").orderBy("k").collect()
    assert [x["scenario"] for x in got] == ["valid", "old_date", "currency", "customer", "valid"] and [x["half"] for x in got] == ["dev"] * 3 + ["test"] * 2
    assert str(got[1]["reference_date"]) == "2026-05-01" and B.repeated(d, "g").first()["n"] == 5


def test_stream_equals_batch(spark, tmp_path):
    """Exactly the windows that the watermark has passed come out, without the row that is too late; a stateless copy has all rows."""
    stamp = lambda rows: spark.createDataFrame(rows, "k int, t string, kind string").withColumn("t", F.to_timestamp("t")).coalesce(1)
    make = lambda s: monitor.windowed(s, "t", "kind", width="1 hour", late="1 hour", n=F.count("*"))
    folder = str(tmp_path / "in")

    def feed(rows):
        stamp(rows).write.mode("append").parquet(folder)
        monitor.run(monitor.stream_of(spark, folder, "k int, t timestamp, kind string"), str(tmp_path / "out"), str(tmp_path / "cp"), make).awaitTermination(120)
        return sorted((str(r["window_start"])[11:16], r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    feed([(k, f"2026-01-01 0{k % 3}:30:00", "x") for k in range(9)])
    out = feed([(9, "2026-01-01 05:30:00", "x")])
    assert out == [("00:00", "x", 3), ("01:00", "x", 3), ("02:00", "x", 3)]
    # The watermark is at 04:30: a row of two o'clock is dropped, one of four o'clock counts.
    out = feed([(10, "2026-01-01 02:10:00", "x"), (11, "2026-01-01 04:40:00", "x"), (12, "2026-01-01 09:00:00", "y")])
    assert out == [("00:00", "x", 3), ("01:00", "x", 3), ("02:00", "x", 3), ("04:00", "x", 1), ("05:00", "x", 1)]
    plain = monitor.run(monitor.stream_of(spark, folder, "k int, t timestamp, kind string"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    plain.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 13


def test_modes_extractors_and_prompts(spark):
    from ledgerlens.operators import replies as P
    from ledgerlens.operators.lines import none
    from ledgerlens.operators.resolve import extract
    from ledgerlens.plans.pipeline import run
    from ledgerlens.plans.runtime import Stages

    text = "Invoice No: K7-31\nTotal 31.00 CHF\n"
    found = {f: None for f in FIELDS} | {"invoice_number": {"value": "K7-31", "evidence": "Invoice No: K7-31"}}
    df = spark.createDataFrame([(1, [text], "a"), (2, [text], "b"), (3, [text], "c")], "id int, pages array<string>, request_key string")
    known = spark.createDataFrame([("a", json.dumps(found)), ("b", "{}")], "request_key string, text string")
    of = lambda mode: {r["id"]: (r["used"], len(r["warnings"]), r["fields"]["total_amount"]["value"] is not None, r["fields"]["invoice_number"]["confidence"]) for r in run(df, mode, known, cut=Stages(spark).cut).select("id", "used", "warnings", "fields").collect()}
    assert of("heuristic") == {k: ("heuristic", 0, True, 1.0) for k in (1, 2, 3)}
    assert of("llm") == {1: ("llm", 0, False, 1.0), 2: ("heuristic:fallback", 1, True, 1.0), 3: ("heuristic:fallback", 1, True, 1.0)}
    assert {k: v[0] for k, v in of("hybrid").items()} == {1: "hybrid:llm_called", 2: "heuristic:fallback", 3: "heuristic:fallback"}
    with pytest.raises(ValueError):
        run(df, "llm")
    empty = extract(df, extractor=lambda d, pages: d.withColumn("candidates", F.struct(*[none().alias(f) for f in FIELDS])))
    assert all(r["fields"][f]["confidence"] == 0 for r in empty.collect() for f in FIELDS)
    prompt = P.PromptSpec("v9", "Read it.", '{"type": "object"}', "A note.")
    keys = df.limit(1).select(prompt.key(F.lit("m"), F.lit("t")).alias("a"), prompt._replace(version="v8").key(F.lit("m"), F.lit("t")).alias("b"), P.user_prompt(F.lit("t"), "A note.").alias("u")).first()
    want = json.dumps(["m", "v9", "Read it.", "A note.\n\n<document>\nt\n</document>", {"type": "object"}], ensure_ascii=False)
    assert keys["a"] == hashlib.sha256(want.encode()).hexdigest()[:32] != keys["b"] and keys["u"].startswith("A note.")


def test_oversize_files_and_requests(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one")
    (tmp_path / "t" / "b.txt").write_bytes(b"x" * (S.MAX_BYTES + 1))
    (tmp_path / "t" / "c.txt").write_bytes(b"\xff\xfe")
    got = {r["path"][-5:]: r["error"] for r in S.from_bytes(S.read_texts(spark, str(tmp_path / "t")), size="bytes").collect()}
    assert got == {"a.txt": None, "b.txt": S.TOO_LARGE, "c.txt": S.UNREADABLE}
    (tmp_path / "t" / "b.txt").write_bytes(b"x" * (S.MAX_REQUEST + 1))
    asked = {r["path"][-5:]: (r["body"], r["error"]) for r in S.read_requests(spark, str(tmp_path / "t")).collect()}
    assert asked == {"a.txt": ("one", None), "b.txt": (None, S.TOO_LARGE), "c.txt": (None, S.INVALID)}


def test_label_jobs(spark):
    from ledgerlens.operators import jobs

    doc = {"type": "credit-note", "series": "R", "code": "9", "issue_date": "2030-10-06", "currency": "EUR", "supplier": {"name": "Moss", "tax_id": {"country": "DE", "code": "123456789"}},
           "customer": {"name": "Fern"}, "totals": {"sum": "30.00", "total": "30.00", "tax": "5.70", "total_with_tax": "35.70"}}
    net = doc | {"type": None, "tax": {"prices_include": "VAT"}, "totals": {"sum": "35.70", "total": "30.00", "tax": "5.70", "total_with_tax": "35.70"}}
    texts = ("Moss DE123456789 R-9 2030-10-06 30,00 5,70 35,70 EUR", "Moss (DE) 123456789 R-9 06.10.2030 30.00 5.70 35.70 € Fern")
    rows = spark.createDataFrame([(json.dumps(d), t) for d, t in zip((doc, net), texts)], "j string, text string").withColumn("doc", F.parse_json("j"))
    a, b = jobs.gobl(rows).collect()
    assert (a["expected"]["total_amount"], a["expected"]["tax_id"], a["expected"]["customer_name"], a["kind"]) == ("-35.70", "DE123456789", None, "credit-note")
    assert [d["field"] for d in a["discrepancies"]] == ["total_amount", "subtotal_amount", "tax_amount", "customer_name"]
    assert (b["expected"]["subtotal_amount"], b["expected"]["tax_id"], b["expected"]["customer_name"], len(b["discrepancies"]), b["kind"]) == ("30.00", "123456789", "Fern", 1, "standard")
    fields = {f: F.lit(v) for f, v in zip(FIELDS, ("Moss", "9", "2030-10-06", "107.00", "EUR", None, "100.00", "8.00", "Fern, Bath", None))}
    s = spark.createDataFrame([("Moss 9 2030-10-06 107.00 EUR 100.00 8.00 Fern",), ("",)], "text string")
    got = jobs.salorworks(s, fields, discount=F.lit("1.00").cast("decimal(9,2)")).collect()
    assert got[0]["expected"]["customer_name"] == "Fern" and got[0]["discrepancies"] == [] and got[0]["arithmetic"] and got[1]["expected"]["total_amount"] is None and got[1]["discrepancies"] == []
    docs = spark.createDataFrame([("Invoice no: 5\nSeller:\nMoss & Co\n 811-22-3344\n 1 300,50",), ("Invoice no: 6\n",), ("nothing",), ("Invoice no: 5\nSeller:\nFern\n 811-22-3344\n 1 300,50",)], "text string")
    lab = spark.createDataFrame([("5", "Moss", "x", "02/03/2030", "$ 1 300,50", "811-22-3344")], "number string, seller string, client string, day string, total string, seller_tax_id string")
    lab = lab.withColumn("total", F.lit("1300,50"))
    done = jobs.mendeley(docs, lab).collect()
    assert sorted((r["reason"] or "", r["misread"]) for r in done) == [("", True), ("no_label", False), ("no_number", False), ("other_seller", True)]
    faults = jobs.rendered_faults(s.withColumn("e", F.struct(*[fields[f].cast("string").alias(f) for f in FIELDS])), "e", "text").collect()
    assert faults[0]["faults"] == ["customer_name is not printed", "the parts do not make the total"]


def test_reports_and_samples(spark):
    from ledgerlens.operators import metrics as M

    df = spark.createDataFrame([("b", 2.0), ("a", None)], "name string, rate double")
    assert [r["line"] for r in T.markdown(df, ["name", "rate"], "Runs").orderBy("place", "line").collect()] == ["# Runs", "", "| name | rate |", "|---|---|", "| a | n/a |", "| b | 2.0 |"]
    assert T.audit(spark.createDataFrame([(1, "abc")], "id int, text string")).first()["line"] == '{"id":1,"chars":3,"document_hash":"ba7816bf8f01cfea"}'
    cases = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s"), ("d", "t")], "case_id string, source string")
    members = spark.createDataFrame([("a", "dev"), ("a", "test"), ("b", "dev"), ("c", "dev"), ("z", "dev")], "case_id string, split string")
    assert sorted((r["fault"], r["name"], r["n"]) for r in M.split_faults(cases, members).collect()) == [("in no split", "d", 0), ("in two splits", "a", 2), ("no case", "z", 0), ("uneven", "s", 2)]
    assert M.split_faults(cases, spark.createDataFrame([("a", "dev"), ("b", "test"), ("c", "dev"), ("d", "dev")], "case_id string, split string")).count() == 0
    log = spark.range(2000).select("id", F.lit("2026-01-05 10:00:00").cast("timestamp").alias("t"), F.when(F.col("id") % 2 == 0, "PASS").otherwise("FAIL").alias("verdict"), F.array(F.struct(F.lit("r").alias("id"), F.when(F.col("id") % 4 == 0, "FAIL").otherwise("PASS").alias("status"))).alias("rules"))
    kept = monitor.weekly_sample(log, "t", "id", 0.1)
    assert 60 < kept.count() < 140 and kept.where("verdict <> 'PASS'").count() == 0 and monitor.rule_shares(log).first()["fail_rate"] == 0.25
    assert {r["k"] for r in B.sample_of_each(spark.createDataFrame([(k, "g") for k in range(9)], "k int, g string"), 3, "k", "g", seed=4).collect()} != {0, 1, 2}


def test_candidates_of_every_field_are_typed(spark, tmp_path):
    from ledgerlens.plans.queries import candidate_values

    data = [(1, "total_amount", "net 100.00 total 119.00"), (2, "tax_id", " de 123.456.789"), (3, "supplier_name", " Acme  Ltd; "), (3, "supplier_name", " Acme  Ltd; "), (4, "total_amount", "n/a"), (5, "invoice_date", "2024-01-02"), (6, "tax_id", None)]
    spark.createDataFrame(data, "candidate_id long, field string, raw string").write.parquet(f"{tmp_path}/candidates.parquet")
    got = {r["candidate_id"]: (r["field"], str(r["amount"]), [a["token"] for a in r["amounts"] or []], r["tax_id"], r["name"]) for r in candidate_values(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("total_amount", "119.00", ["100.00", "119.00"], None, None),
        2: ("tax_id", "None", [], "DE123456789", None),
        3: ("supplier_name", "None", [], None, "Acme Ltd"),
        4: ("total_amount", "None", [], None, None),
        6: ("tax_id", "None", [], None, None),
    }
