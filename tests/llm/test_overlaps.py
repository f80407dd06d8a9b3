import math
import random

from ledgerlens.llm import overlaps as O
from ledgerlens.plans.runtime import Stages

E = "struct<supplier_name:string,invoice_number:string,invoice_date:string,total_amount:string,currency:string,tax_id:string,subtotal_amount:string,tax_amount:string,customer_name:string,customer_tax_id:string,verdict:string>"
BASE = ("Gökem Foods Ltd", "INV-2024-5190", "2024-03-05", "120.00", "EUR", "GB001", "100.00", "20.00", "Robert Tatowa", "DE77", "PASS")


def label(**change):
    names = [f.split(":")[0] for f in E[7:-1].split(",")]
    return tuple(change.get(n, v) for n, v in zip(names, BASE))


def rows(*cases):
    return [(i, s, src, lab, f"2026-01-0{1 + k % 9} 00:00:00") for k, (i, s, src, lab) in enumerate(cases)]


CASES = [
    ("a", "train", "s_1", label()),
    ("b", "dev", "s_2", label(verdict="FAIL")),
    ("c", "test", "S 2", label(invoice_number="inv 2O24/5190 (copy)", supplier_name="Gökme Foods Ltd", tax_id="GB 0.01")),
    ("d", "test", None, label(invoice_date="2023-03-05", subtotal_amount=None)),
    ("e", "dev", "s_2", label(invoice_number="INV-2024-5191", invoice_date="2024-04-05")),
    ("f", "dev", "s_2", label(invoice_number="INV-2024-5191")),
    ("g", "dev", "s_2", label(supplier_name="Other", tax_id="X9", customer_name="Else", customer_tax_id="Y8", total_amount="5", subtotal_amount="4", tax_amount="1")),
    ("h", None, "s_2", label()),
    ("i", "dev", "s_2", None),
    ("j", "train", "s_2", label(invoice_number=None, invoice_date=None)),
    ("k", "dev", "s_2", label(invoice_number=None)),
    (None, "dev", "s_2", label()),
    ("b", "dev", "s_2", label(verdict="FAIL")),
]


def test_pairs(spark):
    df = spark.createDataFrame(rows(*CASES), f"case_id string, split string, source string, expected {E}, loaded_at string")
    got = sorted((r["case_a"], r["case_b"]) for r in O.overlaps(spark, df).collect())
    assert got == [("a", x) for x in "bcdfk"]
    report = {(r["split"], r["source"]): r["pairs"] for r in O.overlaps(spark, df).groupBy("split", O.source_key(O.F.col("source")).alias("source")).agg(O.F.count("*").alias("pairs")).collect()}
    assert report == {("dev", "s2"): 3, ("test", "s2"): 1, ("test", None): 1}
    assert O.overlaps(spark, df.limit(0)).count() == 0


def test_cosine_join_against_brute_force(spark, monkeypatch):
    """Random weights and vectors, a term that a fifth of all vectors have, lists that are cut on both sides."""
    r = random.Random(5)
    pool = [k for k in range(60) for _ in range(1 + 200 // (k + 1) % 7)] + [99] * 40
    data = [(f"v{k}".encode(), "train" if k % 2 else "eval", {t: r.choice((0.5, 1.0, 2.0)) for t in r.choices(pool, k=r.randint(1, 7))}) for k in range(160)]
    want = {}
    for a, s, x in data:
        for b, u, y in data:
            if s == "train" and u == "eval":
                dot = sum(w * y.get(t, 0) for t, w in x.items()) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))
                if dot >= 0.4 - 1e-9:
                    want[a, b] = dot
    size = lambda v: math.sqrt(sum(w * w for w in v.values()))
    rows = [(c, s, c.decode(), [(t % 4, t, w / size(v)) for t, w in v.items()], []) for c, s, v in data]
    stages = Stages(spark)
    df = stages.cut(spark.createDataFrame(rows, "cid binary, side string, x string, v array<struct<kind:int,term:bigint,w:double>>, links array<bigint>"))
    monkeypatch.setattr(O, "LIST", 5)
    got = O.cosine_join(df, 0.4, stages).collect()
    assert len(want) > 20 and {(bytes(g["a"]), bytes(g["b"])) for g in got} == set(want) and len(got) == len(want)
    assert all(abs(g["cosine"] - want[bytes(g["a"]), bytes(g["b"])]) < 1e-9 and g["x"] == bytes(g["a"]).decode() for g in got)


def test_slipped_copies_of_one_invoice_in_a_third_of_all_rows(spark, monkeypatch):
    r = random.Random(7)
    letters = "abcdefghjkmnpqrtuvwxy3467"

    def slip(text):
        k = r.randrange(len(text))
        return r.choice([text[:k] + r.choice(letters) + text[k + 1 :], text[:k] + text[k + 1 :], text[:k] + r.choice(letters) + text[k:], text[:k] + text[k + 1 : k + 2] + text[k] + text[k + 2 :]])

    names = [n for n in (f.split(":")[0] for f in E[7:-1].split(",")) if n not in ("currency", "verdict")]
    other = lambda n, k: {"invoice_date": f"2024-{k % 12 + 1:02}-{k % 28 + 1:02}"}.get(n, str(k * 7) + ".50" if "amount" in n else f"{n[:3]}{k} {n[-3:]}{k * 31}")
    one = [label(**{n: r.choice([slip, slip, slip, lambda _: None])(dict(zip([f.split(":")[0] for f in E[7:-1].split(",")], BASE))[n]) for n in r.sample(names, 2)}) for _ in range(90)]
    # No word, date or amount is equal to the letter, yet number, parties and total agree.
    one += [label(), label(supplier_name="Gokemm Foodz Ltdd", tax_id=None, invoice_date="2021-11-30", total_amount="120.01", subtotal_amount=None, tax_amount=None, customer_name=None, customer_tax_id=None)]
    one += [label(invoice_number=None, total_amount="120.4"), label(invoice_number=None, total_amount="-120.00"), label(invoice_date=None, total_amount="3", tax_amount="20.02")]
    one += [label(invoice_number="A-7", invoice_date=d, total_amount=t) for d, t in (("2024-01-12", "3"), ("2024-12-01", "4"), (None, "5"), ("2024-12-01", None))]
    cases = [(f"c{k}", "train" if k % 2 else "dev", "s", lab) for k, lab in enumerate(one + [label(**{n: other(n, k) for n in names}) for k in range(1, 191)])]
    df = spark.createDataFrame(rows(*cases), f"case_id string, split string, source string, expected {E}, loaded_at string")
    lab = O.labels(df, Stages(spark)).cache()
    x, y = (lab.where(f"side = '{s}'").select(O.F.col("case_id").alias(n), O.F.struct(*O.KEYS).alias(v)) for s, n, v in (("train", "a", "x"), ("eval", "b", "y")))
    whole = x.crossJoin(y).where(O.same_invoice()).select("a", "b").cache()
    want = {(min(p), max(p)) for p in whole.collect()}
    # Every pair has a link in common.
    links = O.classes(lab).select("case_id", O.link_keys().alias("links"))
    both = whole.join(links.toDF("a", "la"), "a").join(links.toDF("b", "lb"), "b")
    assert both.where(~O.F.arrays_overlap("la", "lb")).count() == 0
    monkeypatch.setattr(O, "LIST", 5)
    got = [(p["case_a"], p["case_b"]) for p in O.overlaps(spark, df).collect()]
    assert len(want) > 1000 and len(got) == len(set(got)) and set(got) == want


def test_taxes_of_zero_prove_nothing_on_another_day(spark):
    other = label(invoice_number="7", invoice_date="2024-03-06", total_amount="9", subtotal_amount=None, tax_amount="0.00")
    cases = [("a", "train", "s", label(invoice_number="7", tax_amount="0.00")), ("b", "dev", "s", other)]
    df = spark.createDataFrame(rows(*cases), f"case_id string, split string, source string, expected {E}, loaded_at string")
    assert O.overlaps(spark, df).count() == 0
