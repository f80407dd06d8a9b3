import unicodedata

from ledgerlens.llm import lookalikes as L

COUNTS = {chr(c): 1000 for c in range(32, 127)} | {"é": 50, "ö": 9}


def test_same_picture_same_form():
    w = L.Rewriter(L.representatives(COUNTS))
    same = ["Ｃｈａｒ", "Char", "Сhаr", "C​har", " Char ", "﻿Char"]
    assert {w(x) for x in same} == {"Char"}
    assert w("Oﬃcine") == "Officine" and w("a　b‑c") == "a b-c"
    assert w("é") == w("é") == w("е‍́") and w("ӧ") == w("ö") == w("ӧ")
    assert w("") == "" and w(None) is None


def test_other_picture_other_form():
    w = L.Rewriter(L.representatives(COUNTS))
    for a, b in [("Char", "char"), ("Char", "Char "), ("Char", "Chár"), ("l", "I"), ("x2", "x²"), ("a b", "a  b"), ("S.A.", "SA")]:
        assert w(a) != w(b)


def test_rewriting_is_stable_for_the_whole_table():
    w = L.Rewriter(L.representatives({}))
    for a, b in L.pairs():
        assert w(w(a)) == w(a)
        if len(a) == 1 and len(b) == 1 and unicodedata.category(a) != "Zs" and unicodedata.category(b) != "Zs":
            assert w(a) == w(b)


def test_long_text():
    w = L.Rewriter(L.representatives(COUNTS))
    assert w("а" * 200_000) == "a" * 200_000


def test_query_cases(spark):
    v = "struct<value:string>"
    rows = [
        (1, ("Velimku Ltd",), ("Velimku Ltd",), ("GB1",)),
        (1, ("Velimku Ltd",), ("Velimku Ltd",), ("GB1",)),
        (2, ("Vеlimku Ltd",), (None,), ("ＧB1",)),
        (3, ("Velimku Ltd ",), ("",), None),
        (None, ("Vеlimku Ltd",), None, None),
    ]
    e = spark.createDataFrame(rows, f"extraction_id bigint, supplier_name {v}, customer_name {v}, tax_id {v}")
    p = spark.createDataFrame([(7, "Velimku Ltd", "GB1"), (8, None, None)], "party_id bigint, name string, tax_id string")
    got = {tuple(r) for r in L.find(spark, e, p).collect()}
    assert got == {(1, "customer_name", 7), (2, "supplier_name", 7), (2, "tax_id", 7)}
    assert L.find(spark, e.limit(0), p.limit(0)).count() == 0


def test_long_chains_and_other_planes():
    chain = {chr(0x4E00 + k): chr(0x4E00 + k + 1) for k in range(30)}
    w = L.Rewriter(chain)
    assert w(chr(0x4E00)) == chr(0x4E00 + 30)
    around = L.Rewriter({"甲": "乙", "乙": "丙", "丙": "甲"})
    assert around("甲") == around("乙") == around("丙")
    same = L.Rewriter(L.representatives(COUNTS))
    assert same("𝐂𝒉𝖺𝚛") == same("ꓚhаr") == same("Ꮯhar") == "Char" and same("𐐄x") == "Ox" and same("x²") != same("x2")
