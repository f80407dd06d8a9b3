import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import names as N


def brute_edits(a, b):
    import functools

    @functools.lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=300, deadline=None)
def test_edits_against_recursion(a, b):
    assert N.edits(a, b, 7) == brute_edits(a, b)
    assert N.edits(a, b, 2) == min(3, brute_edits(a, b)) or brute_edits(a, b) > 2 and N.edits(a, b, 2) == 3


def test_jaro_winkler_published_values():
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-2)
    assert N.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-3)
    assert N.jaro_winkler("", "a") == 0


def test_phonetic_ignores_usual_slips():
    assert N.phonetic("queklu") == N.phonetic("queckluu") == N.phonetic("kweklu")
    assert N.phonetic("霧渡灯") == "霧渡灯"


LONG = "".join(c + "aeiou"[k % 5] for k, c in enumerate("bdfgklmnprstvbdfgklmnprstvbdfgklmnprst"))
REGISTER = [
    (7, "Северянко Packaging Ltd", "organisation", "Mont X"),
    (8, f"{LONG.title()} Consulting S.A.", "organisation", "Mont X"),
    (1, "Velimku Packaging Ltd", "organisation", "Upper Furorvon"),
    (2, "Bidrowo Consulting Sp. z o.o.", "organisation", "Villa Secogro"),
    (3, "Bidrowo Furniture Sp. z o.o.", "organisation", "Villa Secogro"),
    (4, "Dorothea Padrëxdax", "person", "San Lomixstu"),
    (5, "Alexander Padrëxdax", "person", "Port Dafozo"),
    (6, "Möbelwerke Baldrun GmbH", "organisation", "Kirch Duna"),
    *[(100 + k, f"Zork{c}{c}ul Packaging Ltd", "organisation", "Mont X") for k, c in enumerate("bdfgk")],
    *[(200 + k, f"Nurg{c}em Consulting S.A.", "organisation", "Mont X") for k, c in enumerate("bdfgk")],
    *[(300 + k, f"Trap{c}os Furniture AG", "organisation", "Mont X") for k, c in enumerate("bdfgk")],
    *[(350 + k, f"Quil{c}os Möbelwerke AG", "organisation", "Mont X") for k, c in enumerate("bdfgk")],
    *[(400 + k, f"Dorothea Mist{c}alk", "person", "Mont X") for k, c in enumerate("bdfgk")],
    *[(500 + k, f"Alexander Hult{c}imp", "person", "Mont X") for k, c in enumerate("bdfgk")],
]
CASES = {
    "Velimku Pkg Limited": 1, "PACKAGING VELIMCU LTD - UPPER FURORVON": 1, "VelimkuPackaging": 1, "Vеlimku Packaging Ltd": 1,
    "Furn. Bidroow Spółka z o.o.": 3, "Bidrowo Sp. z o.o.": None, "Bidrowo Trading": None, "Doro Padrexdax": 4, "Padrëksdax, D.": 4,
    "Mr Alex L. Padrëxdax": 5, "Katharina Padrëxdax": None, "Velimku Packaging Ltd": None, "": None, "Ltd": None, "Moebelw. Baldrun": 6,
    "Zorkbbul Padkaging": 100, "x" * 20_000: None, " ".join(["Velimku", *[f"trading{k}" for k in range(2_000)]]): None,
    # Slips in other scripts and in words of any length.
    "Северянинко Packaging Ltd": 7, "Севернянко Packaging": 7, LONG[:20] + "v" + LONG[21:] + " Consulting SA": 8, LONG[:9] + LONG[10:60] + LONG[61:] + " Consulting": 8,
    # Only by way of the variant before it.
    "Bidrowo Consulting": 2, "Drogaminu Furniture AG": None,
}


def test_query_cases(spark):
    rows = [(k, (v,), None) for k, v in enumerate(CASES)] + [(0, ("Velimku Pkg Limited",), None), (99, None, (None,)), (None, ("Velimku Pkg",), None)]
    e = spark.createDataFrame(rows, "extraction_id bigint, supplier_name struct<value:string>, customer_name struct<value:string>")
    p = spark.createDataFrame(REGISTER, "party_id bigint, name string, kind string, city string")
    got = [tuple(r) for r in N.find(spark, e, p).collect()]
    assert len(got) == len(set(got))
    assert {(k, p) for k, _, p in got} == {(k, p) for k, p in enumerate(CASES.values()) if p}
    assert N.find(spark, e.limit(0), p).count() == 0
    assert N.find(spark, e, p.limit(0)).count() == 0


def test_variants_of_variants():
    reg = N.Register(["packaging", "furniture"], ["dorothea", "alexander"])
    assert N.alike("Velimku Packaging Ltd", "Packaging VELIMCU", reg) and N.alike("Velimkur Packaging", "Velimku Pkg", reg) is False
    assert N.alike("Doro Padrexdax", "Padrexdax Dorothea", reg) and not N.alike("Alexander Padrexdax", "Dorothea Padrexdax", reg)
    assert not N.alike("Velimku Packaging", "Velimku Furniture", reg) and not N.alike("Velimku", "Velimko", reg) and not N.alike("Velimku", "Velimku Bidrowo", reg)
    keys = set(N.whole_keys("Velimkur Packaging"))
    assert keys & set(N.whole_keys("Packaging Velimku GmbH")) and not keys & set(N.whole_keys("Bidrowo Furniture"))


def test_words_are_found_as_if_compared_with_each():
    words = N.Words(["packaging", "logistics", "consulting", "foods", "северянко"])
    for w in ("packagin", "pakkaging", "lojistics", "fods", "x", "", "consultng", "phoods", "северянка", "x" * 500):
        assert words.like(w) == {b: N.same_word(w, b) for b, *_ in words.words if N.same_word(w, b)}
