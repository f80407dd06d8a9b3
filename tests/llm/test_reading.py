import random

import numpy as np

from ledgerlens.llm import prose as P
from ledgerlens.llm import reading as R

EASY = "It keeps the note. The box holds a key. This day adds one line. Now the page gets the step. "
HARD = (
    "Notwithstanding these considerations, the canonicalisation circumscribes each jurisdictional approximation, insofar as this interoperability "
    "operationalises the heterogeneous nomenclature, whereas the proportionality exacerbates an irreversible discrepancy. "
)


def words(text):
    return [" ".join(s) for s in P.sentences(text)]


def test_comments_docstrings_and_documentation():
    assert words('x = 1\n# It reads the\n# page now. See\nif y == 2:\n    """It holds a box.\n    The end is near.\n    """\n') == ["it reads the page now", "it holds a box", "the end is near"]
    assert words("/**\n * It reads the page.\n * @param x is the page.\n */\nint f(void) { return 0; } // The rest is a trap.\n") == ["it reads the page", "the rest is a trap"]
    assert words("# Title of the text\n\nIt reads the\npage. Then it\nstops at the end!\n\n```sh\nIt is code in a fence.\n```\n\n| it | is a table. |\n- It is the item.\n") == [
        "it reads the page", "then it stops at the end", "it is the item"
    ]
    assert words("-- The row is\r\n-- here.\r\nSELECT 1;\r\n") == ["the row is here"]


def test_what_is_no_prose():
    assert words('log.info("This is the text of a string.");\n') == []
    assert words("x = '''\nThis is the text of a string.\n'''\n") == []
    assert words("// Code generated by the tool; DO NOT EDIT.\n// It is the header.\n\n# SPDX-License-Identifier: It is a licence.\n") == []
    assert words("Open Meadow Licence 2.0\n\nKeep the files.\n\nThe other text is here.\n") == []
    assert P.sentences("Keep the files as they are.", "vendor/LICENSE.txt") == [] != P.sentences("Keep the files as they are.", "docs/licences.md")
    assert words("# Copyright (c) 2020 The owner of the file.\n# It is given as it is.\n\n# The file permission is kept.\n") == ["the file permission is kept"]
    assert words("# The rate is 2.5 percent of it, e.g., for the page\n") == ["the rate is percent of it , e g , for the page"]
    assert words("// Der Satz ist nicht auf Englisch und die Seite ist das auch nicht.\n// La fila de los datos es una de las que se lee.\n") == []
    assert words("a,b,c\n1,2,3\nkey: The value is a text.\n") == []
    assert words(None) == words("") == words("  \n") == []


def test_ordinal_regression_recovers_bands():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    y = 1 + np.digitize(x @ [2.0, -1.0, 0.0] + r.normal(scale=0.2, size=600), [-1.5, 0, 1.5])
    y[::25] = 5 - y[::25]  # raters that err
    model = R.robust_fit(x[:400], y[:400])
    fresh = np.arange(400, 600) % 25 != 0
    assert (model.band(x[400:])[fresh] == y[400:][fresh]).mean() > 0.9
    assert list(model.cuts) == sorted(model.cuts)


def test_depth_of_clauses():
    assert [R.depth(s.split()) for s in ("it reads the page", "it reads the page that the box holds", "the box that holds the page , which is here , stays", "it is said that he knows who did what because it is here")] == [0, 1, 1, 3]


def test_a_large_vocabulary_gives_the_same_features(spark):
    docs = spark.createDataFrame([(k, f"# It is the word{'abc'[k % 3]}, which the page number{'xyz'[k % 3]} holds.\n# The page is here.\n") for k in range(9)] + [(1, "# The page is here.\n")], "doc_id long, text string")
    prose = R.prose_of(docs).cache()
    counts = R.word_counts(prose).cache()
    few, many = (sorted((r["doc_id"], r["words"], [round(v, 9) for v in r["f"]]) for r in R.measured(prose, counts, most).collect()) for most in (50_000, 2))
    assert few == many and len(few) == 10 and all(f[R.RARITY] > 0 for _, _, f in few)


def test_query(spark):
    r = random.Random(2)

    def text(level):
        mix = [EASY] * (8 if level == 1 else 4) if level < 3 else [HARD] * (3 if level == 4 else 2) + [EASY] * (0 if level == 4 else 1)
        r.shuffle(mix)
        return "".join(f"# {s}\n" for s in mix)

    docs = [(k, text(1 + 3 * (k % 2)), "extra") for k in range(40)] + [(100, None, ""), (101, "", ""), (102, "# It is a short text.\n", ""), (103, "x" * 200_000, "")]
    labels = [(k, "r", 1 + 3 * (k % 2)) for k in range(30)] + [(1, "q", None), (2, "q", 9), (None, "q", 1), (0, "r", 1)]
    d = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string, words string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, band int")
    got = [(x["doc_id"], x["band"]) for x in R.levels(spark, d, lab).collect()]
    assert len(got) == 41 and set(got) == {(k, 1 + 3 * (k % 2)) for k in range(40)}
    assert R.levels(spark, d.limit(0), lab).count() == 0
    assert R.levels(spark, d, lab.limit(0)).count() == 0
