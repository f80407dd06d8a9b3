"""Scalar functions against small tables: one DataFrame for each function."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerlens.functions import amounts as A
from ledgerlens.functions import dates as T
from ledgerlens.functions import text as X


def run(spark, expression, inputs):
    rows = [(k, i) for k, i in enumerate(inputs)]
    df = spark.createDataFrame(rows, "k int, x string").select("k", expression(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(df.collect(), key=lambda r: r["k"])]


def check(spark, expression, cases):
    got = run(spark, expression, [c[0] for c in cases])
    wrong = [(c, g) for c, g in zip(cases, got) if g != c[1]]
    assert not wrong


DATES = [
    ("2031-11-08", "2031-11-08"), ("08/11/2031", "2031-11-08"), ("8 November 2031", "2031-11-08"), ("November 8, 2031", "2031-11-08"), ("8 de noviembre de 2031", "2031-11-08"),
    ("printed on 22 February 2028 at noon", "2028-02-22"), ("ORD-2031-7781", None), ("2031/7781", None), ("30/02/2031", None), ("Dock 14, North Quay", None), ("", None), (None, None),
    ("11/25/2031", "2031-11-25"), ("9. Jänner 2031", "2031-01-09"), ("1er août 2031", "2031-08-01"), ("7 févr. 2031", "2031-02-07"), ("29 dicembre 2030", "2030-12-29"), ("6 de maio de 2030", "2030-05-06"),
    ("6 mei 2030", "2030-05-06"), ("6 maja 2030", "2030-05-06"), ("6-Oct-2030", "2030-10-06"), ("6-Oct-30", "2030-10-06"), ("2030/10/06", "2030-10-06"), ("2030.10.06", "2030-10-06"),
    ("06.10.30", "2030-10-06"), ("2030年10月6日", "2030-10-06"), ("06-10-30", None), ("06/10/82", "1982-10-06"), ("sent 07.09.2030, ordered 2030-01-02", "2030-09-07"),
]


def test_dates(spark):
    check(spark, T.normalize_date, [(a, b and dt.date.fromisoformat(b)) for a, b in DATES])
    got = run(spark, T.find_dates, ["x 05/06/2030 y 2030-07-08 z 9 June 2030 w 25/06/2030"])[0]
    assert [(str(r["date"]), r["matched"], r["ambiguous"]) for r in got] == [
        ("2030-06-05", "05/06/2030", True), ("2030-07-08", "2030-07-08", False), ("2030-06-09", "9 June 2030", False), ("2030-06-25", "25/06/2030", False)
    ]
    check(spark, lambda x: T.normalize_date(x, F.lit("MDY")), [("02/11/2030", dt.date(2030, 2, 11)), ("25/11/2030", dt.date(2030, 11, 25))])


US, ES = "Pine Ridge Tools\n9 Lake Rd, Boise, ID 83702\n", "Talleres Robledal\nVAT ESA87654321\n"


def test_order_and_titles(spark):
    check(spark, T.date_order, [
        ("sent 02/11/2030\nbefore 12/24/2030", "MDY"), ("enviado 02/11/2030\nantes 24/12/2030", "DMY"), (US + "sent 02/11/2030", "MDY"), (ES + "enviado 02/11/2030", "DMY"),
        ("£ 77.10\nsent 02/11/2030", "DMY"), ("sent 02/11/2030", None), (US + ES + "sent 02/11/2030", None), ("24/12/2030 12/24/2030 €", None), (None, None),
    ])
    check(spark, T.is_credit_note, [
        ("Credit memo 44", True), ("AVOIR A-9", True), ("Gutschrift zur Rechnung 3", True), ("Nota di credito 81", True), ("Rechnung 5\nZahlung ohne Abzug", False),
        ("Correction of bill 4", False), ("Bill 9\n4.00", False), ("\n\n" + "y\n\n" * 14 + "gutschrift", True), ("y\n" * 15 + "gutschrift", False),
    ])


TOKENS = [
    ("8,430.75", "8430.75", False), ("8.430,75", "8430.75", False), ("91,06", "91.06", False), ("-77,40", "-77.40", False), ("4.125", "4125", True), ("4,125", "4125", True),
    ("9.876.543", "9876543", False), ("33.10", "33.10", False), ("615", "615", False), ("7.12345", None, None), ("3.1.22", None, None), ("(33.10)", None, None), ("8'430.5", "8430.5", False),
]


def test_amounts(spark):
    got = run(spark, A.parse_amount, [t for t, _, _ in TOKENS])
    assert [(g and g["value"], g and g["ambiguous"]) for g in got] == [(v and D(v), a) for _, v, a in TOKENS]
    check(spark, A.normalize_amount, [(a, b and D(b)) for a, b in [
        ("Total Due: $2,600.00 USD", "2600"), ("1 234,56", "1234.56"), ("1 234,56", "1234.56"), ("1 234,56", "1234.56"), ("1'234.50", "1234.50"), ("1’234.50", "1234.50"),
        ("12 345 678,90", "12345678.90"), ("(1,234.56)", "-1234.56"), ("1,234.56-", "-1234.56"), ("1.234,56-", "-1234.56"), ("-1 234,56", "-1234.56"), ("−5,00", "-5"), ("M12", None), ("21%", None),
        ("2 500.00", "2500"), ("", None), (None, None),
    ]])
    values = lambda x: F.transform(A.find_amounts(x), lambda a: a["value"].cast("string"))
    got = run(spark, values, ["rate (8%) of lot K77: 92.50 CHF", "3.\n 4,50\n a piece", "Fax (808) 022", "K-77 6", "20£ 9 m"])
    assert [[float(v) for v in g] for g in got] == [[92.5], [3.0, 4.5], [808.0, 22.0], [6.0], [20.0, 9.0]]
    check(spark, lambda x: A.normalize_amount(x, F.lit(True)), [("88.125", D("88.125")), ("2,088.125", D("2088.125")), ("2,088", D("2088"))])
    check(spark, lambda x: A.mixed_amount(x), [("$ 8.430,70", D("8430.70")), ("8430.7", D("8430.70")), ("x", None)])


def test_currencies(spark):
    check(spark, A.normalize_currency, [
        ("DKK", "DKK"), ("8.430,75 €", "EUR"), ("£91.06", "GBP"), ("$91.06 CAD", "CAD"), ("TVA ICE BTW", None), ("php", "PHP"), ("THB 9", "THB"), ("MAD", "MAD"), ("8 złotych", "PLN"), ("9 Kč", "CZK"),
        ("7 kr", "SEK"), ("SFr. 8.00", "CHF"), ("3 euro", "EUR"), ("NZ$ 4", "NZD"), ("HK$ 3", "HKD"), ("TOP CUP ALL", None), (None, None),
    ])
    flags = lambda x: F.transform(A.find_currencies(x), lambda c: F.concat(c["code"], F.when(c["ambiguous"], "?").otherwise("")))
    assert run(spark, flags, ["$77.10", "kr 8 CHF ¥ £"]) == [["USD?"], ["CHF", "JPY?", "GBP", "SEK?"]]
    check(spark, A.has_three_decimals, [("pay JOD 88.125", True), ("88.125 TND", True), ("pay SEK 4.125", False)])
    check(spark, A.local_dollar, [(US, "USD"), (US + "£", None), ("$", None)])


def test_tax_ids(spark):
    check(spark, A.normalize_tax_id, [
        ("FR 12 345 678 901", "FR12345678901"), ("A-11223344", "A11223344"), ("ATU12345678", "ATU12345678"), ("12-3456789", "123456789"), ("8% 77.10", None), ("(8%): 92.50 CHF", None),
        ("800.123.456-7", "8001234567"), ("20-11223344-5", "20112233445"), ("XAXX010101000", "XAXX010101000"), ("198765432M", "198765432M"), ("777-888-99-00", "7778889900"),
        ("VRDGPP65A01L219K", "VRDGPP65A01L219K"), ("(PT) 501234567", "501234567"), ("(MX) XAXX010101000", "XAXX010101000"), ("A-11223344 CIF: ESA11223344", "A11223344"),
        ("SE556677889901 VAT SE55", "SE556677889901"), ("Bill", None), ("77881", None), ("QWERTYUIOP7", None), ("", None), (None, None),
    ])
    df = spark.createDataFrame([("PT501234567", "501234567"), ("501234567", "501234567"), ("FR501234567", "A11223344"), ("PT501234567", "509999999")], "a string, b string")
    assert [r[0] for r in df.select(A.same_tax_id(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_text(spark):
    check(spark, X.normalize_text, [("  Robledal   Talleres ", "Robledal Talleres"), ("   ", None), (": q;,", "q"), (None, None)])
    check(spark, X.canon, [("Ölmühle & Söhne 7", "olmuhlesohne7"), ("Gießen", "giessen"), ("Łódź", "lodz")])
    check(spark, X.squash, [(" P  q\nR ", "p q r")])
    check(spark, X.soft, [("Robledal  S.L.", "robledal s.l"), (None, None)])
    check(spark, X.is_label, [("Sum", True), ("Sum 8", False), ("**", False)])
    check(spark, X.is_blank, [(None, True), ("\u3000 ", True), ("q", False)])
    check(spark, X.western_digits, [("٨٧۶", "876")])
    check(spark, X.before_comma, [("Robledal / Q, R", "Robledal"), ("\u00a0Robledal\u202f", "Robledal")])
    check(spark, X.without_space, [("a b\u00a0c\n", "abc")])
    check(spark, lambda x: X.after_label(x, "Vendor"), [("Vendor:\n\n  Robledal\nq", "Robledal"), ("q", None)])
    check(spark, X.request_id, [("z-9.y:X", "z-9.y:X")])
    assert len(run(spark, X.request_id, ["no id"])[0]) == 32
    pages = lambda x: X.page_of(F.array(F.lit("Left  side"), F.lit("Right side")), x)
    check(spark, pages, [("RIGHT\nside", 2), ("left side", 1), ("middle", None), ("", None), (None, None)])


def test_fold_is_that_of_the_unicode_tables(spark):
    texts = ["Ångström ﬁ Ⅷ", None, "", "Łódź Straße", "Nguyễn Thị Ánh", "ΣΊΣΥΦΟΣ ᾳ", "İstanbul ıI", "𝐀𝒃 ﷺ ㎏", "ＡＢＣ１２３", "e\u0301\u0323 a", "Ǆ ǆ ŉ ẖ", "שָׁלוֹם", "x" * 5_000 + "ß"]
    texts += ["".join(chr(c) for c in range(k, k + 400)) for k in (0x80, 0x1E00, 0x2100, 0xF900, 0xFB00, 0x1D400)]
    assert run(spark, X.fold_full, texts) == run(spark, X.fold_exact, texts)


def test_printed_forms(spark):
    forms = lambda x: A.is_printed(x, A.printed_forms(F.lit(8430.7).cast("decimal(10,2)")))
    check(spark, forms, [("pay 8.430,70 CHF", True), ("pay 8,430.70", True), ("18.430,70", False), ("8430.705", False), ("8 430,70", True)])
