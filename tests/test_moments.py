from pyspark.sql import functions as F

from ledgerlens.operators import moments as M

CASES = [
    # raw, zone, order, normal
    ("2026-03-01", None, None, "2026-03-01"), ("2022.01.10", None, "MDY", "2022-01-10"), ("20220104", None, None, "2022-01-04"),
    ("31/12/2022", None, None, "2022-12-31"), ("10/08/2022", "Europe/Berlin", None, None), ("08/08/2022", None, None, "2022-08-08"),
    ("10/08/22", None, "MDY", "2022-10-08"), ("10-8-2022", None, "DMY", "2022-08-10"), ("99/99/9999", None, "DMY", None), ("01/24/25", None, "DMY", None),
    ("29.02.2023", None, "DMY", None), ("29.02.2024", None, "DMY", "2024-02-29"), ("0000-00-00", None, None, None), ("2025-13-04", None, None, None),
    ("1641235900", None, None, "2022-01-03T18:51:40Z"), ("1641235900788", None, None, "2022-01-03T18:51:40Z"), ("1642860966845766", None, None, "2022-01-22T14:16:06Z"),
    ("1642222607.667", None, None, "2022-01-15T04:56:47Z"), ("2022-01-05T09:12:12", "Europe/Madrid", None, "2022-01-05T08:12:12Z"),
    ("2022-01-05T09:12:12", None, None, None), ("2022-01-05T09:12:12", "Mars/Phobos", None, None), ("2022-01-05 09:12", "Asia/Kolkata", None, "2022-01-05T03:42:00Z"),
    ("2023-03-12T02:36:00", "America/Chicago", None, None), ("2024-11-03 01:32", "America/Chicago", None, None),
    ("2024-11-03 01:32 CST", "America/Chicago", None, "2024-11-03T07:32:00Z"), ("11/03/2024 01:32 CST", "America/Chicago", "MDY", "2024-11-03T07:32:00Z"),
    ("11/03/2024 01:32 CDT", "America/Chicago", "MDY", "2024-11-03T06:32:00Z"), ("2024-11-03 01:32-05:00", "America/Chicago", None, "2024-11-03T06:32:00Z"),
    ("2022-02-04 07:04:53 Asia/Kolkata", None, None, "2022-02-04T01:34:53Z"), ("2022-01-07T06:57:11+09:00[Asia/Tokyo]", None, None, "2022-01-06T21:57:11Z"),
    ("2024-05-09T11:45:45-04:00[America/New_York]", None, None, "2024-05-09T15:45:45Z"), ("2024-05-09 11:45 Nowhere/Else", "Europe/Paris", None, None),
    ("20220212T051952+0100", None, None, "2022-02-12T04:19:52Z"), ("20220106T013910Z", None, None, "2022-01-06T01:39:10Z"),
    ("2022-01-26T11:48:48+01", None, None, "2022-01-26T10:48:48Z"), ("2022-01-06T08:25:10 +01:00", None, None, "2022-01-06T07:25:10Z"),
    ("2022-01-17T22:18:22z", None, None, "2022-01-17T22:18:22Z"), ("2022-01-07T02:38:50 UTC", None, None, "2022-01-07T02:38:50Z"),
    ("2022-01-05 07:29:28,875", "Europe/London", None, "2022-01-05T07:29:28Z"), ("2022-02-02 11:45:27.123456789", "Asia/Tokyo", None, "2022-02-02T02:45:27Z"),
    ("Fri, 10 Jan 2025 05:16:16 +0530", None, None, "2025-01-09T23:46:16Z"), ("Fri, 1 Jul 2022 23:24:03 GMT", None, None, "2022-07-01T23:24:03Z"),
    ("10. Januar 2022 00:07 Uhr", "Europe/Berlin", None, "2022-01-09T23:07:00Z"), ("10 de junio de 2024, 21:48 h", "Europe/Madrid", None, "2024-06-10T19:48:00Z"),
    ("10 avril 2025 à 11h44", "Europe/Paris", None, "2025-04-10T09:44:00Z"), ("1 décembre 2024 à 4h18", "Europe/Paris", None, "2024-12-01T03:18:00Z"),
    ("10 août 2024", None, None, "2024-08-10"), ("31. OKTOBER 2022", None, None, "2022-10-31"), ("1 DE FEBRERO DE 2023", None, None, "2023-02-01"),
    ("Apr 11, 2022 9:57 AM IST", "Asia/Kolkata", None, "2022-04-11T04:27:00Z"), ("September 15, 2023 12:08 AM", "America/New_York", None, "2023-09-15T04:08:00Z"),
    ("Apr 25, 2025 12:10 PM", "Europe/London", None, "2025-04-25T11:10:00Z"), ("Apr 25, 2025 13:10 PM", "Europe/London", None, None),
    ("10 August 2023 09:14 GMT+2", None, None, "2023-08-10T07:14:00Z"), ("31 January 2025 04:29 GMT-6", None, None, "2025-01-31T10:29:00Z"),
    ("2022年1月15日", None, None, "2022-01-15"), ("2022年10月10日 1時24分", "Asia/Tokyo", None, "2022-10-09T16:24:00Z"), ("31/03/2025 04:21:05 BST", "Europe/London", "DMY", "2025-03-31T03:21:05Z"),
    (" \t(10/08/2022) ", None, "DMY", "2022-08-10"), ("\"2026-03-01\".", None, None, "2026-03-01"), ("pending", None, None, None), ("12:45", "Europe/Paris", "DMY", None),
    ("Q3", None, None, None), ("", None, None, None), (None, "Europe/Paris", "DMY", None), ("x" * 100_000, None, None, None), ("2022-01-05T25:00:00Z", None, None, None),
    ("9999-12-31T23:59:59-05:00", None, None, None), ("2024-06-31T10:00:00Z", None, None, None), ("12 Foo 2024", None, None, None), ("2024-01-01 10:00 XYZ", "Europe/Paris", None, None),
]


def test_forms_and_zones(spark):
    rows = [(k, raw, z, o, "day kept") for k, (raw, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, raw string, zone string, date_order string, note string")
    for session_zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            got = {r["id"]: r["normal"] for r in M.normalise(spark, df).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        wrong = [(c, got[k]) for k, c in enumerate(CASES) if got[k] != c[3]]
        assert not wrong
    assert M.normalise(spark, df.limit(0)).count() == 0


def test_every_hour_of_a_year_against_zoneinfo(spark):
    import datetime as dt
    import zoneinfo

    name = "Europe/Madrid"
    zone, rows, want = zoneinfo.ZoneInfo(name), [], {}
    for h in range(0, 24 * 366 * 2):
        local = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * h)
        a, b = (local.replace(tzinfo=zone, fold=f) for f in (0, 1))
        real = a.astimezone(dt.UTC).astimezone(zone).replace(tzinfo=None) == local
        one = real and a.utcoffset() == b.utcoffset()
        rows.append((h, local.strftime("%Y-%m-%d %H:%M"), name, None))
        want[h] = a.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if one else None
    df = spark.createDataFrame(rows, "id int, raw string, zone string, date_order string")
    assert {r["id"]: r["normal"] for r in M.normalise(spark, df).collect()} == want


def test_zone_estimate(spark):
    base = 1_700_000_000
    rows = [("k", base + 9 * 3600 + d * 86400, base + d * 86400 if d % 3 else None, base + d * 86400 + 60) for d in range(300)]
    rows += [("e", base + 10 * 86400, None, base + 10 * 86400), (None, base, None, base), ("n", None, None, base)]
    df = spark.createDataFrame(rows, "key string, local long, known long, ingested long")
    zones = ["America/New_York", "Asia/Tokyo", "Europe/Berlin"]
    got = {r["key"]: (r["zone"], r["violations"]) for r in M.estimate_zones(spark, df, zones).collect()}
    assert got == {"k": ("Asia/Tokyo", 0), "e": (None, 0)}  # Berlin and Tokyo are both before the arrival
    assert M.estimate_zones(spark, df.where(F.lit(False)), zones).count() == 0
    assert M.estimate_zones(spark, df, []).count() == 0


def test_changes_of_any_size_and_other_scripts(spark):
    cases = [
        ("2010-03-05 00:30", "Antarctica/Casey", None),  # shown twice, three hours apart
        ("2024-04-07 01:45", "Australia/Lord_Howe", None),  # half an hour
        ("2011-12-30 12:00", "Pacific/Apia", None),  # a day that was skipped
        ("2011-12-31 12:00", "Pacific/Apia", "2011-12-30T22:00:00Z"),
        ("2022-01-02 12:45:46 America/New_York", "Europe/Berlin", "2022-01-02T17:45:46Z"),
        ("２０２２-01-02", None, "2022-01-02"), ("Mo., 10. Januar 2022", None, "2022-01-10"), ("Jan 5, 22", None, "2022-01-05"),
        ("10-Jan-2022 9:57 a. m.", "UTC", "2022-01-10T09:57:00Z"), ("٢٠٢٢-٠١-٠٢", None, "2022-01-02"),
    ]
    df = spark.createDataFrame([(k, r, z) for k, (r, z, _) in enumerate(cases)], "k int, raw string, zone string").selectExpr("*", "cast(null as string) date_order")
    got = {r["k"]: r["normal"] for r in M.normalise(spark, df).collect()}
    assert got == {k: n for k, (_, _, n) in enumerate(cases)}


def test_ties_have_no_zone(spark):
    pairs = [("a", 1_650_000_000, 1_650_000_000 - 7200, None), ("b", 1_650_000_000, None, None), ("c", 1_650_000_000, None, 1_650_000_000 - 3600), (None, 5, 5, None)]
    df = spark.createDataFrame(pairs, "key string, local long, known long, ingested long")
    got = {r["key"]: (r["zone"], r["tied"], r["n"], r["violations"]) for r in M.estimate_zones(spark, df, ["America/Lima", "Europe/Berlin", "Europe/London", "UTC"]).collect()}
    # April: Berlin is two hours ahead; London, an hour ahead, and Berlin are not after the arrival.
    assert got == {"a": ("Europe/Berlin", 1, 1, 0), "b": (None, 4, 1, 0), "c": (None, 2, 1, 0)}
