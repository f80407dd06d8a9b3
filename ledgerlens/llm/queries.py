"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlens.llm import lookalikes, names, overlaps, packing, percentiles, reading, splits, tokens

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_split": splits.p1_split,
    "p1_shares": splits.p1_shares,
    "p3_found": names.p3_found,
    "p4_found": lookalikes.p4_found,
    "p4_forms": lookalikes.p4_forms,
    "p5_found": overlaps.p5_found,
    "p5_report": overlaps.p5_report,
    "p6_percentiles": percentiles.p6_percentiles,
    "p7_ids": tokens.p7_ids,
    "p8_packs": packing.p8_packs,
    "p8_fill": packing.p8_fill,
    "p9_found": reading.p9_found,
}

_RANKED = "".join(f", cast(quantile_disc(value, {p}) AS BIGINT) AS p{round(p * 100)}" for p in percentiles.RANKS)

#: The groups of cases by a recursion over their keys: sources and originals.
_GROUPS = r"""
    WITH RECURSIVE c AS (SELECT DISTINCT case_id, lower(source) AS source, lower(case_id) AS low FROM cases WHERE case_id IS NOT NULL),
    p AS (SELECT list(DISTINCT regexp_extract(case_id, '^([a-z]{3})_[0-9]{8}$', 1)) AS prefixes FROM c),
    h AS (SELECT *, regexp_extract(low, '^(|.*?[^0-9])[0-9]{8}(?:[^0-9]|$)', 1) AS head, regexp_extract(low, '(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)', 1) AS number FROM c),
    r AS (SELECT *, list_filter(regexp_extract_all(head, '[a-z]+'), lambda x: length(x) = 3) AS runs FROM h),
    k AS (SELECT case_id, 's:' || nullif(regexp_replace(regexp_extract(source, '([^/\\]*[^/\\\s][^/\\]*)[/\\\s]*$', 1), '[^\p{L}\p{N}]+', '', 'g'), '') AS s,
        CASE WHEN number <> '' AND len(runs) > 0 THEN 'o:' || coalesce(list_filter(runs, lambda x: list_contains(prefixes, x))[-1], runs[-1]) || '_' || number END AS o FROM r, p),
    n AS (SELECT case_id, coalesce(o, 'c:' || case_id) AS o, s FROM k),
    e AS (SELECT DISTINCT o AS a, s AS b FROM n WHERE s IS NOT NULL UNION SELECT DISTINCT s, o FROM n WHERE s IS NOT NULL),
    t(a, b) AS (SELECT o, o FROM n UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
    g AS (SELECT a, min(case_id) AS group_id, count(DISTINCT case_id) AS members FROM t JOIN n ON n.o = t.b GROUP BY a),
    grouped AS (SELECT DISTINCT n.case_id, g.group_id, g.members FROM n JOIN g ON g.a = n.o)
"""

ORACLES = {
    "p1_found": f"{_GROUPS} SELECT case_id, group_id FROM grouped WHERE members > 1",
    "p1_shares": f"""{_GROUPS},
        s AS (SELECT unnest(['train', 'validation', 'test']) AS new_split, unnest([0.8, 0.1, 0.1]) AS share)
        SELECT new_split, round(share * (SELECT count(*) FROM grouped), 6)::DOUBLE AS wanted, 0::BIGINT AS parted, true AS near FROM s
    """,
    "p6_percentiles": f"""
        WITH once AS (
            SELECT min_by(row(model, cast(logged_at AT TIME ZONE 'UTC' AS DATE), latency_ms, output_tokens), received_at) AS r
            FROM llm_responses WHERE response_id IS NOT NULL GROUP BY response_id
        ), parts AS (
            SELECT struct_extract(r, 1) AS model, struct_extract(r, 2) AS day, struct_extract(r, 3) AS a, struct_extract(r, 4) AS b FROM once
        ), measured AS (
            SELECT model, day, 'latency_ms' AS metric, a AS value FROM parts WHERE a > 0
            UNION ALL SELECT model, day, 'output_tokens', b FROM parts WHERE b > 0
        )
        SELECT 'model_day' AS level, model, day, metric, count(*) AS n {_RANKED} FROM measured GROUP BY model, day, metric
        UNION ALL SELECT 'model', model, NULL, metric, count(*) {_RANKED} FROM measured GROUP BY model, metric
        UNION ALL SELECT 'day', NULL, day, metric, count(*) {_RANKED} FROM measured GROUP BY day, metric
        UNION ALL SELECT 'all', NULL, NULL, metric, count(*) {_RANKED} FROM measured GROUP BY metric
    """,
}
