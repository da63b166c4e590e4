"""Queries of quarters between two neighbours of one key set."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import phases as P
from quarterlode.operators import sandwich as W
from quarterlode.plans.phase_queries import _IN, _KEPT, _KEYS, _OUT, _PLAIN, _SUM, _pairs
from quarterlode.plans.registry import query

#: Members by type; every sixth quarter one runs away, lacks two, has two of them as one, or has a member of its own.
SWINGS = """swing AS (SELECT company_id, q_index, member_key, member_key AS name, CAST(sum(value) AS DECIMAL(24,3)) AS value FROM (SELECT company_id, q_index, CASE WHEN (company_id + q_index) % 6 = 0 AND member_key = 'LARGE' THEN value * 30 ELSE value END AS value,
    CASE WHEN (company_id + q_index) % 6 = 3 AND company_id % 2 = 0 AND member_key = 'MEDIUM' THEN 'otherrevenue' WHEN (company_id + q_index) % 6 = 4 AND member_key = 'ECONOMY' THEN 'odd' WHEN (company_id + q_index) % 6 = 5 AND member_key IN ('STANDARD', 'SMALL') THEN 'bundle' ELSE lower(member_key) END AS member_key
    FROM segments WHERE NOT ((company_id + q_index) % 6 = 3 AND member_key IN ('PROMO', 'SMALL'))) x GROUP BY company_id, q_index, member_key),
  swung AS (SELECT q.company_id, q.q_index, CAST(CASE WHEN (q.company_id + q.q_index) % 6 = 3 THEN s.total * 1.2 WHEN q.q_index % 9 = 1 THEN s.total * 4 ELSE s.total END AS DECIMAL(20,2)) AS total, CASE WHEN q.company_id % 8 = 5 THEN 'plain' END AS style, CASE WHEN q.q_index % 8 = 7 THEN 'fallback-reported' WHEN q.company_id % 3 = 0 THEN 'official-groups' ELSE 'official-segments' END AS source,
    CAST(CASE WHEN q.q_index % 4 = 1 THEN NULL WHEN q.q_index % 4 = 2 THEN 1 ELSE 0.9 END AS DECIMAL(10,4)) AS coverage, true AS has_raw, q.q_index % 11 = 3 AS reported_only, q.company_id % 2 = 1 AS insufficient, q.q_index % 5 = 0 AS filled, false AS smoothed
    FROM quarters q JOIN (SELECT company_id, q_index, sum(value) AS total FROM segments GROUP BY company_id, q_index) s ON s.company_id = q.company_id AND s.q_index = q.q_index)"""
_STABLE = "list_sort(list_distinct(list_filter(" + _KEYS + ", lambda k: k NOT IN ('otherrevenue', 'reportedrevenue'))))"
_PART = "coalesce(list_filter({0}, lambda r: r.key = {1})[1].v, 0)::DOUBLE / nullif({2}, 0)"
BETWEEN = f"""{SWINGS},
  prof0 AS (SELECT s.* REPLACE (CAST(s.total * 1000 AS BIGINT) AS total), coalesce(r.rows, []) AS rows FROM swung s LEFT JOIN (SELECT company_id, q_index, list({{'key': member_key, 'v': CAST(value * 1000 AS BIGINT), 'opt': member_key IN ('otherrevenue', 'reportedrevenue')}} ORDER BY value DESC, member_key) AS rows FROM swing GROUP BY ALL) r USING (company_id, q_index)),
  prof AS (SELECT * EXCLUDE (k), CASE WHEN len({_PLAIN.format('k')}) >= 2 THEN {_PLAIN.format('k')} ELSE k END AS profile FROM (SELECT *, {_KEPT.format('rows')} AS k FROM prof0) x),
  near AS (SELECT *, lag(rows) OVER w AS pr, lead(rows) OVER w AS nr, lag(total) OVER w AS pt, lead(total) OVER w AS nt, lag(source) OVER w AS psrc, lead(source) OVER w AS nsrc, lag(q_index) OVER w AS pq FROM prof WINDOW w AS (PARTITION BY company_id ORDER BY q_index)),
  near2 AS (SELECT *, {_STABLE.format('pr')} AS pk, {_STABLE.format('nr')} AS nk, {_STABLE.format('rows')} AS ck, {_SUM.format('pr')}::DOUBLE AS ps, {_SUM.format('nr')}::DOUBLE AS ns, {_SUM.format('rows')}::DOUBLE AS cs, (pt + nt)::DOUBLE / 2 AS mean FROM near),
  apart AS (SELECT * FROM near2 WHERE total > 20 AND pt > 20 AND nt > 20 AND len(pr) >= 2 AND len(nr) >= 2 AND len(pk) > 0 AND pk = nk AND ck <> pk)"""
_MEAN = f"({_PART.format('pr', '{0}', 'ps')} + {_PART.format('nr', '{0}', 'ns')}) / 2"
STRICT = f"""{BETWEEN},
  strict AS (SELECT *, list_filter(pk, lambda k: NOT list_contains(ck, k)) AS miss, list_filter(ck, lambda k: NOT list_contains(pk, k)) AS more, CASE WHEN {_SUM.format("list_filter(rows, lambda r: r.key = 'otherrevenue')")} > 20 THEN {_SUM.format("list_filter(rows, lambda r: r.key = 'otherrevenue')")} ELSE greatest(total - {_SUM.format("list_filter(rows, lambda r: r.key NOT IN ('otherrevenue', 'reportedrevenue'))")}, 0) END AS gap
    FROM apart WHERE source = 'official-segments' AND psrc <> 'fallback-reported' AND nsrc <> 'fallback-reported' AND (coverage IS NULL OR coverage BETWEEN 0.72 AND 1.6) AND (mean <= 20 OR total::DOUBLE / mean BETWEEN 0.45 AND 1.85)),
  want AS (SELECT company_id, q_index, gap, k AS key, {_MEAN.format('k')} AS w FROM (SELECT *, unnest(miss) AS k FROM strict WHERE len(more) = 0 AND gap > 120)),
  given AS (SELECT * FROM (SELECT company_id, q_index, gap, key, round(gap::DOUBLE * w / sum(w) OVER v)::BIGINT AS v, sum(w) OVER v AS all_ FROM want WINDOW v AS (PARTITION BY company_id, q_index)) WHERE all_ > 1e-6 AND v > 20),
  gaps AS (SELECT company_id, q_index, any_value(gap) - sum(v) AS left_ FROM given GROUP BY 1, 2),
  mixed AS (SELECT company_id, q_index, total, k AS key, {_MEAN.format('k')} AS s FROM (SELECT *, unnest(pk) AS k FROM strict ANTI JOIN gaps USING (company_id, q_index))),
  blended AS (SELECT *, round(total::DOUBLE * (s / sum(s) OVER (PARTITION BY company_id, q_index)))::BIGINT AS v, row_number() OVER (PARTITION BY company_id, q_index ORDER BY s DESC, key) AS k FROM mixed WHERE s > 0),
  whole AS (SELECT n.company_id, n.q_index, NULL AS mode, unnest(n.rows) AS r FROM near2 n ANTI JOIN strict USING (company_id, q_index) UNION ALL SELECT s.company_id, s.q_index, 'gap-filled', unnest(list_filter(s.rows, lambda r: r.key <> 'otherrevenue' AND r.v > 20)) FROM strict s SEMI JOIN gaps USING (company_id, q_index))"""


def between(t):
    return P.profiles(t.sql("SELECT * FROM swing", SWINGS), t.sql("SELECT * FROM swung", SWINGS))


def listed(df):
    return df.select("company_id", "q_index", "mode", F.explode("rows").alias("r")).select("company_id", "q_index", F.col("r.key").alias("member_key"), F.col("r.v").alias("thousandths"), "mode")


@query("b22_sandwich_segments", """SELECT company_id, q_index, r.key AS member_key, r.v AS thousandths, mode FROM whole UNION ALL SELECT company_id, q_index, key, v, 'gap-filled' FROM given UNION ALL SELECT company_id, q_index, 'otherrevenue', left_::BIGINT, 'gap-filled' FROM gaps WHERE left_ > 30
  UNION ALL SELECT company_id, q_index, key, (v + CASE WHEN k = 1 AND abs(total - sum(v) OVER (PARTITION BY company_id, q_index)) > 4 THEN total - sum(v) OVER (PARTITION BY company_id, q_index) ELSE 0 END)::BIGINT, 'harmonized' FROM blended""", STRICT)
def b22(t):
    return listed(W.sandwich_segments(between(t)))


GROUPS = f"""{BETWEEN}, {_pairs('c.q_index > a.q_index AND c.q_index - a.q_index <= 40')},
  taken AS (SELECT a.company_id, a.q_index, a.total, p.rows AS rows, {_SUM.format('p.rows')}::HUGEINT AS s FROM apart a JOIN pair p ON p.company_id = a.company_id AND p.q_index = a.pq AND p.q2 = a.q_index WHERE a.source = 'official-groups' AND (a.coverage IS NULL OR a.coverage BETWEEN 0.95 AND 1.05) AND p.comparable AND {_STABLE.format('p.rows')} = a.pk),
  cov AS (SELECT *, s::DOUBLE / total::DOUBLE AS c FROM taken),
  grown AS (SELECT company_id, q_index, r.key AS key, CASE WHEN c > 1.12 THEN (2 * r.v::HUGEINT * total::HUGEINT + s) // (2 * s) ELSE r.v END AS v FROM (SELECT *, unnest(rows) AS r FROM cov WHERE c >= 0.62) UNION ALL SELECT company_id, q_index, 'otherrevenue', total - s FROM cov WHERE c >= 0.62 AND c < 0.94 AND total - s > 30)"""


@query("b22_sandwich_groups", "SELECT company_id, q_index, r.key AS member_key, r.v AS thousandths, NULL AS mode FROM (SELECT company_id, q_index, unnest(rows) AS r FROM near2 ANTI JOIN taken USING (company_id, q_index)) UNION ALL SELECT company_id, q_index, key, sum(v)::BIGINT, 'groups-aligned' FROM grown GROUP BY 1, 2, 3", GROUPS)
def b22_groups(t):
    return listed(W.sandwich_groups(between(t)))


REBALANCE = f"""{BETWEEN},
  same AS (SELECT *, list_sort({_KEYS.format('rows')}) AS keys FROM near2 WHERE len(rows) >= 2 AND len(pr) >= 2 AND len(nr) >= 2 AND total > 20 AND list_sort({_KEYS.format('rows')}) = list_sort({_KEYS.format('pr')}) AND list_sort({_KEYS.format('rows')}) = list_sort({_KEYS.format('nr')})
    AND NOT coalesce(has_raw AND NOT reported_only AND NOT insufficient AND NOT filled AND source <> 'fallback-reported' AND (coverage IS NULL OR coverage BETWEEN 0.94 AND 1.12) AND {_SUM.format("list_filter(rows, lambda r: r.key = 'otherrevenue')")}::DOUBLE / total <= 0.05, false) AND CASE WHEN mean > 20 THEN total::DOUBLE / mean ELSE 1 END < 1.3),
  spread AS (SELECT company_id, q_index, total, k AS key, i, own / cs AS s, {_MEAN.format('k')} AS m FROM (SELECT * EXCLUDE (r), r.key AS k, r.v::DOUBLE AS own FROM (SELECT *, unnest(rows) AS r, unnest(range(1, len(rows) + 1)) AS i FROM same) x) y),
  off AS (SELECT company_id, q_index FROM spread GROUP BY 1, 2 HAVING max(abs(s - m)) > 0.3 AND max(s) > 0.68),
  even AS (SELECT *, round(total::DOUBLE * least(m, 1))::BIGINT AS v FROM spread SEMI JOIN off USING (company_id, q_index))"""


@query("b23_rebalance", "SELECT company_id, q_index, r.key AS member_key, r.v AS thousandths, NULL AS mode FROM (SELECT company_id, q_index, unnest(rows) AS r FROM near2 ANTI JOIN off USING (company_id, q_index)) UNION ALL SELECT company_id, q_index, key, (v + CASE WHEN i = 1 AND abs(total - sum(v) OVER (PARTITION BY company_id, q_index)) > 4 THEN total - sum(v) OVER (PARTITION BY company_id, q_index) ELSE 0 END)::BIGINT, 'rebalanced' FROM even", REBALANCE)
def b23(t):
    return listed(W.rebalance(between(t)))
