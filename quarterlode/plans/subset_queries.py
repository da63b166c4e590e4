"""Query of the rows that explain a quarter's revenue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import subsets as S
from quarterlode.plans.registry import query

#: Rows by type, returned goods apart, with labels that read like sums; revenue from half to five quarters of what they add up to.
OFFERED = """offered AS (SELECT company_id, q_index, name, concat('m', lower(name)) AS member_key, CAST(sum(revenue) * CAST(0.00001 AS DECIMAL(6,5)) AS DECIMAL(24,3)) AS value FROM (SELECT l.company_id, CAST(year(l.start_date) * 4 + quarter(l.start_date) - 1 AS INT) AS q_index, l.revenue,
    CASE WHEN l.l_returnflag = 'R' AND p.p_type = 'PROMO' THEN 'Consolidated & PROMO' WHEN l.l_returnflag = 'R' AND p.p_type <> 'LARGE' THEN concat(p.p_type, ' online') WHEN p.p_type = 'SMALL' THEN 'Corporate and other' ELSE p.p_type END AS name FROM lines l JOIN part p ON l.l_partkey = p.p_partkey) x GROUP BY company_id, q_index, name),
  aims AS (SELECT company_id, q_index, CAST(sum(value) * CAST(CASE q_index % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.95 WHEN 3 THEN 1.25 ELSE 3 END AS DECIMAL(3,2)) AS DECIMAL(24,3)) AS revenue, company_id % 4 = 1 AS styled, concat('Online ', company_id % 2, ' Company') AS company_name FROM offered GROUP BY company_id, q_index),
  hung AS (SELECT company_id, q_index, name AS target FROM offered WHERE company_id % 3 = 0 AND name = 'LARGE' UNION ALL SELECT company_id, q_index, 'Unknown thing' FROM offered WHERE company_id % 6 = 0 AND q_index % 6 = 1 AND name = 'LARGE')"""
_STOP = ", ".join(repr(w) for w in S.WORD_STOP)
SUBSET = f"""{OFFERED},
  it AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(replace(name, '&', ' ')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOP}) AND w NOT IN ('online', (company_id % 2)::VARCHAR))) AS tok,
    CASE WHEN contains(lower(name), 'consolidated') THEN 330 WHEN name = 'Corporate and other' THEN 18 ELSE 0 END AS cost, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, row_number() OVER (PARTITION BY company_id, q_index ORDER BY value DESC, name) - 1 AS i FROM offered WHERE value > 0.02),
  grp AS (SELECT i.company_id, i.q_index, CAST(any_value(a.revenue) * 1000 AS BIGINT) AS revenue, any_value(a.styled) AS styled, count(*) AS n, list({{'v': CAST(i.value * 1000 AS BIGINT), 'cost': i.cost, 'key': i.key, 'tok': i.tok}} ORDER BY i.i) AS items, coalesce(any_value(h.t), []) AS t FROM it i JOIN aims a USING (company_id, q_index)
    LEFT JOIN (SELECT company_id, q_index, list(DISTINCT regexp_replace(lower(target), '[^a-z0-9]', '', 'g')) AS t FROM hung GROUP BY 1, 2) h ON h.company_id = i.company_id AND h.q_index = i.q_index WHERE i.i < 12 GROUP BY 1, 2),
  g1 AS (SELECT *, list_sum(list_transform(items, lambda x: x.v))::DOUBLE / revenue::DOUBLE AS ratio, len(list_filter(items, lambda x: list_contains(t, x.key))) AS req FROM grp),
  g2 AS (SELECT *, revenue <= 0 OR (req > 0 AND req = len(t) AND n <= 7 AND ratio BETWEEN 0.72 AND 1.18) OR (styled AND ratio BETWEEN 0.78 AND 1.18) OR (n BETWEEN 3 AND 6 AND ratio BETWEEN 0.88 AND 1.18) AS every_ FROM g1),
  m0 AS (SELECT company_id, q_index, revenue, n, t, req, m, list_filter(items, lambda x, j: (m >> (j - 1)::INT) & 1 = 1) AS s FROM (SELECT *, unnest(range(1, (1 << n::INT))) AS m FROM g2 WHERE NOT every_)),
  m1 AS (SELECT *, len(s) AS k, list_sum(list_transform(s, lambda x: x.v))::BIGINT AS v, list_sum(list_transform(s, lambda x: x.cost)) AS cost, list_transform(s, lambda x: x.key) AS ks, list_transform(s, lambda x: x.tok) AS toks FROM m0 WHERE len(s) <= 7 AND (len(s) > 1 OR n = 1)),
  m2 AS (SELECT *, v::DOUBLE / revenue::DOUBLE AS r, (SELECT coalesce(sum(c * (c - 1) / 2), 0) FROM (SELECT count(*) AS c FROM (SELECT unnest(flatten(m1.toks)) AS w) GROUP BY w)) AS shared FROM m1 WHERE v::DOUBLE / revenue::DOUBLE BETWEEN 0.45 AND 1.35 AND (req = 0 OR len(list_filter(t, lambda x: NOT list_contains(ks, x))) = 0)),
  m3 AS (SELECT company_id, q_index, m, k, CASE WHEN k BETWEEN 3 AND 6 THEN 44 ELSE 0 END - abs(v - revenue)::DOUBLE / 1000 * 110 - CASE WHEN k > 5 THEN (k - 5) * 18 WHEN k < 3 AND n > 3 THEN (3 - k) * 40 ELSE 0 END - CASE WHEN r < 0.78 THEN (0.78::DOUBLE - r) * 260 WHEN r > 1.08 THEN (r - 1.08::DOUBLE) * 360 ELSE 0 END - cost - shared * 28 AS score FROM m2),
  best AS (SELECT company_id, q_index, list_reduce(list({{'m': m, 'k': k, 'score': score::DOUBLE}} ORDER BY m), lambda b, x: CASE WHEN x.score > b.score OR (abs(x.score - b.score) < 0.01 AND x.k < b.k) THEN x ELSE b END).m AS m FROM m3 GROUP BY 1, 2)"""


@query("v15_best_subset", "SELECT i.company_id, i.q_index, i.name, i.value, CASE WHEN g.every_ THEN 'all' WHEN b.m IS NOT NULL THEN 'subset' ELSE 'largest' END AS how FROM it i JOIN g2 g USING (company_id, q_index) LEFT JOIN best b USING (company_id, q_index) WHERE i.i < 12 AND (g.every_ OR CASE WHEN b.m IS NOT NULL THEN (b.m >> i.i::INT) & 1 = 1 ELSE i.i < 7 END)", SUBSET, money="value")
def v15(t):
    # With the same filter on both, Spark takes the rows' aggregate for the quarters' too.
    parts = [t.sql(f"SELECT * FROM {name}", OFFERED).where("company_id IS NOT NULL AND q_index IS NOT NULL") for name in ("offered", "aims", "hung")]
    return S.best_subset(*parts).select("company_id", "q_index", "name", "value", "how")
