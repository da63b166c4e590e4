"""Queries of history sources and residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import candidates as H
from quarterlode.plans.registry import query

BASE = """base AS (SELECT company_id, q_index, lower(member_key) AS member_key, name, CAST(value AS DECIMAL(24,3)) AS value, CAST(period_end + (CASE WHEN q_index % 9 = 0 THEN 600 WHEN q_index % 7 = 0 THEN 1000 ELSE 40 END) * INTERVAL '1' DAY AS DATE) AS filing_date FROM segments
  UNION ALL SELECT company_id, q_index, 'sizes', 'Sizes', CAST(sum(value) * CASE WHEN q_index % 2 = 0 THEN 1.1 ELSE 1.5 END AS DECIMAL(24,3)), CAST(make_date(2005, 1, 1) AS DATE) FROM segments WHERE member_key IN ('SMALL', 'MEDIUM', 'LARGE') AND q_index % 3 = 0 GROUP BY company_id, q_index)"""
PARENTS = {"sizes": ("small", "medium", "large"), "cheap": ("economy", "promo")}
_PAR = "CASE WHEN member_key IN ('small', 'medium', 'large', 'sizes') THEN 'sizes' WHEN member_key IN ('economy', 'promo') THEN 'cheap' END"


@query("b2_rollup_complete", """SELECT company_id, q_index, CASE WHEN whole THEN par ELSE member_key END AS member_key, CASE WHEN whole THEN CASE WHEN own > 0.02 AND own / s BETWEEN 0.82 AND 1.18 THEN own ELSE s END ELSE value END AS value FROM (
  SELECT b.*, g.*  EXCLUDE (company_id, q_index, par), b2.par, coalesce(g.n = CASE b2.par WHEN 'sizes' THEN 3 ELSE 2 END AND g.s > 0.02, false) AS whole, row_number() OVER (PARTITION BY b.company_id, b.q_index, b2.par ORDER BY b.value DESC) AS r
  FROM base b, LATERAL (SELECT """ + _PAR.replace("member_key", "b.member_key") + """ AS par) b2 LEFT JOIN (SELECT company_id, q_index, par, count(*) FILTER (member_key <> par) AS n, sum(value) FILTER (member_key <> par) AS s, max(value) FILTER (member_key = par) AS own
    FROM (SELECT *, """ + _PAR + """ AS par FROM base) GROUP BY ALL) g ON g.company_id = b.company_id AND g.q_index = b.q_index AND g.par = b2.par) WHERE NOT whole OR r = 1""", BASE, money="value")  # fmt: skip
def b2(t):
    return H.rollup_complete(t.sql("SELECT * FROM base", BASE), PARENTS).select("company_id", "q_index", "member_key", "value")


DETAIL = BASE + """, det AS (SELECT company_id, q_index, lower(target_name) AS target, member_key, member_key AS name, CAST(value * CASE WHEN q_index % 4 = 1 THEN 0.5 ELSE 1 END AS DECIMAL(24,3)) AS value, CAST(make_date(2000, 1, 1) AS DATE) AS filing_date FROM details WHERE NOT (q_index % 3 = 1 AND substr(member_key, 7, 1) <> '1')),
  plainbase AS (SELECT * FROM base WHERE member_key <> 'sizes')"""


@query("b3_expand_details", """SELECT company_id, q_index, member_key, value FROM plainbase b WHERE NOT EXISTS (SELECT 1 FROM took x WHERE x.company_id = b.company_id AND x.q_index = b.q_index AND x.member_key = b.member_key)
  UNION ALL SELECT d.company_id, d.q_index, d.member_key, d.value FROM det d JOIN took x ON x.company_id = d.company_id AND x.q_index = d.q_index AND x.member_key = d.target WHERE d.value > 0.02""",
       DETAIL + """, cand AS (SELECT b.company_id, b.q_index, b.member_key, d.k, n.rows_ FROM plainbase b JOIN (SELECT company_id, q_index, target, count(*) AS k, sum(value) AS s FROM det WHERE value > 0.02 GROUP BY ALL) d ON d.company_id = b.company_id AND d.q_index = b.q_index AND d.target = b.member_key AND d.k >= 2
    JOIN (SELECT company_id, q_index, count(*) AS rows_ FROM plainbase GROUP BY ALL) n ON n.company_id = b.company_id AND n.q_index = b.q_index WHERE b.member_key IN ('economy', 'promo') AND b.value > 0.02 AND d.s / b.value BETWEEN 0.72 AND 1.08),
  one AS (SELECT *, rows_ - 1 + k <= 7 AS ok FROM cand WHERE member_key = 'economy'), two AS (SELECT c.*, c.rows_ + CASE WHEN o.ok THEN o.k - 1 ELSE 0 END - 1 + c.k <= 7 AS ok FROM cand c LEFT JOIN one o USING (company_id, q_index) WHERE c.member_key = 'promo'),
  took AS (SELECT company_id, q_index, member_key FROM one WHERE ok UNION ALL SELECT company_id, q_index, member_key FROM two WHERE ok)""", money="value")  # fmt: skip
def b3(t):
    base, det = t.sql("SELECT * FROM plainbase", DETAIL), t.sql("SELECT * FROM det", DETAIL)
    return H.expand_details(base, det, ("economy", "promo")).select("company_id", "q_index", "member_key", "value")


SOURCED = BASE + """, sourced AS (SELECT company_id, q_index, 'official-segments' AS source, member_key, name, value, filing_date FROM base WHERE q_index % 5 <> 2
  UNION ALL SELECT company_id, q_index, 'structure-history', member_key, CASE WHEN q_index % 2 = 0 THEN 'Operating segments' ELSE name END, CAST(value * CASE WHEN company_id % 3 = 0 THEN 0.3 ELSE 0.8 END AS DECIMAL(24,3)), filing_date FROM base WHERE q_index % 4 <> 1),
  entry_t AS (SELECT company_id, q_index, CASE WHEN q_index % 10 <> 3 THEN revenue END AS revenue, end_date AS period_end FROM quarters)"""
SCORE = SOURCED + """, per AS (SELECT s.company_id, s.q_index, source, count(*) AS n, sum(value) AS s, max(value) AS top, count(*) FILTER (contains(lower(name), 'operating segments')) AS whole, median(filing_date - period_end) AS lag, any_value(revenue) AS revenue
    FROM sourced s LEFT JOIN entry_t USING (company_id, q_index) GROUP BY ALL),
  scored AS (SELECT *, CASE WHEN n >= 2 THEN 22 ELSE -14 END + CASE WHEN n >= 3 THEN 5 ELSE 0 END - greatest(n - 7, 0) * 4 - greatest(n - 10, 0) * 5
    + CASE WHEN cover IS NULL THEN 0 WHEN abs(cover - 1) <= 0.08 THEN 18 WHEN abs(cover - 1) <= 0.25 THEN 10 WHEN cover < 0.36 OR cover > 1.4 THEN -18 ELSE 2 END - CASE WHEN top / s > 0.84 AND n >= 3 THEN 8 ELSE 0 END
    - CASE WHEN whole >= 2 AND n >= 4 THEN whole * 4 ELSE 0 END + CASE WHEN lag > 900 THEN -16 WHEN lag > 540 THEN -10 WHEN lag < -2 THEN -6 WHEN lag <= 260 THEN 3 ELSE 0 END AS score FROM (SELECT *, CASE WHEN revenue > 0.02 THEN s / revenue END AS cover FROM per)),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY company_id, q_index ORDER BY score DESC, coalesce(abs(cover - 1), 1e9), n DESC, source) = 1)"""


def sourced(t):
    """The tables sourced and entry_t of SOURCED; rows of both sources are laid out from one read of base."""
    laid_out = """SELECT company_id, q_index, x.source, member_key, x.name, x.value, filing_date FROM (SELECT *, explode(filter(array(
      CASE WHEN q_index % 5 <> 2 THEN named_struct('source', 'official-segments', 'name', name, 'value', value) END,
      CASE WHEN q_index % 4 <> 1 THEN named_struct('source', 'structure-history', 'name', CASE WHEN q_index % 2 = 0 THEN 'Operating segments' ELSE name END, 'value', CAST(value * CASE WHEN company_id % 3 = 0 THEN 0.3 ELSE 0.8 END AS DECIMAL(24,3))) END), y -> y IS NOT NULL)) AS x FROM base) laid"""
    return t.sql(laid_out, BASE), t.sql("SELECT * FROM entry_t", SOURCED)


#: The same scores with shares held against their bounds in whole thousandths: as doubles a share that lies on a bound may fall to either side.
EXACT = SOURCED + """, per AS (SELECT s.company_id, s.q_index, source, count(*) AS n, CAST(sum(value) * 1000 AS HUGEINT) AS s, CAST(max(value) * 1000 AS HUGEINT) AS top, count(*) FILTER (contains(lower(name), 'operating segments')) AS whole, median(filing_date - period_end) AS lag, CAST(any_value(revenue) * 1000 AS HUGEINT) AS revenue
    FROM sourced s LEFT JOIN entry_t USING (company_id, q_index) GROUP BY ALL),
  scored AS (SELECT *, CASE WHEN n >= 2 THEN 22 ELSE -14 END + CASE WHEN n >= 3 THEN 5 ELSE 0 END - greatest(n - 7, 0) * 4 - greatest(n - 10, 0) * 5
    + CASE WHEN revenue IS NULL OR revenue <= 20 THEN 0 WHEN abs(s - revenue) * 100 <= revenue * 8 THEN 18 WHEN abs(s - revenue) * 100 <= revenue * 25 THEN 10 WHEN s * 100 < revenue * 36 OR s * 100 > revenue * 140 THEN -18 ELSE 2 END - CASE WHEN top * 100 > s * 84 AND n >= 3 THEN 8 ELSE 0 END
    - CASE WHEN whole >= 2 AND n >= 4 THEN whole * 4 ELSE 0 END + CASE WHEN lag > 900 THEN -16 WHEN lag > 540 THEN -10 WHEN lag < -2 THEN -6 WHEN lag <= 260 THEN 3 ELSE 0 END AS score FROM per)"""


@query("b4_score_candidate", "SELECT company_id, q_index, source, score::BIGINT AS score, n FROM scored", EXACT)
def b4(t):
    return H.score_candidate(*sourced(t)).select("company_id", "q_index", "source", "score", "n")


@query("b5_pick_history_source", "SELECT s.company_id, s.q_index, s.member_key, s.value, s.source FROM sourced s JOIN best b USING (company_id, q_index, source) UNION ALL SELECT company_id, q_index, 'reportedrevenue', revenue, 'fallback-reported' FROM entry_t WHERE revenue > 0.02 AND NOT EXISTS (SELECT 1 FROM sourced x WHERE x.company_id = entry_t.company_id AND x.q_index = entry_t.q_index)", SCORE, money="value")
def b5(t):
    return H.pick_history_source(*sourced(t)).select("company_id", "q_index", "member_key", "value", "source")


@query("b6_merge_canonical", "SELECT company_id, q_index, member_key, arg_max(name, (filing_date, value, length(trim(name)), name)) AS name, CAST(max(value) AS DOUBLE) AS value FROM sourced WHERE value > 0.02 GROUP BY company_id, q_index, member_key", SOURCED)
def b6(t):
    return H.merge_canonical(sourced(t)[0]).select("company_id", "q_index", "member_key", "name", "value")


SHARES = """share_t AS (SELECT company_id, q_index + 1 AS q_index, member_key, CAST(CAST(value AS DECIMAL(20,2)) / sum(value) OVER (PARTITION BY company_id, q_index) AS DECIMAL(14,8)) AS share FROM segments)"""


@query("b17_rows_from_shares", """SELECT company_id, q_index, member_key, value + CASE WHEN r = 1 AND abs(rest) > 0.004 THEN rest ELSE 0 END AS value FROM (SELECT *, round(total - sum(value) OVER (PARTITION BY company_id, q_index), 3) AS rest, row_number() OVER (PARTITION BY company_id, q_index ORDER BY member_key) AS r FROM (
  SELECT s.company_id, s.q_index, member_key, q.revenue AS total, CAST(round(CAST(q.revenue AS DOUBLE) * share / sum(share) OVER (PARTITION BY s.company_id, s.q_index), 3) AS DECIMAL(24,3)) AS value FROM share_t s JOIN quarters q USING (company_id, q_index) WHERE share > 0))""", SHARES, money="value")  # fmt: skip
def b17(t):
    return H.rows_from_shares(t.sql("SELECT * FROM share_t", SHARES), t.quarters.select("company_id", "q_index", F.col("revenue").alias("total")))


OTHERS = """oth AS (SELECT company_id, q_index, lower(member_key) AS member_key, CAST(value AS DECIMAL(24,3)) AS value FROM segments WHERE member_key <> 'PROMO' OR q_index % 4 <> 0
  UNION ALL SELECT company_id, q_index, 'otherrevenue', CAST(revenue * CASE q_index % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.01 WHEN 2 THEN 0.35 ELSE 0.08 END AS DECIMAL(24,3)) FROM quarters WHERE q_index % 5 <> 0),
  quarter_t AS (SELECT company_id, q_index, revenue AS total, CAST(CASE WHEN q_index % 3 = 0 THEN 0.65 ELSE 0.9 END AS DECIMAL(10,4)) AS coverage, CASE WHEN company_id % 3 = 0 THEN 'official-groups' WHEN company_id % 3 = 1 THEN 'official-segments' ELSE 'none' END AS source, CASE WHEN company_id % 4 = 0 THEN 'styled' END AS style FROM quarters)"""


def others(t):
    return t.sql("SELECT * FROM oth", OTHERS), t.sql("SELECT * FROM quarter_t", OTHERS)


@query("b19_drop_sparse", """SELECT o.company_id, o.q_index, o.member_key, o.value FROM oth o JOIN quarter_t q USING (company_id, q_index) WHERE NOT (member_key = 'otherrevenue' AND value < total * 0.015)
  AND NOT EXISTS (SELECT 1 FROM oth r WHERE r.company_id = o.company_id AND r.q_index = o.q_index AND r.member_key = 'otherrevenue' AND r.value > q.total * 0.28 AND q.style IS NULL AND q.source = 'official-segments' AND q.coverage < 0.72)""", OTHERS, money="value")  # fmt: skip
def b19(t):
    return H.drop_sparse(*others(t))


@query("b20_absorb_residual", """SELECT company_id, q_index, member_key, CAST(value AS DOUBLE) + CASE WHEN ok THEN CAST(round(CAST(rest AS DOUBLE) * w / sum(w) FILTER (member_key <> 'otherrevenue') OVER (PARTITION BY company_id, q_index), 3) AS DOUBLE) ELSE 0 END AS value, ok AS absorbed FROM (
  SELECT o.company_id, o.q_index, o.member_key, o.value, k.rest, k.ok, coalesce(p.value / kp.s, 0)::DOUBLE + coalesce(n.value / kn.s, 0)::DOUBLE AS w FROM oth o JOIN okay k USING (company_id, q_index) LEFT JOIN kinds kp ON kp.company_id = k.company_id AND kp.q_index = k.pq LEFT JOIN kinds kn ON kn.company_id = k.company_id AND kn.q_index = k.nq
    LEFT JOIN oth p ON p.company_id = o.company_id AND p.q_index = k.pq AND p.member_key = o.member_key LEFT JOIN oth n ON n.company_id = o.company_id AND n.q_index = k.nq AND n.member_key = o.member_key WHERE NOT (k.ok AND o.member_key = 'otherrevenue'))""",
       OTHERS + """, kinds AS (SELECT company_id, q_index, sum(value) AS s, max(value) FILTER (member_key = 'otherrevenue') AS rest, coalesce(string_agg(member_key, '|' ORDER BY member_key) FILTER (member_key <> 'otherrevenue'), '') AS keys, count(*) FILTER (member_key <> 'otherrevenue') AS named FROM oth GROUP BY ALL),
  okay AS (SELECT *, coalesce(rest IS NOT NULL AND source <> 'official-groups' AND NOT (source = 'official-segments' AND coverage >= 0.85 AND named >= 2) AND keys <> '' AND keys = pk AND keys = nk AND rest / total > 0.01 AND rest / total <= 0.1, false) AS ok FROM (
    SELECT k.*, q.total, q.coverage, q.source, lag(keys) OVER w AS pk, lead(keys) OVER w AS nk, lag(k.q_index) OVER w AS pq, lead(k.q_index) OVER w AS nq FROM kinds k JOIN quarter_t q USING (company_id, q_index) WINDOW w AS (PARTITION BY k.company_id ORDER BY k.q_index)))""")  # fmt: skip
def b20(t):
    return H.absorb_residual(*others(t))
