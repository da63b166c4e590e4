"""Queries of a quarter's rows: gaps, costs by segment, capping, choice among sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import rows as W
from quarterlode.plans.registry import query

#: Segments with holes: some members of some quarters are missing, some quarters have a residual or none at all.
HOLES = """holes AS (SELECT company_id, q_index, lower(member_key) AS member_key, CAST(value AS DECIMAL(24,3)) AS value FROM segments WHERE NOT ((company_id + q_index) % 4 = 0 AND member_key IN ('PROMO', 'SMALL')) AND NOT ((company_id + q_index) % 9 = 0 AND member_key <> 'LARGE') AND (company_id * 3 + q_index) % 14 <> 0
  UNION ALL SELECT company_id, q_index, 'otherrevenue', CAST(revenue * 0.2 AS DECIMAL(24,3)) FROM quarters WHERE (company_id + q_index) % 8 = 0),
  spans AS (SELECT company_id, q_index, revenue AS total, revenue, CASE WHEN q_index % 6 <> 2 THEN 'styled' END AS style, company_id % 5 <> 0 AS harmonize, CAST(CASE WHEN q_index % 3 = 0 THEN 0.5 ELSE 0.9 END AS DECIMAL(10,4)) AS coverage, q_index % 10 = 4 AS low, CAST(CASE WHEN q_index % 2 = 0 THEN 0.5 END AS DECIMAL(12,6)) AS scale FROM quarters)"""
_MAPS = HOLES + """, summed AS (SELECT company_id, q_index, sum(value)::DOUBLE AS s, count(*) AS n, max(value)::DOUBLE AS top, string_agg(member_key, '|' ORDER BY member_key) AS every_key, coalesce(string_agg(member_key, '|' ORDER BY member_key) FILTER (member_key <> 'otherrevenue'), '') AS keys, sum(value) FILTER (member_key <> 'otherrevenue')::DOUBLE AS plain, max(value) FILTER (member_key = 'otherrevenue')::DOUBLE AS rest FROM holes GROUP BY ALL),
  line AS (SELECT q.*, coalesce(s.every_key, '') AS every_key, coalesce(s.keys, '') AS keys, coalesce(s.n, 0) AS n, s.plain, s.rest, CASE WHEN s.s > 0.02 THEN s.top / s.s ELSE 0 END AS top FROM spans q LEFT JOIN summed s USING (company_id, q_index)),
  near AS (SELECT *, lag(q_index) OVER w AS pq, lead(q_index) OVER w AS nq, lag(every_key) OVER w AS pe, lead(every_key) OVER w AS ne, lag(keys) OVER w AS pk, lead(keys) OVER w AS nk, lag(n) OVER w AS pn, lag(harmonize) OVER w AND lead(harmonize) OVER w AND harmonize AS ok FROM line WINDOW w AS (PARTITION BY company_id ORDER BY q_index)),
  shares AS (SELECT h.company_id, h.q_index, h.member_key, h.value::DOUBLE / s.s AS share FROM holes h JOIN summed s USING (company_id, q_index) WHERE s.s > 0.02)"""
_FILL = _MAPS + """, gaps AS (SELECT company_id, q_index, pq, nq, CASE WHEN coalesce(rest, 0) > 0.02 THEN rest ELSE greatest(total::DOUBLE - plain, 0) END AS gap, list_filter(string_split(pk, '|'), lambda k: NOT list_contains(string_split(keys, '|'), k)) AS lack FROM near WHERE ok AND pk <> '' AND pk = nk AND keys <> '' AND len(list_filter(string_split(keys, '|'), lambda k: NOT list_contains(string_split(pk, '|'), k))) = 0),
  weights AS (SELECT g.company_id, g.q_index, g.gap, g.k AS member_key, (coalesce(p.share, 0) + coalesce(n.share, 0)) / 2 AS w FROM (SELECT *, unnest(lack) AS k FROM gaps WHERE len(lack) BETWEEN 1 AND 2 AND gap > 0.12) g LEFT JOIN shares p ON p.company_id = g.company_id AND p.q_index = g.pq AND p.member_key = g.k LEFT JOIN shares n ON n.company_id = g.company_id AND n.q_index = g.nq AND n.member_key = g.k),
  made AS (SELECT * FROM (SELECT company_id, q_index, gap, member_key, round(gap * w / sum(w) OVER (PARTITION BY company_id, q_index), 3) AS value FROM weights) WHERE value > 0.02)"""


def holes(t):
    return t.sql("SELECT * FROM holes", HOLES), t.sql("SELECT * FROM spans", HOLES)


@query("b14_fill_missing_keys", "SELECT company_id, q_index, member_key, value FROM made UNION ALL SELECT company_id, q_index, 'otherrevenue', round(any_value(gap) - sum(value), 3) FROM made GROUP BY company_id, q_index HAVING round(any_value(gap) - sum(value), 3) > 0.03", _FILL)
def b14(t):
    return W.fill_missing_keys(*holes(t))


_BLEND = _MAPS + """, want AS (SELECT * FROM near WHERE ok AND pn >= 2 AND pe = ne AND (n < 2 OR low OR every_key <> pe) AND NOT (every_key <> pe AND n >= 2 AND top < 0.82 AND coverage BETWEEN 0.7 AND 1.28) AND total > 0.02),
  mixed AS (SELECT w.company_id, w.q_index, w.total::DOUBLE AS total, p.member_key, (p.share + n.share) / 2 AS s FROM want w JOIN shares p ON p.company_id = w.company_id AND p.q_index = w.pq JOIN shares n ON n.company_id = w.company_id AND n.q_index = w.nq AND n.member_key = p.member_key),
  valued AS (SELECT *, round(total * s / sum(s) OVER (PARTITION BY company_id, q_index), 3) AS v, row_number() OVER (PARTITION BY company_id, q_index ORDER BY member_key) AS r FROM mixed)"""


@query("b15_blend_neighbours", "SELECT company_id, q_index, member_key, round(v + CASE WHEN r = 1 AND abs(round(total - sum(v) OVER (PARTITION BY company_id, q_index), 3)) > 0.004 THEN round(total - sum(v) OVER (PARTITION BY company_id, q_index), 3) ELSE 0 END, 3) AS value FROM valued", _BLEND)
def b15(t):
    return W.blend_neighbours(*holes(t))


COSTS = """costs_ AS (SELECT company_id, q_index, revenue, CASE WHEN q_index % 9 <> 0 THEN cost_of_revenue END AS cost_of_revenue, CASE WHEN q_index % 9 <> 0 THEN CAST(coalesce(gross_profit, revenue - cost_of_revenue) AS DECIMAL(20,2)) END AS gross_profit, CASE WHEN q_index % 2 = 0 THEN sgna END AS sgna, rnd,
  CAST(CASE WHEN q_index % 3 = 0 THEN cost_of_revenue + sgna + rnd WHEN q_index % 3 = 1 THEN revenue * 1.5 ELSE operating_expenses END AS DECIMAL(20,2)) AS operating_expenses, CAST(CASE WHEN q_index % 4 = 0 THEN operating_income WHEN q_index % 4 = 1 THEN NULL ELSE revenue - cost_of_revenue * 2 - sgna - rnd END AS DECIMAL(20,2)) AS operating_income,
  CAST(CASE WHEN company_id % 3 = 0 THEN cost_of_revenue + sgna + rnd ELSE 0 END AS DECIMAL(20,2)) AS opex_items FROM statements),
  c1 AS (SELECT *, CASE WHEN operating_expenses IS NOT NULL THEN greatest(operating_expenses, 0) END AS o, greatest(revenue, 0) AS r, greatest(coalesce(sgna, 0), 0) + greatest(coalesce(rnd, 0), 0) AS said, revenue IS NOT NULL AND gross_profit IS NOT NULL AND cost_of_revenue IS NOT NULL AS staged FROM costs_),
  c2 AS (SELECT *, CASE WHEN staged THEN greatest(o - greatest(cost_of_revenue, 0), 0) END AS less, r - o AS profit, CASE WHEN operating_income IS NOT NULL AND gross_profit IS NOT NULL THEN greatest(gross_profit - operating_income, 0) END AS dv FROM c1),
  c3 AS (SELECT *, coalesce(staged AND o > gross_profit + 0.25 AND o <= r + greatest(0.35, r * 0.02) AND less <= gross_profit + greatest(0.35, gross_profit * 0.04), false) AND NOT (opex_items > 0.05 AND coalesce(abs(opex_items - o) <= greatest(0.35, opex_items * 0.05), false))
    AND (operating_income IS NULL OR coalesce(abs(operating_income - (gross_profit - o)) <= greatest(0.35, o * 0.015), false) OR coalesce(operating_income < profit - greatest(0.4, abs(profit) * 0.08), false) OR (said > 0.05 AND coalesce(less >= said - 0.35, false))) AS whole,
    coalesce(o > gross_profit + 0.25, false) AS ov, abs(o - dv) <= 0.25 OR CASE WHEN dv > 0.05 THEN abs(o - dv) <= dv * 0.08 ELSE abs(o - dv) <= 0.08 END OR (coalesce(opex_items > 0.05 AND abs(opex_items - o) <= greatest(0.35, opex_items * 0.05), false) AND CASE WHEN dv > 0.05 THEN abs(o - dv) <= dv * 0.12 ELSE abs(o - dv) <= 0.12 END) AS nr FROM c2),
  c4 AS (SELECT *, ov OR coalesce(o > r + 0.25, false) AS much FROM c3)"""
_VALUE = "CASE WHEN o IS NULL THEN dv WHEN dv IS NULL THEN CASE WHEN much THEN 0 ELSE o END WHEN nr AND NOT ov THEN o ELSE dv END"
_SURE = "coalesce(CASE WHEN o IS NULL THEN false WHEN dv IS NULL THEN NOT much ELSE nr AND NOT ov END, false)"


@query("v2_normalize_operating_stage", f"SELECT company_id, q_index, CASE WHEN whole THEN less ELSE {_VALUE} END AS operating_expenses, CASE WHEN whole THEN profit ELSE operating_income END AS operating_income, {_SURE} AND NOT whole AS opex_reliable, whole AS includes_cost FROM c4", COSTS, money="operating_expenses operating_income")
def v2(t):
    at = t.sql("SELECT * FROM costs_", COSTS.split(",\n  c1 AS")[0])
    return W.normalize_operating_stage(at).select("company_id", "q_index", "operating_expenses", "operating_income", "opex_reliable", "includes_cost")


@query("v3_resolve_opex", f"SELECT company_id, q_index, {_VALUE} AS operating_expenses, {_SURE} AS opex_reliable FROM c4", COSTS, money="operating_expenses")
def v3(t):
    from quarterlode.operators.bridge import resolve_opex

    at = t.sql("SELECT * FROM costs_", COSTS.split(",\n  c1 AS")[0])
    return resolve_opex(at).select("company_id", "q_index", "operating_expenses", "opex_reliable")


MARGINS = HOLES + """, margins AS (SELECT company_id, m AS member_key, CAST(CASE m WHEN 'small' THEN 93.7 WHEN 'large' THEN -40 ELSE 51.3 END AS DECIMAL(6,2)) AS margin_pct FROM companies CROSS JOIN (SELECT 'small' AS m UNION ALL SELECT 'large' UNION ALL SELECT 'medium' UNION ALL SELECT 'promo' UNION ALL SELECT 'economy' UNION ALL SELECT 'standard' UNION ALL SELECT 'otherrevenue') n WHERE NOT (company_id % 3 = 1 AND m = 'standard') AND NOT (company_id % 3 = 2 AND m IN ('standard', 'economy'))),
  cost_t AS (SELECT company_id, q_index, CAST(cost AS DECIMAL(20,2)) AS total FROM quarters)"""


@query("v9_profile_cost", """SELECT company_id, q_index, member_key, value FROM (SELECT *, CASE WHEN own IS NULL THEN CASE WHEN open_ = 1 THEN greatest(total - coalesce(s, 0), 0) END WHEN open_ = 0 AND abs(total::DOUBLE / s::DOUBLE - 1) > 0.015 THEN round(own::DOUBLE * (total::DOUBLE / s::DOUBLE), 3) ELSE own END::DOUBLE AS value FROM (
  SELECT *, count(*) FILTER (own IS NULL) OVER w AS open_, sum(own) OVER w AS s FROM (SELECT h.company_id, h.q_index, h.member_key, c.total, CAST(round(h.value * (100 - least(greatest(m.margin_pct, -20), 99.5)) / 100, 3) AS DECIMAL(24,3)) AS own FROM holes h JOIN cost_t c USING (company_id, q_index) LEFT JOIN margins m ON m.company_id = h.company_id AND m.member_key = h.member_key WHERE h.value > 0.02 AND c.total > 0.02) WINDOW w AS (PARTITION BY company_id, q_index))) WHERE value IS NOT NULL""", MARGINS)  # fmt: skip
def v9(t):
    return W.profile_cost(t.sql("SELECT * FROM holes", MARGINS), t.sql("SELECT * FROM margins", MARGINS), t.sql("SELECT * FROM cost_t", MARGINS))


TAC = """tac_t AS (SELECT company_id, q_index, cost AS cost_of_revenue, CAST(CASE WHEN q_index % 5 <> 0 THEN cost * CASE WHEN q_index % 7 = 0 THEN 1.2 ELSE 0.4 END END AS DECIMAL(20,2)) AS tac, CASE WHEN q_index % 2 = 0 THEN tax END AS other FROM quarters)"""


@query("v10_tac_split", "SELECT company_id, q_index, 'TAC' AS name, tac AS value FROM tac_t WHERE tac > 0.02 UNION ALL SELECT company_id, q_index, 'Other', coalesce(other, greatest(cost_of_revenue - tac, 0)) FROM tac_t WHERE tac > 0.02 AND coalesce(other, greatest(cost_of_revenue - tac, 0)) > 0.02", TAC, money="value")
def v10(t):
    return W.tac_split(t.sql("SELECT * FROM tac_t", TAC))


_INFER = HOLES + """, own AS (SELECT h.company_id, h.q_index, q.revenue, q.revenue - h.s AS rest FROM (SELECT company_id, q_index, sum(value) AS s FROM holes WHERE value > 0.02 GROUP BY ALL) h JOIN spans q USING (company_id, q_index) WHERE q.revenue > 0.2 AND q.style IS NOT NULL AND q.revenue - h.s > greatest(0.08, q.revenue * 0.06)),
  cand AS (SELECT o.company_id, o.q_index, o.rest, h.member_key, round(sum((0.55::DOUBLE + least(greatest(h.value::DOUBLE / q.revenue::DOUBLE, 0.04::DOUBLE), 1.2::DOUBLE)) / abs(h.q_index - o.q_index)), 9) AS score, min(abs(h.q_index - o.q_index)) AS near FROM own o JOIN holes h ON h.company_id = o.company_id AND h.q_index <> o.q_index JOIN spans q ON q.company_id = h.company_id AND q.q_index = h.q_index
    WHERE h.value > 0.02 AND h.member_key <> 'otherrevenue' AND NOT EXISTS (SELECT 1 FROM holes x WHERE x.company_id = o.company_id AND x.q_index = o.q_index AND x.member_key = h.member_key AND x.value > 0.02) GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM cand WINDOW w AS (PARTITION BY company_id, q_index ORDER BY score DESC, near, member_key))"""


@query("v12_infer_residual", "SELECT company_id, q_index, member_key, rest AS value FROM placed WHERE r = 1 AND score >= CASE WHEN second IS NULL AND near <= 24 THEN 0.28 ELSE 0.55 END AND (second IS NULL OR score >= second * 1.18)", _INFER, money="value")
def v12(t):
    return W.infer_residual(*holes(t))


_NEARBY = HOLES + """, own AS (SELECT company_id, q_index, count(*) AS n, sum(value) AS s FROM holes WHERE value > 0.02 GROUP BY ALL),
  pick AS (SELECT b.company_id, b.q_index, b.revenue, o.q_index AS q2, o.s FROM spans b JOIN own o ON o.company_id = b.company_id AND abs(o.q_index - b.q_index) BETWEEN 1 AND 2 JOIN spans q ON q.company_id = o.company_id AND q.q_index = o.q_index WHERE b.revenue > 0.2 AND NOT EXISTS (SELECT 1 FROM own x WHERE x.company_id = b.company_id AND x.q_index = b.q_index) AND o.n >= 2 AND q.revenue > 0.02 AND o.s / q.revenue BETWEEN 0.62 AND 1.18
    QUALIFY row_number() OVER (PARTITION BY b.company_id, b.q_index ORDER BY round(abs(o.q_index - b.q_index) * 100 - o.n * 4 + abs(o.s / q.revenue - 1)::DOUBLE * 20, 9), o.q_index) = 1)"""


@query("v13_interpolate_nearby", "SELECT p.company_id, p.q_index, h.member_key, round(h.value::DOUBLE * p.revenue::DOUBLE / p.s::DOUBLE, 3) AS value, p.q2 AS from_q FROM pick p JOIN holes h ON h.company_id = p.company_id AND h.q_index = p.q2 WHERE h.value > 0.02", _NEARBY)
def v13(t):
    return W.interpolate_nearby(*holes(t))


MANY = """many AS (SELECT company_id, q_index, member_key, CAST(sum(value) AS DECIMAL(24,3)) AS value FROM details WHERE target_name IN ('SMALL', 'LARGE', 'PROMO') GROUP BY ALL),
  goal AS (SELECT company_id, q_index, CAST(sum(value) * CASE q_index % 4 WHEN 0 THEN 1 WHEN 1 THEN 1.4 WHEN 2 THEN 0.6 ELSE 0.97 END AS DECIMAL(20,2)) AS revenue FROM many GROUP BY company_id, q_index)"""
_CAP = MANY + """, ordered AS (SELECT m.*, g.revenue, row_number() OVER w AS r, count(*) OVER (PARTITION BY company_id, q_index) AS n FROM many m JOIN goal g USING (company_id, q_index) WINDOW w AS (PARTITION BY company_id, q_index ORDER BY value DESC, member_key)),
  top AS (SELECT * FROM ordered WHERE n <= 7 OR r <= 6), sums AS (SELECT company_id, q_index, any_value(revenue) AS revenue, sum(value) AS s, count(*) AS k, list(value ORDER BY r) AS v FROM top GROUP BY ALL),
  whole AS (SELECT *, CASE WHEN s < revenue - 0.08 AND revenue - s > 0.02 THEN revenue ELSE s END > revenue + 0.08 AND k + CASE WHEN s < revenue - 0.08 THEN 1 ELSE 0 END > 1 AS over_ FROM sums),
  walk AS (WITH RECURSIVE f AS (SELECT company_id, q_index, revenue, v, 0 AS i, 0::DECIMAL(24,3) AS t, 0 AS kept, []::INT[] AS took FROM whole WHERE over_ UNION ALL
    SELECT company_id, q_index, revenue, v, i + 1, CASE WHEN kept < 6 AND (t + v[i + 1] <= revenue + 0.04 OR kept < 2) THEN t + v[i + 1] ELSE t END::DECIMAL(24,3), CASE WHEN kept < 6 AND (t + v[i + 1] <= revenue + 0.04 OR kept < 2) THEN kept + 1 ELSE kept END, CASE WHEN kept < 6 AND (t + v[i + 1] <= revenue + 0.04 OR kept < 2) THEN list_append(took, i + 1) ELSE took END FROM f WHERE i < len(v)) SELECT * FROM f WHERE i = len(v))"""


@query("v16_cap_and_balance", """SELECT t.company_id, t.q_index, t.member_key, t.value FROM top t JOIN whole w USING (company_id, q_index) LEFT JOIN walk f USING (company_id, q_index) WHERE NOT w.over_ OR list_contains(f.took, t.r)
  UNION ALL SELECT company_id, q_index, 'otherrevenue', revenue - s FROM whole WHERE NOT over_ AND s < revenue - 0.08 UNION ALL SELECT company_id, q_index, 'otherrevenue', revenue - t FROM walk WHERE revenue - t > 0.02""", _CAP, money="value")  # fmt: skip
def v16(t):
    return W.cap_and_balance(t.sql("SELECT * FROM many", MANY), t.sql("SELECT * FROM goal", MANY))


@query("v16_flows_to_revenue", """SELECT company_id, q_index, member_key, CAST(value AS DOUBLE) AS value, CASE WHEN over_ AND r = n THEN greatest(revenue::DOUBLE - coalesce(sum(f) OVER (PARTITION BY company_id, q_index ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) ELSE f END AS flow FROM (
  SELECT *, CASE WHEN over_ THEN round(value::DOUBLE * revenue::DOUBLE / s::DOUBLE, 3) ELSE value::DOUBLE END AS f FROM (SELECT *, s > revenue + greatest(0.02, revenue * 0.002) AS over_ FROM (SELECT *, sum(value) OVER (PARTITION BY company_id, q_index) AS s FROM ordered)))""", _CAP)  # fmt: skip
def v16b(t):
    return W.flows_to_revenue(t.sql("SELECT * FROM many", MANY), t.sql("SELECT * FROM goal", MANY))


DET = """det AS (SELECT company_id, q_index, lower(target_name) AS target, lower(member_key) AS member_key, CAST(value AS DECIMAL(24,3)) AS value FROM details WHERE q_index % 2 = 0 OR substr(member_key, 7) IN ('1', '7', '12', '20')), par AS (SELECT company_id, q_index, lower(member_key) AS member_key, CAST(value AS DECIMAL(24,3)) AS value FROM segments WHERE member_key <> 'SMALL')"""


@query("v17_detail_groups", "SELECT company_id, q_index, target, member_key, value, row_number() OVER (PARTITION BY company_id, q_index ORDER BY parent, value DESC, member_key) AS place FROM (SELECT d.company_id, d.q_index, d.target, d.member_key, d.value, p.r AS parent, count(*) OVER (PARTITION BY d.company_id, d.q_index, d.target) AS n, p.value AS whole FROM det d JOIN (SELECT *, row_number() OVER (PARTITION BY company_id, q_index ORDER BY value DESC, member_key) AS r FROM par) p ON p.company_id = d.company_id AND p.q_index = d.q_index AND p.member_key = d.target WHERE d.value > 0.02) WHERE n > 1 OR value >= whole * 0.55", DET, money="value")
def v17(t):
    return W.detail_groups(t.sql("SELECT * FROM det", DET), t.sql("SELECT * FROM par", DET))


SOURCES = HOLES + """, preset AS (SELECT * FROM holes WHERE q_index % 13 = 0), official AS (SELECT * FROM holes WHERE company_id % 2 = 0 AND q_index % 3 <> 0)"""


@query("v23_history_groups", "SELECT h.company_id, h.q_index, h.member_key, CAST(round(h.value / coalesce(s.scale, 1), 3) AS DOUBLE) AS value FROM holes h JOIN spans s USING (company_id, q_index) WHERE h.value / coalesce(s.scale, 1) > 0.02", HOLES)
def v23(t):
    return W.history_groups(*holes(t))


@query("v25_choose_rows", """SELECT h.company_id, h.q_index, h.member_key, CAST(CASE WHEN src = 'history' THEN round(h.value / coalesce(s.scale, 1), 3) ELSE h.value END AS DOUBLE) AS value, src AS source FROM (SELECT *, CASE WHEN q_index % 13 = 0 THEN 'preset' WHEN company_id % 2 = 0 AND q_index % 3 <> 0 THEN 'official' ELSE 'history' END AS src FROM holes) h JOIN spans s USING (company_id, q_index)
  UNION ALL SELECT company_id, q_index, 'reportedrevenue', CAST(revenue AS DOUBLE), 'reported' FROM spans s WHERE revenue > 0.02 AND NOT EXISTS (SELECT 1 FROM holes h WHERE h.company_id = s.company_id AND h.q_index = s.q_index)""", SOURCES)  # fmt: skip
def v25(t):
    h, s = holes(t)
    return W.choose_rows(t.sql("SELECT * FROM preset", SOURCES), t.sql("SELECT * FROM official", SOURCES), h, s).select("company_id", "q_index", "member_key", "value", "source")


@query("v8_choose_breakdown", "SELECT company_id, q_index, name, value, CASE source_id WHEN 'sF' THEN 'snapshot' WHEN 'sO' THEN 'official' ELSE 'generic' END AS source FROM labels_seen WHERE source_id IN ('sF', 'sO', 'sT') AND NOT (source_id = 'sF' AND q_index % 3 = 0) AND NOT (source_id = 'sO' AND q_index % 2 = 0) QUALIFY min(CASE source_id WHEN 'sF' THEN 0 WHEN 'sO' THEN 1 ELSE 2 END) OVER (PARTITION BY company_id, q_index) = CASE source_id WHEN 'sF' THEN 0 WHEN 'sO' THEN 1 ELSE 2 END", money="value")
def v8(t):
    take = lambda df: df.select("company_id", "q_index", "name", "value")
    rows = t.labels_seen
    return W.first_rows([("snapshot", take(rows.where("source_id = 'sF' and q_index % 3 <> 0"))), ("official", take(rows.where("source_id = 'sO' and q_index % 2 <> 0"))), ("generic", take(rows.where("source_id = 'sT'")))])


LABELS = """labelled AS (SELECT company_id, q_index, name, CAST(value AS DECIMAL(24,3)) AS value FROM segments UNION ALL SELECT company_id, q_index, 'Other ' || min(name), CAST(sum(value) / 10 AS DECIMAL(24,3)) FROM segments WHERE q_index % 2 = 0 GROUP BY company_id, q_index
  UNION ALL SELECT company_id, q_index, min(name) || ' and ' || max(name), CAST(sum(value) / 3 AS DECIMAL(24,3)) FROM segments WHERE q_index % 3 = 0 GROUP BY company_id, q_index HAVING count(*) > 1 UNION ALL SELECT company_id, q_index, CASE WHEN q_index % 4 = 0 THEN 'All other segments' ELSE 'Consolidated things' END, CAST(sum(value) AS DECIMAL(24,3)) FROM segments WHERE q_index % 4 < 2 GROUP BY company_id, q_index)"""
_PRUNE = LABELS + """, twelve AS (SELECT *, count(*) OVER (PARTITION BY company_id, q_index) AS n, lower(name) AS l, list_filter(string_split(lower(name), ' '), lambda w: w NOT IN ('and', 'other', 'services', 'service')) AS t FROM (SELECT * FROM labelled WHERE value > 0.02 QUALIFY row_number() OVER (PARTITION BY company_id, q_index ORDER BY value DESC, name) <= 12)),
  judged AS (SELECT *, n < 3 OR NOT ((l NOT LIKE 'other %' AND EXISTS (SELECT 1 FROM twelve o WHERE o.company_id = a.company_id AND o.q_index = a.q_index AND o.l = 'other ' || a.l)) OR contains(l, 'consolidated') OR l = 'all other segments' OR (contains(l, ' and ') AND len(t) >= 2
    AND (SELECT count(*) FROM twelve o WHERE o.company_id = a.company_id AND o.q_index = a.q_index AND o.name <> a.name AND NOT contains(o.l, 'consolidated') AND o.l <> 'all other segments' AND len(o.t) > 0 AND len(o.t) < len(a.t) AND len(list_filter(o.t, lambda w: NOT list_contains(a.t, w))) = 0) >= 2)) AS keep FROM twelve a)"""


@query("v14_prune_labels", "SELECT company_id, q_index, name, value FROM (SELECT *, bool_or(keep) OVER (PARTITION BY company_id, q_index) AS some_ FROM judged) WHERE keep OR NOT some_", _PRUNE, money="value")
def v14(t):
    return W.prune_labels(t.sql("SELECT * FROM labelled", LABELS))
