"""Queries of regimes and phases of a segment history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import phases as P
from quarterlode.operators import templates as T
from quarterlode.plans.registry import query

#: Histories with changing members: bundled before a cut, renamed for a while, dropped, reported as one; styles that change.
REGIME = """regime AS (SELECT company_id, q_index, member_key, member_key AS name, CAST(sum(value) AS DECIMAL(24,3)) AS value FROM (SELECT company_id, q_index, value,
    CASE WHEN company_id % 4 = 1 AND q_index < 7990 + company_id % 3 AND member_key IN ('PROMO', 'SMALL') THEN 'bits' WHEN company_id % 4 = 2 AND q_index % 13 < 5 AND member_key <> 'LARGE' THEN concat('old', lower(member_key))
      WHEN company_id % 4 = 3 AND q_index % 6 = 2 THEN 'reportedrevenue' WHEN (company_id + q_index) % 5 = 0 AND member_key = 'MEDIUM' THEN 'otherrevenue' ELSE lower(member_key) END AS member_key
    FROM segments WHERE NOT (company_id % 4 = 0 AND q_index % 3 = 0 AND member_key IN ('PROMO', 'ECONOMY')) AND (company_id * 5 + q_index) % 17 <> 0) x GROUP BY company_id, q_index, member_key),
  stretch AS (SELECT company_id, q_index, CAST(CASE WHEN q_index % 5 = 1 THEN revenue * 1.25 WHEN q_index % 7 = 3 THEN revenue * 0.75 ELSE revenue END AS DECIMAL(20,2)) AS total,
    CASE WHEN company_id % 4 = 3 THEN CASE WHEN q_index < 7990 THEN 'classic' ELSE 'modern' END WHEN company_id % 8 = 0 THEN 'plain' END AS style,
    (company_id + q_index) % 9 <> 0 AS reliable, q_index % 7 * 100000 AS source_score, company_id % 4 = 3 AND q_index % 6 = 2 AS reported_only, (company_id + q_index) % 8 = 3 AS insufficient, company_id % 5 = 0 AS harmonize, q_index % 11 = 5 AS partial,
    CASE WHEN q_index % 10 = 4 THEN 'fallback-reported' ELSE 'official-segments' END AS source, CASE company_id % 3 WHEN 0 THEN CASE WHEN q_index < 7990 THEN 'old' ELSE 'new' END WHEN 1 THEN concat('s', q_index) ELSE concat('t', q_index % 16) END AS schema, concat('f', q_index % 2) AS family, CAST(CASE WHEN q_index % 2 = 0 THEN 0.9 ELSE 1 END AS DECIMAL(10,4)) AS coverage FROM quarters)"""
_KEYS = "list_transform({0}, lambda r: r.key)"
_SUM = "coalesce(list_sum(list_transform({0}, lambda r: r.v)), 0)::BIGINT"
_OUT = "list_filter({0}, lambda r: NOT list_contains({1}, r.key))"
_IN = "list_filter({0}, lambda r: list_contains({1}, r.key))"
_KEPT = "list_filter({0}, lambda r: r.key <> 'reportedrevenue' AND r.v > 20)"
_PLAIN = "list_filter({0}, lambda r: NOT r.opt)"
_SHARE = "({0})::DOUBLE / greatest({1}, 1)::DOUBLE"
PROFILE = f"""{REGIME},
  prof0 AS (SELECT s.*  REPLACE (CAST(s.total * 1000 AS BIGINT) AS total), coalesce(r.rows, []) AS rows FROM stretch s LEFT JOIN (SELECT company_id, q_index, list({{'key': member_key, 'v': CAST(value * 1000 AS BIGINT), 'opt': member_key IN ('otherrevenue', 'reportedrevenue')}} ORDER BY value DESC, member_key) AS rows FROM regime GROUP BY ALL) r USING (company_id, q_index)),
  prof AS (SELECT * EXCLUDE (k), CASE WHEN len({_PLAIN.format('k')}) >= 2 THEN {_PLAIN.format('k')} ELSE k END AS profile FROM (SELECT *, {_KEPT.format('rows')} AS k FROM prof0) x)"""


def _pairs(condition: str) -> str:
    """The rule for pairs of an anchor a and a quarter c, step by step."""
    return f"""pair0 AS (SELECT a.company_id, a.q_index, c.q_index AS q2, a.total AS ta, c.total AS tc, a.style AS sa, c.style AS sc, a.profile AS pa, c.profile AS pc, c.rows AS rc, {_KEYS.format('a.profile')} AS ka, {_KEYS.format('c.profile')} AS kc FROM prof a JOIN prof c ON a.company_id = c.company_id AND {condition}),
  pair1 AS (SELECT *, {_OUT.format('pa', 'kc')} AS miss, {_OUT.format('pc', 'ka')} AS more FROM pair0),
  pair2 AS (SELECT *, {_KEYS.format('more')} AS km, {_SUM.format(_IN.format('rc', _KEYS.format('more')))} AS ev FROM pair1),
  pair3 AS (SELECT *, {_SHARE.format('miss[1].v', 'ta')} AS sm, {_SHARE.format('ev', 'tc')} AS se FROM pair2),
  pair4 AS (SELECT *, coalesce(len(miss) = 1 AND len(more) BETWEEN 1 AND 3 AND len(pa) - len(miss) >= 2 AND ((sm > 0.1 AND se > 0.1 AND se / greatest(sm, 0.001) BETWEEN 0.55 AND 1.8) OR abs(sm - se) <= 0.18), false) AS bundled FROM pair3),
  pair5 AS (SELECT *, CASE WHEN bundled THEN list_append({_OUT.format('rc', 'km')}, {{'key': miss[1].key, 'v': ev, 'opt': miss[1].opt}}) ELSE rc END AS r2 FROM pair4),
  pair6 AS (SELECT *, CASE WHEN NOT bundled THEN pc WHEN len({_PLAIN.format(_KEPT.format('r2'))}) >= 2 THEN {_PLAIN.format(_KEPT.format('r2'))} ELSE {_KEPT.format('r2')} END AS p2 FROM pair5),
  pair7 AS (SELECT *, {_KEYS.format('p2')} AS k2, {_IN.format('pa', _KEYS.format('p2'))} AS both_, {_OUT.format('pa', _KEYS.format('p2'))} AS miss2, {_OUT.format('p2', 'ka')} AS more2 FROM pair6),
  pair8 AS (SELECT *, len(both_) AS n, len(both_)::DOUBLE / greatest(len(both_) + len(miss2) + len(more2), 1) AS j, {_SHARE.format(_SUM.format('both_'), 'ta')} AS ca, {_SHARE.format(_SUM.format(_IN.format('p2', _KEYS.format('both_'))), 'tc')} AS cq, {_SHARE.format(_SUM.format('miss2'), 'ta')} AS lack, {_SHARE.format(_SUM.format('more2'), 'tc')} AS spare,
    list_transform(list_filter(more2, lambda r: r.opt OR r.v::DOUBLE / greatest(tc, 1)::DOUBLE <= 0.08), lambda r: r.key) AS drop_ FROM pair7),
  pair9 AS (SELECT company_id, q_index, q2, pa, pc, sa, sc, bundled, CASE WHEN sa <> sc THEN 'style-mismatch' WHEN len(pa) < 2 OR len(pc) < 1 THEN 'insufficient-profile' WHEN (coalesce(sa = sc, false) AND n >= 2 AND ca >= 0.45) OR (n >= 2 AND (j >= 0.58 OR (ca >= 0.55 AND cq >= 0.55 AND lack <= 0.26 AND spare <= 0.26))) THEN CASE WHEN bundled THEN 'schema-bundled' ELSE 'schema-compatible' END ELSE 'schema-mismatch' END AS reason,
    list_filter({_OUT.format('r2', 'drop_')}, lambda r: r.v > 20) AS r3 FROM pair8),
  pair AS (SELECT company_id, q_index, q2, pa, pc, reason IN ('schema-bundled', 'schema-compatible') AS comparable, reason, CASE WHEN reason LIKE 'schema-_o%' OR reason = 'schema-bundled' THEN r3 ELSE [] END AS rows FROM pair9)"""


_TEXT = "coalesce((SELECT string_agg(r.key || '=' || r.v, ',' ORDER BY r.v DESC, r.key) FROM (SELECT unnest(p.rows) AS r)), '')"


def regime(t):
    return P.profiles(t.sql("SELECT * FROM regime", REGIME), t.sql("SELECT * FROM stretch", REGIME))


def as_text(rows):
    return F.array_join(F.transform(rows, lambda r: F.concat_ws("=", r["key"], r["v"])), ",")


@query("b9_align_pairs", f"SELECT company_id, q_index, q2, comparable, reason, {_TEXT} AS members FROM pair p", f"{PROFILE}, {_pairs('a.q_index <> c.q_index AND abs(a.q_index - c.q_index) <= 4')}")
def b9(t):
    return P.align_pairs(regime(t)).select("company_id", "q_index", "q2", "comparable", "reason", as_text("rows").alias("members"))


PHASES = f"""{PROFILE}, {_pairs('a.q_index <> c.q_index AND a.reliable AND c.reliable AND len(a.profile) >= 2 AND len(c.profile) >= 2')},
  opens AS (SELECT f.company_id, f.q_index, f.q2, list_transform(f.pa, lambda r: r.key) <> list_transform(f.pc, lambda r: r.key) AND (((f.reason = 'schema-bundled' OR r.reason = 'schema-bundled') AND len(f.pa) >= 3 AND len(f.pc) >= 3) OR (NOT f.comparable AND NOT r.comparable)
    OR (len(f.pa) >= 3 AND len(f.pc) >= 3 AND len({_IN.format('f.pa', _KEYS.format('f.pc'))})::DOUBLE / (len(f.pa) + len(f.pc) - len({_IN.format('f.pa', _KEYS.format('f.pc'))})) < 0.75)) AS opens
    FROM pair f JOIN pair r ON r.company_id = f.company_id AND r.q_index = f.q2 AND r.q2 = f.q_index WHERE f.q_index < f.q2),
  member AS (SELECT *, len(profile) * 20 + source_score + coverage::DOUBLE * 12 + total::DOUBLE / 1000 * 0.01 AS score, row_number() OVER (PARTITION BY company_id ORDER BY q_index) AS k FROM prof WHERE reliable AND len(profile) >= 2),
  walk AS (WITH RECURSIVE w AS (SELECT company_id, k, q_index, 0 AS phase, q_index AS anchor, score AS top FROM member WHERE k = 1
    UNION ALL SELECT m.company_id, m.k, m.q_index, w.phase + CASE WHEN o.opens THEN 1 ELSE 0 END, CASE WHEN o.opens OR m.score >= w.top THEN m.q_index ELSE w.anchor END, CASE WHEN o.opens OR m.score >= w.top THEN m.score ELSE w.top END
    FROM w JOIN member m ON m.company_id = w.company_id AND m.k = w.k + 1 JOIN opens o ON o.company_id = w.company_id AND o.q_index = w.anchor AND o.q2 = m.q_index) SELECT * FROM w),
  placed AS (SELECT company_id, q_index, phase, last_value(anchor) OVER (PARTITION BY company_id, phase ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS anchor FROM walk),
  bridged AS (SELECT p.*, coalesce(w.phase, CASE WHEN lag(w.phase) OVER v = lead(w.phase) OVER v THEN lag(w.phase) OVER v END) AS phase, coalesce(w.anchor, CASE WHEN lag(w.phase) OVER v = lead(w.phase) OVER v THEN lag(w.anchor) OVER v END) AS anchor, w.phase IS NOT NULL AS member
    FROM prof p LEFT JOIN placed w USING (company_id, q_index) WINDOW v AS (PARTITION BY p.company_id ORDER BY p.q_index))"""


@query("b10_phases", "SELECT company_id, q_index, phase, anchor, member FROM bridged", PHASES)
def b10(t):
    return P.phases(regime(t)).select("company_id", "q_index", "phase", "anchor", "member")


ALIGNED = f"""{PHASES},
  verdict AS (SELECT b.company_id, b.q_index, b.phase, b.anchor, b.style, b.total, CASE WHEN b.q_index = b.anchor THEN true ELSE p.comparable END AS comparable, CASE WHEN b.q_index = b.anchor THEN 'anchor-quarter' ELSE p.reason END AS reason, CASE WHEN b.q_index = b.anchor THEN b.rows ELSE p.rows END AS rows
    FROM bridged b LEFT JOIN pair p ON p.company_id = b.company_id AND p.q_index = b.anchor AND p.q2 = b.q_index WHERE b.member AND len(b.rows) > 0),
  chosen AS (SELECT b.company_id, b.q_index, b.style, b.total, coalesce(v.comparable, false) AS taken, unnest(CASE WHEN v.comparable THEN v.rows ELSE b.rows END) AS r FROM bridged b LEFT JOIN verdict v USING (company_id, q_index)),
  cover AS (SELECT *, sum(r.v) OVER (PARTITION BY company_id, q_index) AS s FROM chosen WHERE taken),
  fit AS (SELECT *, s::DOUBLE / total::DOUBLE AS cov FROM cover WHERE s::DOUBLE / total::DOUBLE >= CASE WHEN style IS NULL THEN 0.62 ELSE 0.36 END)"""


@query("b11_align_to_phase", "SELECT company_id, q_index, phase, anchor, comparable, reason FROM verdict", ALIGNED)
def b11(t):
    return P.align_to_phase(P.phases(regime(t)))[0]


@query("b11_phase_rows", """SELECT company_id, q_index, member_key, sum(v)::DOUBLE / 1000 AS value FROM (SELECT company_id, q_index, r.key AS member_key, r.v::HUGEINT AS v FROM chosen WHERE NOT taken
  UNION ALL SELECT company_id, q_index, r.key, CASE WHEN cov > 1.12 THEN (2 * r.v::HUGEINT * total::HUGEINT + s::HUGEINT) // (2 * s::HUGEINT) ELSE r.v END FROM fit
  UNION ALL SELECT DISTINCT company_id, q_index, 'otherrevenue', (total - s)::HUGEINT FROM fit WHERE cov < 0.94 AND total - s > 30) GROUP BY 1, 2, 3""", ALIGNED)
def b11_rows(t):
    return P.align_to_phase(P.phases(regime(t)))[1]


_TOTAL = "coalesce(list_sum(list_transform({0}, lambda r: r.v)), 0)::DOUBLE"


def _templates(h: str, name: str) -> str:
    """Reliable templates and dominant phase over quarters `h`; name: of the last table."""
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY q_index) AS idx, len(list_filter(rows, lambda r: NOT r.opt AND r.v > 20)) AS substantive, max(len(rows) >= 2) OVER (PARTITION BY company_id) AS several FROM {h}),
  {name}1 AS (SELECT *, len(rows) > 0 AND has_raw AND NOT reported_only AND NOT insufficient AND (NOT several OR len(rows) >= 2) AND (harmonize OR (source <> 'fallback-reported' AND coverage BETWEEN 0.78 AND 1.22)) AS template FROM {name}0),
  {name}2 AS (SELECT company_id, phase, count(*) AS n FROM {name}1 WHERE template GROUP BY ALL),
  {name} AS (SELECT t.*, d.dominant, coalesce(d.n_dominant, 0) AS n_dominant, coalesce(d.n_templates, 0) AS n_templates FROM {name}1 t LEFT JOIN (SELECT company_id, arg_min(phase, (-n, phase)) FILTER (phase IS NOT NULL) AS dominant, coalesce(max(n) FILTER (phase IS NOT NULL), 0) AS n_dominant, sum(n) AS n_templates FROM {name}2 GROUP BY 1) d USING (company_id))"""


STATE = f"""{PHASES}, state AS (SELECT *, len(rows) > 0 AS has_raw FROM bridged), {_templates('state', 'tm')}"""


def state(t):
    return P.phases(regime(t)).withColumn("has_raw", F.size("rows") > 0)


@query("b13_reliable_templates", "SELECT company_id, q_index, idx, template, dominant, n_dominant, n_templates FROM tm", STATE)
def b13(t):
    return T.reliable_templates(state(t)).select("company_id", "q_index", F.col("idx").cast("long").alias("idx"), "template", "dominant", "n_dominant", "n_templates")


_NEAR = "(SELECT arg_min(x.idx, (abs(x.idx - h.idx), x.idx)) FROM tm x WHERE x.template AND x.company_id = h.company_id AND {0})"
_COARSE = "(NOT has_raw OR reported_only OR substantive <= 1)"
PICKED = f"""{STATE},
  tried AS (SELECT h.*, {_NEAR.format('x.schema = h.schema')} AS by_schema, {_NEAR.format('x.phase = h.phase')} AS by_phase, CASE WHEN h.phase IS NULL THEN {_NEAR.format('x.family = h.family')} END AS by_family, {_NEAR.format('x.phase = h.dominant')} AS by_dominant,
    (SELECT max(x.idx) FROM tm x WHERE x.template AND x.company_id = h.company_id AND x.idx < h.idx) AS past, (SELECT min(x.idx) FROM tm x WHERE x.template AND x.company_id = h.company_id AND x.idx > h.idx) AS future FROM tm h),
  told AS (SELECT *, CASE WHEN NOT harmonize AND n_dominant >= 6 AND ({_COARSE} OR partial) AND by_dominant IS NOT NULL THEN 'dominant' WHEN by_schema IS NOT NULL THEN 'schema' WHEN by_phase IS NOT NULL THEN 'phase' WHEN by_family IS NOT NULL THEN 'family' WHEN partial AND future IS NOT NULL THEN 'future' WHEN past IS NOT NULL THEN 'past' WHEN future IS NOT NULL THEN 'future' END AS tier0 FROM tried
    WHERE total > 20 AND (len(rows) < 2 OR reported_only OR insufficient)),
  at_ AS (SELECT *, CASE tier0 WHEN 'dominant' THEN by_dominant WHEN 'schema' THEN by_schema WHEN 'phase' THEN by_phase WHEN 'family' THEN by_family WHEN 'past' THEN past ELSE future END AS from_ FROM told),
  picked AS (SELECT a.company_id, a.q_index, a.total, a.from_ AS from_idx, a.tier0 AS tier, x.phase AS of_phase, x.rows AS rows FROM at_ a JOIN tm x ON x.company_id = a.company_id AND x.idx = a.from_
    WHERE (a.harmonize OR (x.phase = a.dominant AND a.n_dominant >= 6 AND ((NOT a.has_raw OR a.reported_only OR a.substantive <= 1) OR a.partial))) AND abs(a.from_ - a.idx) <= CASE WHEN NOT a.harmonize OR a.partial THEN 16 ELSE 4 END)"""


def _filled(tm: str, picked: str, name: str) -> str:
    """Rows of the picked quarters from their templates in `tm`."""
    return f"""{name}0 AS (SELECT p.*, (SELECT min(q_index) FROM {tm} x WHERE x.template AND x.company_id = p.company_id AND x.phase = p.of_phase) AS low, (SELECT max(q_index) FROM {tm} x WHERE x.template AND x.company_id = p.company_id AND x.phase = p.of_phase) AS high FROM {picked} p),
  {name}1 AS (SELECT * EXCLUDE (low, high), CASE WHEN q_index < low THEN (SELECT list(x.rows) FROM (SELECT rows FROM {tm} x WHERE x.template AND x.company_id = f.company_id AND x.phase = f.of_phase ORDER BY idx LIMIT 3) x WHERE len(x.rows) >= 2) WHEN q_index > high THEN (SELECT list(x.rows) FROM (SELECT rows FROM {tm} x WHERE x.template AND x.company_id = f.company_id AND x.phase = f.of_phase ORDER BY idx DESC LIMIT 3) x WHERE len(x.rows) >= 2) END AS edge FROM {name}0 f),
  {name}2 AS (SELECT company_id, q_index, total, from_idx, r.key AS key, sum(r.v::DOUBLE / s) AS s FROM (SELECT company_id, q_index, total, from_idx, unnest(rs) AS r, {_TOTAL.format('rs')} AS s FROM (SELECT company_id, q_index, total, from_idx, unnest(coalesce(edge, [rows])) AS rs FROM {name}1)) GROUP BY ALL),
  {name}3 AS (SELECT *, round(total::DOUBLE * (s / sum(s) OVER (PARTITION BY company_id, q_index)))::BIGINT AS v, row_number() OVER (PARTITION BY company_id, q_index ORDER BY s DESC, key) AS k FROM {name}2),
  {name} AS (SELECT company_id, q_index, from_idx, key, v + CASE WHEN k = 1 AND abs(total - sum(v) OVER (PARTITION BY company_id, q_index)) > 4 THEN total - sum(v) OVER (PARTITION BY company_id, q_index) ELSE 0 END AS v FROM {name}3)"""


@query("b16_pick_templates", "SELECT company_id, q_index, from_idx, tier FROM picked", PICKED)
def b16(t):
    at = T.pick_templates(T.reliable_templates(state(t))).where("from_idx is not null")
    return at.select("company_id", "q_index", F.col("from_idx").cast("long").alias("from_idx"), "tier")


@query("b16_template_fill", "SELECT company_id, q_index, from_idx, key AS member_key, v::BIGINT AS thousandths FROM filled", f"{PICKED}, {_filled('tm', 'picked', 'filled')}")
def b16_fill(t):
    at = T.fill(T.pick_templates(T.reliable_templates(state(t))))
    return at.select("company_id", "q_index", F.col("from_idx").cast("long").alias("from_idx"), F.explode("rows").alias("r")).select("company_id", "q_index", "from_idx", F.col("r.key").alias("member_key"), F.col("r.v").alias("thousandths"))


LAST = f"""{PHASES}, bare AS (SELECT * EXCLUDE (rows), len(rows) > 0 AS has_raw, CASE WHEN len(rows) = 0 AND total > 20 THEN [{{'key': 'reportedrevenue', 'v': total, 'opt': true}}] ELSE rows END AS rows FROM bridged), state AS (SELECT *, len(rows) > 0 AS has_raw FROM bridged), {_templates('state', 'tm')},
  only_ AS (SELECT b.company_id, b.q_index, b.total, b.rows, h.dominant, (SELECT arg_min(x.idx, (abs(x.idx - h.idx), x.idx)) FROM tm x WHERE x.template AND x.company_id = h.company_id AND x.phase = h.dominant) AS from_idx FROM bare b JOIN tm h USING (company_id, q_index) WHERE len(b.rows) = 1 AND b.rows[1].key = 'reportedrevenue' AND h.n_dominant >= 6 AND h.n_dominant >= 0.75 * h.n_templates),
  picked AS (SELECT o.company_id, o.q_index, o.total, o.from_idx, x.phase AS of_phase, x.rows FROM only_ o JOIN tm x ON x.company_id = o.company_id AND x.idx = o.from_idx), {_filled('tm', 'picked', 'filled')}"""


@query("b21_fallback_fill", "SELECT company_id, q_index, key AS member_key, v::BIGINT AS thousandths, true AS filled FROM filled UNION ALL SELECT company_id, q_index, r.key, r.v, false FROM (SELECT company_id, q_index, unnest(rows) AS r FROM bare b WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.company_id = b.company_id AND f.q_index = b.q_index))", LAST)
def b21(t):
    at = T.fallback_fill(T.reliable_templates(state(t)))
    return at.select("company_id", "q_index", F.explode("rows").alias("r"), "filled").select("company_id", "q_index", F.col("r.key").alias("member_key"), F.col("r.v").alias("thousandths"), "filled")
