"""Queries of segments, history and bridge."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import bridge as V
from quarterlode.operators import facts as A
from quarterlode.operators import history as B
from quarterlode.operators import segments as G
from quarterlode.plans.fact_queries import COMPLETE, _pct
from quarterlode.plans.registry import query

NORM = "trim(regexp_replace(lower(replace({0}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"
#: Members with longer names that take in two types at once, and an aggregate, in some quarters.
NAMED = """named AS (SELECT company_id, q_index, member_key, CAST(value AS DECIMAL(20,2)) AS value, name, CAST(make_date(2000, 1, 1) AS DATE) AS filing_date FROM segments WHERE value > 0
  UNION ALL SELECT company_id, q_index, 'both', CAST(sum(value) AS DECIMAL(20,2)), concat(min(name), ' and ', max(name)), CAST(make_date(2000, 1, 1) AS DATE) FROM segments WHERE q_index % 2 = 0 GROUP BY company_id, q_index HAVING count(*) >= 2
  UNION ALL SELECT company_id, q_index, 'all', CAST(sum(value) AS DECIMAL(20,2)), 'Operating Segments', CAST(make_date(2000, 2, 1) AS DATE) FROM segments WHERE q_index % 3 = 0 GROUP BY company_id, q_index
  UNION ALL SELECT company_id, q_index, concat(member_key, '-x'), value, concat(name, ' extra'), CAST(make_date(2000, 3, 1) AS DATE) FROM segments WHERE q_index % 5 = 0)"""


def named(t):
    return t.sql("SELECT * FROM named", NAMED)


TOKENS = f"""tok AS (SELECT DISTINCT company_id, q_index, name, list_distinct(list_filter(string_split({NORM.format('name')}, ' '), lambda w: w <> '' AND w NOT IN ('and', 'other', 'services', 'service'))) AS t, {NORM.format('name')} AS nn FROM named),
  comb AS (SELECT a.company_id, a.q_index, a.name, count(*) AS parts FROM tok a JOIN tok b ON a.company_id = b.company_id AND a.q_index = b.q_index AND a.name <> b.name AND len(b.t) > 0 AND len(b.t) < len(a.t) AND len(list_filter(b.t, lambda w: NOT list_contains(a.t, w))) = 0
    AND NOT contains(b.nn, 'operating segments') WHERE contains(a.nn, ' and ') AND len(a.t) >= 2 GROUP BY ALL HAVING count(*) >= 2)"""


@query("g2_classify_members", f"SELECT company_id, q_index, name, contains({NORM.format('name')}, 'operating segments') AS aggregate FROM named", NAMED)
def g2(t):
    return named(t).select("company_id", "q_index", "name", G.is_aggregate(F.col("name")).alias("aggregate"))


@query("g3_combined_labels", "SELECT * FROM comb", f"{NAMED}, {TOKENS}")
def g3(t):
    return G.combined_labels(named(t))


@query("g7_group_members", f"""SELECT company_id, group_key, arg_max(name, (length(name), name)) AS label, count(*) AS members FROM (SELECT DISTINCT company_id, name, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({NORM.format('name')}, ' '), lambda w: w <> '' AND w NOT IN ('and', 'seg', 'segment', 'segments', 'member')),
  lambda w: CASE WHEN length(w) IN (4, 5) AND w LIKE '%s' AND w NOT IN ('news', 'this', 'us') THEN regexp_replace(w, 's$', '') ELSE w END))), '|') AS group_key FROM named) WHERE group_key <> '' GROUP BY 1, 2""", NAMED)
def g7(t):
    return G.group_members(named(t))


@query("g9_best_member_row", "SELECT company_id, q_index, name AS member_key, value FROM named QUALIFY row_number() OVER (PARTITION BY company_id, q_index, name ORDER BY filing_date DESC, value DESC, member_key DESC) = 1", NAMED, money="value")
def g9(t):
    rows = named(t).withColumn("old", F.col("member_key")).withColumn("member_key", F.col("name"))
    return G.best_member_row(rows, F.struct("filing_date", "value", "old")).select("company_id", "q_index", "member_key", "value")


@query("g10_merge_same_value", "SELECT company_id, q_index, name, value FROM named a WHERE NOT EXISTS (SELECT 1 FROM named b WHERE a.company_id = b.company_id AND a.q_index = b.q_index AND abs(a.value - b.value) < 0.001 AND contains(b.name, a.name) AND length(b.name) > length(a.name))", NAMED, money="value")
def g10(t):
    return G.merge_same_value(named(t)).select("company_id", "q_index", "name", "value")


@query("g11_clean_segments", """SELECT company_id, q_index, name, value FROM (SELECT *, count(*) FILTER (NOT c) OVER w AS rest FROM (SELECT n.*, c.name IS NOT NULL AS c FROM (
  SELECT *, contains(lower(name), 'operating segments') AS a, count(*) OVER w1 AS n, count(*) FILTER (NOT contains(lower(name), 'operating segments')) OVER w1 AS p FROM named WHERE value > 0.001 WINDOW w1 AS (PARTITION BY company_id, q_index)) n
  LEFT JOIN comb c USING (company_id, q_index, name) WHERE NOT (a AND n >= 3 AND p >= 2)) WINDOW w AS (PARTITION BY company_id, q_index)) WHERE NOT c OR n < 3 OR rest = 0""", f"{NAMED}, {TOKENS}", money="value")
def g11(t):
    return G.clean_segments(named(t)).select("company_id", "q_index", "name", "value")


@query("g12_rollup_members", "SELECT company_id, q_index, concat('P', ascii(member_key) % 2) AS parent, sum(value) AS value, count(*) AS members FROM segments GROUP BY 1, 2, 3", money="value")
def g12(t):
    parents = t.segments.select("member_key", F.concat(F.lit("P"), F.ascii("member_key") % 2).alias("parent")).distinct()
    return G.rollup_members(t.segments, parents)


@query("g19_canonical_member", "SELECT company_id, q_index, CASE WHEN company_id % 2 = 0 AND regexp_replace(lower(member_key), '[^a-z0-9]+', '', 'g') = 'all' THEN 'total' ELSE regexp_replace(lower(member_key), '[^a-z0-9]+', '', 'g') END AS member_key, name, value FROM named", NAMED, money="value")
def g19(t):
    aliases = t.companies.where("company_id % 2 = 0").select("company_id", F.lit("all").alias("alias"), F.lit("total").alias("canonical"))
    return G.canonical_member(named(t), aliases).select("company_id", "q_index", "member_key", "name", "value")


@query("g20_dedupe_segments", "SELECT company_id, q_index, k AS member_key, max(value) AS value, arg_max(name, (filing_date, value, name)) AS name FROM (SELECT *, split_part(member_key, '-', 1) AS k FROM named) GROUP BY 1, 2, 3", NAMED, money="value")
def g20(t):
    return G.dedupe_segments(named(t).withColumn("member_key", F.split_part("member_key", F.lit("-"), F.lit(1)))).select("company_id", "q_index", "member_key", "value", "name")


_TYPES = "types AS (SELECT company_id, q_index, CAST(ascii(member_key) % 4 AS VARCHAR) AS member_key, CAST(sum(value) AS DECIMAL(20,2)) AS value FROM segments GROUP BY 1, 2, 3)"


def types(t):
    return t.segments.groupBy("company_id", "q_index", (F.ascii("member_key") % 4).cast("string").alias("member_key")).agg(F.sum("value").cast("decimal(20,2)").alias("value"))


@query("g21_supersede", "SELECT * FROM types a WHERE NOT (member_key IN ('1', '2') AND EXISTS (SELECT 1 FROM types b WHERE b.company_id = a.company_id AND b.q_index = a.q_index AND b.member_key = '3'))", _TYPES, money="value")
def g21(t):
    return G.supersede(types(t), [("3", ("1", "2"))])


@query("g22_schema_regime", """SELECT company_id, q_index, member_key, value FROM (SELECT *, bool_or(member_key IN ('0', '1')) OVER w AND bool_or(member_key IN ('2', '3')) OVER w AS mixed FROM types WINDOW w AS (PARTITION BY company_id, q_index))
  WHERE NOT mixed OR CASE WHEN q_index >= 7992 THEN member_key NOT IN ('0', '1') ELSE member_key NOT IN ('2', '3') END""", _TYPES, money="value")
def g22(t):
    return G.schema_regime(types(t), ("0", "1"), ("2", "3"), 7992)


@query("g23_comparable_buckets", "SELECT company_id, q_index, CASE WHEN member_key IN ('0', '1') THEN 'old' ELSE member_key END AS bucket, sum(value) AS value, count(*) AS members FROM types GROUP BY 1, 2, 3", _TYPES, money="value")
def g23(t):
    return G.comparable_buckets(types(t), {"old": ("0", "1")})


@query("g24_attach_segments", "SELECT company_id, q_index, member_key, value FROM segments SEMI JOIN statements USING (company_id, q_index)", money="value")
def g24(t):
    return G.attach_segments(t.statements, t.segments).select("company_id", "q_index", "member_key", "value")


@query("g25_synthesize_statements", "SELECT company_id, q_index, sum(value) AS revenue, count(*) AS segments FROM segments ANTI JOIN statements USING (company_id, q_index) GROUP BY 1, 2", money="revenue")
def g25(t):
    return G.synthesize_statements(t.segments, t.statements)


@query("g26_segment_growth", f"""SELECT company_id, q_index, member_key, value, {_pct('value', 'revenue', 1)} AS mix_pct, {_pct('value - v1', 'v1')} AS qoq_pct, {_pct('value - v4', 'v4')} AS yoy_pct,
  CASE WHEN v4 <> 0 THEN CAST(round(CAST(value::DECIMAL(20,4) * 100 / CASE WHEN revenue <> 0 THEN revenue::DECIMAL(20,4) END AS DECIMAL(38,12)) - CAST(v4::DECIMAL(20,4) * 100 / CASE WHEN r4 <> 0 THEN r4::DECIMAL(20,4) END AS DECIMAL(38,12)), 1) AS DOUBLE) END AS mix_yoy_delta_pp
  FROM (SELECT a.*, s.revenue, b.value AS v1, c.value AS v4, s4.revenue AS r4 FROM segments a LEFT JOIN statements s USING (company_id, q_index) LEFT JOIN segments b ON b.company_id = a.company_id AND b.member_key = a.member_key AND b.q_index = a.q_index - 1
  LEFT JOIN segments c ON c.company_id = a.company_id AND c.member_key = a.member_key AND c.q_index = a.q_index - 4 LEFT JOIN statements s4 ON s4.company_id = a.company_id AND s4.q_index = a.q_index - 4)""", money="value")
def g26(t):
    return G.segment_growth(t.segments, t.statements)


TOTALS = "totals AS (SELECT company_id, q_index, CAST(CASE q_index % 4 WHEN 0 THEN revenue WHEN 1 THEN revenue * 1.3 WHEN 2 THEN revenue * 0.8 ELSE revenue * 4 END AS DECIMAL(20,2)) AS total FROM quarters)"


def totals(t):
    k, x = F.col("q_index") % 4, lambda y: F.lit(y).cast("decimal(3,1)")
    return t.quarters.select("company_id", "q_index", F.when(k == 0, F.col("revenue")).when(k == 1, F.col("revenue") * x(1.3)).when(k == 2, F.col("revenue") * x(0.8)).otherwise(F.col("revenue") * x(4)).cast("decimal(20,2)").alias("total"))


@query("g27_display_scale", "SELECT company_id, q_index, CASE WHEN abs(total - revenue) <= 0.08 THEN 1.0::DOUBLE ELSE CAST(round(CAST(total::DECIMAL(20,4) / revenue::DECIMAL(20,4) AS DECIMAL(38,12)), 6) AS DOUBLE) END AS scale FROM statements JOIN totals USING (company_id, q_index)", TOTALS)
def g27(t):
    return G.display_scale(t.statements, totals(t))


SHARES = "shares AS (SELECT company_id, q_index, member_key, CASE WHEN q_index % 2 = 0 THEN value ELSE CAST(value * 100 / sum(value) OVER (PARTITION BY company_id, q_index) AS DECIMAL(20,2)) END AS value FROM segments)"


def shares(t):
    from pyspark.sql import Window

    total = F.sum("value").over(Window.partitionBy("company_id", "q_index"))
    part = (F.col("value").cast("decimal(20,4)") * 100 / total.cast("decimal(20,4)")).cast("decimal(38,8)").cast("decimal(20,2)")
    return t.segments.select("company_id", "q_index", "member_key", F.when(F.col("q_index") % 2 == 0, F.col("value")).otherwise(part).alias("value"))


@query("b1_history_rows", "SELECT company_id, q_index, member_key, CASE WHEN sh THEN round(CAST(revenue * value / 100 AS DECIMAL(38,8)), 3) ELSE value END AS value, sh AS was_share FROM (SELECT a.*, s.revenue, coalesce(s.revenue > 0.02 AND count(*) OVER w >= 2 AND max(value) OVER w <= 100.5 AND abs(sum(value) OVER w - 100) <= 4.5, false) AS sh FROM shares a LEFT JOIN statements s USING (company_id, q_index) WHERE value > 0.001 WINDOW w AS (PARTITION BY a.company_id, a.q_index)) WHERE CASE WHEN sh THEN round(CAST(revenue * value / 100 AS DECIMAL(38,8)), 3) ELSE value END > 0.02", SHARES, money="value")
def b1(t):
    return B.history_rows(shares(t), t.statements)


@query("b7_reconcile_to_total", """SELECT company_id, q_index, member_key, sum(value) AS value FROM (
  SELECT company_id, q_index, member_key, CASE WHEN cov > 1.12 THEN CAST(((20 * (value * 100)::HUGEINT * (total * 100)::HUGEINT + (s * 100)::HUGEINT) // (2 * (s * 100)::HUGEINT)) / 1000.0 AS DECIMAL(24,3)) ELSE value END AS value FROM c WHERE cov IS NULL OR cov >= 0.36
  UNION ALL SELECT DISTINCT company_id, q_index, 'otherrevenue', CAST(total - s AS DECIMAL(24,3)) FROM c WHERE cov >= 0.36 AND cov < 0.94 AND total - s > 0.03) GROUP BY 1, 2, 3""",
       f"{TOTALS}, c AS (SELECT *, s::DOUBLE / total::DOUBLE AS cov FROM (SELECT a.company_id, a.q_index, a.member_key, a.value, t.total, sum(value) OVER (PARTITION BY a.company_id, a.q_index) AS s FROM segments a LEFT JOIN totals t USING (company_id, q_index)))", money="value")
def b7(t):
    return B.reconcile_to_total(t.segments, totals(t))


@query("b8_taxonomy_profile", "SELECT company_id, q_index, string_agg(member_key, ',' ORDER BY value DESC, member_key) AS members, string_agg(member_key, '|' ORDER BY member_key) AS signature FROM types GROUP BY 1, 2", _TYPES)
def b8(t):
    return B.taxonomy_profile(types(t))


@query("b9_key_overlap", """SELECT a.company_id, a.q_index, b.q_index AS q2, round(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))), 6) AS jaccard, len(a.k) - len(list_intersect(a.k, b.k)) AS missing, len(b.k) - len(list_intersect(a.k, b.k)) AS extra
  FROM keys_ a JOIN keys_ b ON a.company_id = b.company_id AND b.q_index > a.q_index AND b.q_index - a.q_index <= 4""", "keys_ AS (SELECT company_id, q_index, list(DISTINCT member_key) AS k FROM segments GROUP BY 1, 2)")
def b9(t):
    return B.key_overlap(t.segments)


@query("b12_flag_gaps", "SELECT company_id, q_index, segments, segments <= 1 AND max(segments) OVER (PARTITION BY company_id) >= 2 AS gap FROM (SELECT company_id, q_index, count(*) AS segments FROM segments GROUP BY 1, 2)")
def b12(t):
    return B.flag_gaps(t.segments)


@query("b24_history_window", "SELECT company_id, q_index FROM (SELECT company_id, q_index, dense_rank() OVER (PARTITION BY company_id ORDER BY q_index DESC) AS r FROM statements WHERE q_index <= 7996) WHERE r <= 10")
def b24(t):
    return B.history_window(t.statements, 10, 7996).select("company_id", "q_index")


@query("b25_topk_other", """SELECT company_id, q_index, segment, value FROM (SELECT d.company_id, d.q_index, CASE WHEN n <= 9 OR rank < 9 THEN d.member_key ELSE '__other__' END AS segment, sum(value) AS value FROM brands d JOIN (
  SELECT company_id, member_key, row_number() OVER (PARTITION BY company_id ORDER BY sum(value) DESC, member_key) AS rank, count(*) OVER (PARTITION BY company_id) AS n FROM brands GROUP BY company_id, member_key) r USING (company_id, member_key) GROUP BY 1, 2, 3) WHERE segment <> '__other__' OR value > 0.02""",
       "brands AS (SELECT company_id, q_index, member_key, sum(value) AS value FROM details GROUP BY 1, 2, 3)", money="value")
def b25(t):
    return B.topk_other(t.details.groupBy("company_id", "q_index", "member_key").agg(F.sum("value").alias("value")))


SUMMARY = """summary AS (SELECT company_id, count(total) AS available, count(*) - count(total) AS missing, max(total) AS max_total FROM statements LEFT JOIN (SELECT company_id, q_index, sum(value) AS total FROM segments WHERE q_index % 7 <> 0 GROUP BY 1, 2) USING (company_id, q_index) GROUP BY 1)"""


@query("b26_history_summary", "SELECT s.*, o.stack_order FROM summary s LEFT JOIN (SELECT company_id, string_agg(member_key, ',' ORDER BY v DESC, member_key) AS stack_order FROM (SELECT company_id, member_key, sum(value) AS v FROM segments WHERE q_index % 7 <> 0 GROUP BY 1, 2) GROUP BY 1) o USING (company_id)", SUMMARY, money="max_total")
def b26(t):
    return B.history_summary(t.segments.where("q_index % 7 <> 0"), t.statements)


@query("b27_axis_step", "SELECT company_id, u AS unit, CASE WHEN t > 0 THEN round(CASE WHEN p < 1.5 THEN 1 WHEN p < 3 THEN 2 WHEN p < 7 THEN 5 ELSE 10 END * b, 6) ELSE 1 END AS step FROM (SELECT *, pow(10.0, floor(log10(t / u / 6))) AS b, t / u / 6 / pow(10.0, floor(log10(t / u / 6))) AS p FROM (SELECT company_id, greatest(max_total::DOUBLE, 0) / 1e5 AS t, CASE WHEN max_total::DOUBLE / 1e5 > 0 AND max_total::DOUBLE / 1e5 < 3 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS u FROM summary))", SUMMARY)
def b27(t):
    at = B.history_summary(t.segments.where("q_index % 7 <> 0"), t.statements).withColumn("max_total", F.col("max_total").cast("double") / 1e5)
    return B.axis_step(at).select("company_id", "unit", "step")


@query("b28_stack_offsets", "SELECT company_id, q_index, member_key, sum(value) OVER w - value AS low, sum(value) OVER w AS high FROM segments WINDOW w AS (PARTITION BY company_id, q_index ORDER BY value DESC, member_key ROWS UNBOUNDED PRECEDING)", money="low high")
def b28(t):
    return B.stack_offsets(t.segments)


STAGE = """stage AS (SELECT *, CASE WHEN gross_profit IS NOT NULL AND cost2 IS NOT NULL THEN 'full' ELSE 'revenue-only' END AS coverage FROM (SELECT company_id, q_index, revenue, g AS gross_profit, coalesce(cost_of_revenue, CASE WHEN g IS NOT NULL THEN greatest(revenue - g, 0) END) AS cost2, operating_expenses, operating_income, pretax_income, tax, net_income
  FROM (SELECT *, coalesce(gross_profit, revenue - cost_of_revenue, operating_income + operating_expenses) AS g FROM statements)))"""


@query("v1_gross_stage", "SELECT company_id, q_index, gross_profit, cost2 AS cost_of_revenue, coverage FROM stage", STAGE, money="gross_profit cost_of_revenue")
def v1(t):
    return V.gross_stage(t.statements).select("company_id", "q_index", "gross_profit", "cost_of_revenue", "coverage")


OPEX = f"""{STAGE}, opex AS (SELECT *, CASE WHEN st IS NULL THEN dv WHEN dv IS NULL THEN CASE WHEN ov OR coalesce(st > revenue + 0.25, false) THEN 0 ELSE st END WHEN nr AND NOT ov THEN st ELSE dv END AS opex FROM (
  SELECT *, abs(st - dv) <= greatest(0.25, dv * 0.08) AS nr, coalesce(st > gross_profit + 0.25, false) AS ov FROM (SELECT *, CASE WHEN operating_expenses IS NOT NULL THEN greatest(operating_expenses, 0) END AS st, CASE WHEN operating_income IS NOT NULL AND gross_profit IS NOT NULL THEN greatest(gross_profit - operating_income, 0) END AS dv FROM stage)))"""


def staged(t):
    return V.resolve_opex(V.gross_stage(t.statements))


PRETAX = """pre AS (SELECT company_id, q_index, CASE WHEN p IS NULL THEN coalesce(bn, bo) WHEN coalesce(abs(p - bn) <= greatest(0.25, abs(bn) * 0.05), false) OR coalesce(abs(p - bo) <= greatest(0.25, abs(bo) * 0.05), false) OR coalesce(bn, bo) IS NULL THEN p ELSE coalesce(bn, bo) END AS pretax_income, operating_income FROM (
  SELECT company_id, q_index, CASE q_index % 3 WHEN 0 THEN pretax_income WHEN 1 THEN CAST(pretax_income * 1.2 AS DECIMAL(20,2)) END AS p, net_income + tax AS bn, CAST(NULL AS DECIMAL(20,2)) AS bo, operating_income FROM statements))"""


def pretax(t):
    k = F.col("q_index") % 3
    rows = t.statements.withColumn("pretax_income", F.when(k == 0, F.col("pretax_income")).when(k == 1, (F.col("pretax_income") * F.lit(1.2).cast("decimal(3,1)")).cast("decimal(20,2)"))).withColumn("non_operating", F.lit(None).cast("decimal(20,2)"))
    return V.resolve_pretax(rows)


@query("v4_resolve_pretax", "SELECT company_id, q_index, pretax_income FROM pre", PRETAX, money="pretax_income")
def v4(t):
    return pretax(t).select("company_id", "q_index", "pretax_income")


@query("v5_resolve_non_operating", "SELECT company_id, q_index, pretax_income - operating_income AS non_operating FROM pre", PRETAX, money="non_operating")
def v5(t):
    return V.resolve_non_operating(pretax(t)).select("company_id", "q_index", "non_operating")


ITEMS = "items_ AS (SELECT company_id, q_index, member_key AS category, value FROM segments), targets AS (SELECT company_id, q_index, total AS target FROM totals)"
FIT = f"""{TOTALS}, {ITEMS}, at_ AS (SELECT *, CASE WHEN s <= target + slack THEN value ELSE CAST(round(CAST(value::DECIMAL(18,2) * target::DECIMAL(18,2) / s::DECIMAL(18,2) AS DECIMAL(38,8)), 2) AS DECIMAL(20,2)) END AS v FROM (
  SELECT i.*, t.target, sum(value) OVER w AS s, greatest(0.08, t.target * 0.01) AS slack, row_number() OVER (w ORDER BY value DESC, category) AS r, count(*) OVER w AS n FROM items_ i JOIN targets t USING (company_id, q_index) WHERE value > 0.02 AND target > 0.05 WINDOW w AS (PARTITION BY i.company_id, i.q_index)))"""


@query("v6_reconcile_breakdown", """SELECT company_id, q_index, category, CASE WHEN r = n AND s > target + slack THEN greatest(target - coalesce(sum(v) OVER (PARTITION BY company_id, q_index ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) ELSE v END AS value FROM at_
  UNION ALL SELECT company_id, q_index, 'residual', target - s FROM at_ WHERE r = 1 AND target - s > slack""", FIT, money="value")
def v6(t):
    items = t.segments.select("company_id", "q_index", F.col("member_key").alias("category"), "value")
    return V.reconcile_breakdown(items, totals(t).withColumnRenamed("total", "target"))


@query("v11_collapse_single", "SELECT company_id, q_index, category, value FROM (SELECT i.*, t.target, count(*) OVER (PARTITION BY i.company_id, i.q_index) AS n FROM items_ i LEFT JOIN targets t USING (company_id, q_index)) WHERE NOT (n = 1 AND coalesce(abs(value - target) <= greatest(0.08, target * 0.01), false))", f"{TOTALS}, {ITEMS}", money="value")
def v11(t):
    items = t.segments.select("company_id", "q_index", F.col("member_key").alias("category"), "value")
    return V.collapse_single(items, totals(t).withColumnRenamed("total", "target"))


@query("v18_weighted_metric", "SELECT company_id, q_index, round(sum(value * CASE WHEN ascii(member_key) % 3 > 0 THEN ascii(member_key) END)::DOUBLE / sum(value)::DOUBLE, 1) AS metric FROM segments GROUP BY 1, 2")
def v18(t):
    return V.weighted_metric(t.segments.withColumn("metric", F.when(F.ascii("member_key") % 3 > 0, F.ascii("member_key"))), "metric")


LOSSES = COMPLETE + """, lossy AS (SELECT * REPLACE (CASE WHEN (company_id + q_index) % 6 = 4 THEN -operating_income ELSE operating_income END AS operating_income) FROM full_)"""


@query("v19_net_bridge", """SELECT company_id, q_index, step, amount FROM (
  SELECT company_id, q_index, CASE WHEN non_operating >= 0 THEN 'non_operating_gain' ELSE 'non_operating_loss' END AS step, non_operating AS amount FROM lossy UNION ALL SELECT company_id, q_index, CASE WHEN tax >= 0 THEN 'tax' ELSE 'tax_benefit' END, -tax FROM lossy
  UNION ALL SELECT company_id, q_index, 'operating_loss_overflow', operating_income FROM lossy WHERE operating_income < -0.05 AND gross_profit IS NOT NULL
  UNION ALL SELECT company_id, q_index, 'other', gap FROM (SELECT *, net_income - (operating_income + coalesce(non_operating, 0) - coalesce(tax, 0)) AS gap FROM lossy) WHERE abs(gap) > greatest(0.08, abs(net_income) * 0.01)) WHERE amount <> 0""", LOSSES, money="amount")
def v19(t):
    loss = (F.col("company_id") + F.col("q_index")) % 6 == 4
    return V.net_bridge(A.complete_statement(t.statements).withColumn("operating_income", F.when(loss, -F.col("operating_income")).otherwise(F.col("operating_income"))))


EDGES = """e AS (SELECT company_id, q_index, revenue, g, o, n, g - o AS p FROM (SELECT company_id, q_index, revenue, CASE WHEN (company_id + q_index) % 7 = 5 THEN -gross_profit ELSE gross_profit END AS g, opex AS o, net_income AS n FROM opex) WHERE g IS NOT NULL),
  edges AS (SELECT * FROM (SELECT company_id, q_index, unnest(['revenue', 'loss', 'revenue', 'gross_profit', 'loss', 'gross_profit', 'operating_income', 'operating_income', 'gains']) AS source, unnest(['cost_of_revenue', 'cost_of_revenue', 'gross_profit', 'operating_expenses', 'operating_expenses', 'operating_income', 'net_income', 'deductions', 'net_income']) AS target,
    unnest([greatest(least(revenue, revenue - g), 0), greatest(-g, 0), greatest(g, 0), least(o, greatest(g, 0)), greatest(o - greatest(g, 0), 0), greatest(p, 0), least(greatest(p, 0), greatest(n, 0)), CASE WHEN p > 0 THEN greatest(greatest(p, 0) - greatest(n, 0), 0) END, greatest(greatest(n, 0) - greatest(p, 0), 0)]) AS amount FROM e) WHERE amount > 0)"""


@query("v20_bridge_edges", "SELECT * FROM edges", f"{OPEX}, {EDGES}", money="amount")
def v20(t):
    loss = (F.col("company_id") + F.col("q_index")) % 7 == 5
    return V.bridge_edges(staged(t).withColumn("gross_profit", F.when(loss, -F.col("gross_profit")).otherwise(F.col("gross_profit"))))


@query("v24_outcome_flags", "SELECT company_id, q_index, coalesce(operating_income < -0.02, false) AS operating_loss, coalesce(net_income < -0.05, false) AS net_loss, CASE WHEN abs(net_income) < 0.05 THEN 'near-zero' WHEN net_income < -0.05 THEN 'loss' ELSE 'profit' END AS outcome FROM statements")
def v24(t):
    return V.outcome_flags(t.statements)
