"""Queries of taxonomy, reconciliation and currencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import currency as X
from quarterlode.operators import reconcile as R
from quarterlode.operators import taxonomy as T
from quarterlode.plans.registry import query

KEY = "regexp_replace(lower(trim({0})), '[^0-9a-z一-鿿]+', '', 'g')"
NAME = KEY.format("name")
_AL = ", ".join(f"('{kind}', '{a.replace(chr(39), '')}', {i}, '{c}')" for kind, cats in T.TAXONOMY.items() for i, (c, (n, al)) in enumerate(cats.items()) for a in (*al, n))
_KW = ", ".join(f"('{kind}', '{c}', '{w}')" for kind, cats in T.KEYWORDS.items() for c, ws in cats.items() for w in ws)
_BAD = "|".join(T.TOTALS)
_IDS = ", ".join(repr(c) for cats in T.TAXONOMY.values() for c in cats)
ALIAS = f"""alias_t AS (SELECT kind, {KEY.format('alias')} AS key, ord, category FROM (VALUES {_AL}) v(kind, alias, ord, category)),
  word_t AS (SELECT * FROM (VALUES {_KW}) v(kind, category, word)), names AS (SELECT DISTINCT kind, name FROM labels_seen),
  by_alias AS (SELECT n.kind, n.name, arg_min(category, ord) AS category FROM names n JOIN alias_t a ON a.kind = n.kind AND a.key = {KEY.format('n.name')} GROUP BY ALL),
  by_word AS (SELECT kind, name, category, votes FROM (SELECT n.kind, n.name, w.category, count(*) AS votes FROM names n JOIN word_t w ON w.kind = n.kind AND contains({KEY.format('n.name')}, w.word) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY votes DESC, category) = 1)"""
NORMAL = f"""{ALIAS}, normal AS (SELECT company_id, q_index, source_id, kind, category, CASE WHEN category IN ({_IDS}) THEN sum(value) ELSE max(value) END AS value FROM (
  SELECT l.*, coalesce(a.category, w.category, {KEY.format('l.name')}) AS category FROM labels_seen l LEFT JOIN by_alias a USING (kind, name) LEFT JOIN by_word w USING (kind, name) WHERE NOT regexp_matches({KEY.format('l.name')}, '{_BAD}')) GROUP BY company_id, q_index, source_id, kind, category)"""


@query("t1_label_keys", f"SELECT p_partkey, {KEY.format('p_name')} AS label_key, regexp_replace(regexp_replace({KEY.format(chr(112) + '_name')} || CASE p_partkey % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'segmentmember' ELSE '' END, 'member$', ''), 'segment$', '') AS member_key FROM part")
def t1(t):
    k = F.col("p_partkey") % 3
    tail = F.when(k == 0, " Member").when(k == 1, " Segment-Member").otherwise("")
    return t.part.select("p_partkey", T.label_key(F.col("p_name")).alias("label_key"), T.member_key(F.concat("p_name", tail)).alias("member_key"))


@query("t2_reject_totals", f"SELECT company_id, q_index, source_id, name FROM labels_seen WHERE NOT regexp_matches({NAME}, '{_BAD}')")
def t2(t):
    return T.reject_totals(t.labels_seen).select("company_id", "q_index", "source_id", "name")


@query("t3_alias_match", "SELECT * FROM by_alias", ALIAS)
def t3(t):
    return T.alias_match(t.labels_seen)


@query("t4_keyword_vote", "SELECT * FROM by_word", ALIAS)
def t4(t):
    return T.keyword_vote(t.labels_seen)


_NOTED = """noted AS (SELECT DISTINCT kind, name, CASE company_id % 4 WHEN 0 THEN 'Research & development' WHEN 1 THEN 'Shipping, delivery' WHEN 2 THEN 'advertising' ELSE '' END AS target FROM labels_seen),
  hits AS (SELECT n.kind, n.name, n.target, w.category, sum(contains({0}, w.word)::INT + contains({1}, w.word)::INT) AS votes FROM noted n JOIN word_t w ON w.kind = n.kind AND (contains({0}, w.word) OR contains({1}, w.word)) GROUP BY ALL)""".format(KEY.format("n.name"), KEY.format("n.target"))


@query("t4_keyword_vote_texts", "SELECT kind, name, target, category, votes::BIGINT AS votes FROM hits QUALIFY row_number() OVER (PARTITION BY kind, name, target ORDER BY votes DESC, category) = 1", f"{ALIAS}, {_NOTED}")
def t4_texts(t):
    k = F.col("company_id") % 4
    target = F.when(k == 0, "Research & development").when(k == 1, "Shipping, delivery").when(k == 2, "advertising").otherwise("")
    return T.keyword_vote(t.labels_seen.withColumn("target", target), "name", "target")


@query("t5_normalize_breakdown", "SELECT * FROM normal", NORMAL, money="value")
def t5(t):
    return T.normalize_breakdown(t.labels_seen).drop("names")


@query("t6_normalize_segments", f"SELECT company_id, q_index, {KEY.format('name')} AS member_key, max(value) AS value, arg_min(name, (-value, name)) AS name FROM segments GROUP BY 1, 2, 3", money="value")
def t6(t):
    return T.normalize_segments(t.segments)


FIELDS = ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income")
_F = ", ".join(FIELDS)
ENTRIES = f"""entries AS (SELECT company_id, q_index, 'official_financials' AS source_id, {_F}, 'u' AS source_url, period_end AS filing_date, 0 AS flags FROM statements
  UNION ALL SELECT company_id, q_index, 'generic_ir_pdf', {', '.join(f'CAST({f} * 1.01 AS DECIMAL(20,2))' for f in FIELDS)}, NULL, period_end, 1 FROM statements WHERE (company_id + q_index) % 3 <> 0
  UNION ALL SELECT company_id, q_index, 'manual_financials', revenue, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM statements WHERE (company_id + q_index) % 5 = 0),
  source_t AS (SELECT * FROM (VALUES {', '.join(str(s) for s in R.SOURCES)}) v(ord, source_id, source_kind, priority))"""
STACK = f"""{ENTRIES}, stacked AS (SELECT e.company_id, e.q_index, e.source_id, e.field, e.value, s.ord, s.priority, s.priority + CASE WHEN source_url IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN filing_date IS NOT NULL THEN 1.0 ELSE 0 END + CASE WHEN flags > 0 THEN 0.5 ELSE 0 END AS score
  FROM (UNPIVOT entries ON {_F} INTO NAME field VALUE value) e JOIN source_t s USING (source_id))"""


def entries(t):
    s, hole = t.statements, (F.col("company_id") + F.col("q_index"))
    flags = lambda n: (F.array(F.lit("x")) if n else F.array().cast("array<string>")).alias("quality_flags")
    none = lambda k: F.lit(None).cast(k)
    a = s.select("company_id", "q_index", F.lit("official_financials").alias("source_id"), *FIELDS, F.lit("u").alias("source_url"), F.col("period_end").alias("filing_date"), flags(0))
    b = s.where(hole % 3 != 0).select("company_id", "q_index", F.lit("generic_ir_pdf").alias("source_id"), *((F.col(f) * F.lit(1.01).cast("decimal(3,2)")).cast("decimal(20,2)").alias(f) for f in FIELDS), none("string").alias("source_url"), F.col("period_end").alias("filing_date"), flags(1))
    c = s.where(hole % 5 == 0).select("company_id", "q_index", F.lit("manual_financials").alias("source_id"), "revenue", *(none("decimal(20,2)").alias(f) for f in FIELDS[1:]), none("string").alias("source_url"), none("date").alias("filing_date"), flags(0))
    return a.unionByName(b).unionByName(c)


def stacked(t):
    e = entries(t)
    return R.stack_sources(e, FIELDS, R.sources(e))


@query("r1_stack_sources", "SELECT company_id, q_index, source_id, field, value, priority FROM stacked", STACK, money="value")
def r1(t):
    return stacked(t).select("company_id", "q_index", "source_id", "field", "value", "priority")


@query("r2_best_field", "SELECT company_id, q_index, field, value, source_id, CAST(score AS DOUBLE) AS score FROM stacked QUALIFY row_number() OVER (PARTITION BY company_id, q_index, field ORDER BY score DESC, ord) = 1", STACK, money="value")
def r2(t):
    return R.best_field(stacked(t))


TOTAL = f"""{NORMAL}, items AS (SELECT *, CASE source_id WHEN 'sF' THEN 110 WHEN 'sO' THEN 80 ELSE 64 END AS priority FROM normal), totals AS (SELECT company_id, q_index, CAST(CASE q_index % 3 WHEN 0 THEN cost WHEN 1 THEN cost * 0.5 ELSE cost * 1.2 END AS DECIMAL(20,2)) AS total FROM quarters),
  scored AS (SELECT i.company_id, i.q_index, i.source_id, count(*) AS items, sum(value) AS disclosed, any_value(total) AS total, any_value(priority) + least(count(*), 6) * 2.0 + CASE WHEN any_value(total) > 0 THEN least(sum(value)::DOUBLE / any_value(total)::DOUBLE, 1.0::DOUBLE) * 12.0 ELSE 0 END AS score FROM items i LEFT JOIN totals t USING (company_id, q_index) GROUP BY i.company_id, i.q_index, i.source_id)"""


def breakdown(t):
    items = T.normalize_breakdown(t.labels_seen).withColumn("priority", F.when(F.col("source_id") == "sF", 110).when(F.col("source_id") == "sO", 80).otherwise(64))
    third = F.col("q_index") % 3
    d = lambda x: F.lit(x).cast("decimal(2,1)")
    total = F.when(third == 0, F.col("cost")).when(third == 1, F.col("cost") * d(0.5)).otherwise(F.col("cost") * d(1.2)).cast("decimal(20,2)")
    return items, t.quarters.select("company_id", "q_index", total.alias("total"))


@query("r3_collection_score", "SELECT company_id, q_index, source_id, items, disclosed, total, CAST(round(score, 6) AS DOUBLE) AS score FROM scored", TOTAL, money="disclosed total")
def r3(t):
    return R.collection_score(*breakdown(t)).withColumn("score", F.round("score", 6))


MERGED = f"""{TOTAL}, each_ AS (SELECT i.*, s.score, s.total, s.score + least(i.value::DOUBLE, 999.0::DOUBLE) / 1000 AS item_score FROM items i JOIN scored s USING (company_id, q_index, source_id)),
  top AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY company_id, q_index, category ORDER BY item_score DESC, source_id DESC) = 1),
  sums AS (SELECT company_id, q_index, sum(value) AS disclosed, count(*) AS n, any_value(total) AS total FROM top GROUP BY company_id, q_index), over_ AS (SELECT company_id, q_index FROM sums WHERE total > 0 AND disclosed > total * 1.02),
  single AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY company_id, q_index ORDER BY score DESC, source_id DESC) = 1)"""


@query("r4_merge_breakdowns", """SELECT company_id, q_index, category, value, source_id FROM top ANTI JOIN over_ USING (company_id, q_index)
  UNION ALL SELECT i.company_id, i.q_index, i.category, i.value, i.source_id FROM items i JOIN single s USING (company_id, q_index, source_id) SEMI JOIN over_ o ON o.company_id = i.company_id AND o.q_index = i.q_index
  UNION ALL SELECT company_id, q_index, 'other_opex', total - disclosed, 'residual' FROM sums ANTI JOIN over_ USING (company_id, q_index) WHERE total > 0 AND n >= 2 AND total - disclosed > greatest(total * 0.015, 0.05)""", MERGED, money="value")  # fmt: skip
def r4(t):
    return R.merge_breakdowns(*breakdown(t))


_FULL = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in FIELDS)


@query("r5_representative", f"SELECT company_id, q_index, source_id, CAST(score AS DOUBLE) AS score FROM (SELECT e.*, s.ord, {_FULL} + least((company_id + q_index) % 9, 6) * 0.2 + CASE WHEN source_url IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN flags > 0 THEN 0.25 ELSE 0 END + s.priority / 100.0 AS score FROM entries e JOIN source_t s USING (source_id)) QUALIFY row_number() OVER (PARTITION BY company_id, q_index ORDER BY score DESC, ord) = 1", ENTRIES)
def r5(t):
    e = entries(t).withColumn("breakdown_items", (F.col("company_id") + F.col("q_index")) % 9)
    return R.representative(e, FIELDS, R.sources(e)).withColumn("score", F.round("score", 6))


SEGS = """segs AS (SELECT company_id, q_index, 'official_segments' AS source_id, member_key, value FROM segments UNION ALL SELECT company_id, q_index, 'official_revenue_structures', member_key, value FROM segments WHERE (company_id + q_index) % 2 = 0 UNION ALL SELECT company_id, q_index, 'manual_revenue_structures', member_key, value FROM segments WHERE (company_id + q_index) % 3 = 0)"""


@query("r6_best_segments", "SELECT company_id, q_index, source_id, member_key, value FROM segs WHERE source_id = CASE WHEN (company_id + q_index) % 2 = 0 THEN 'official_revenue_structures' WHEN (company_id + q_index) % 3 = 0 THEN 'manual_revenue_structures' ELSE 'official_segments' END", SEGS, money="value")
def r6(t):
    s, k = t.segments, F.col("company_id") + F.col("q_index")
    take = lambda df, name: df.select("company_id", "q_index", F.lit(name).alias("source_id"), "member_key", "value")
    rows = take(s, "official_segments").unionByName(take(s.where(k % 2 == 0), "official_revenue_structures")).unionByName(take(s.where(k % 3 == 0), "manual_revenue_structures"))
    return R.best_segments(rows, R.sources(rows))


DIAG = """diag AS (SELECT company_id, q_index, revenue, cost_of_revenue, operating_expenses, operating_income, net_income, CAST(CASE q_index % 4 WHEN 0 THEN NULL WHEN 1 THEN revenue * 0.5 WHEN 2 THEN revenue * 1.2 ELSE revenue * 0.9 END AS DECIMAL(20,2)) AS segments, CAST(CASE WHEN q_index % 3 <> 0 THEN cost_of_revenue * 0.4 END AS DECIMAL(20,2)) AS cost_items,
  CAST(CASE WHEN q_index % 5 <> 0 THEN operating_expenses * 0.7 END AS DECIMAL(20,2)) AS opex_items, company_id % 3 = 0 AS has_profile, CASE WHEN q_index % 2 = 0 THEN 'derived' ELSE 'direct' END AS value_mode, CASE WHEN company_id % 4 = 0 THEN 'summary-quarter-report' ELSE 'x' END AS flag, CAST(q_index % 10 AS INT) AS source_fields FROM statements),
  diag2 AS (SELECT *, CASE WHEN revenue > 0 THEN round(least(coalesce(segments, 0) / revenue, 1), 4) END AS seg, CASE WHEN cost_of_revenue > 0 THEN round(least(coalesce(cost_items, 0) / cost_of_revenue, 1), 4) END AS cst, CASE WHEN operating_expenses > 0 THEN round(least(coalesce(opex_items, 0) / operating_expenses, 1), 4) END AS opx,
    list_filter(['revenue', CASE WHEN operating_income IS NULL THEN 'operating_income' END, CASE WHEN net_income IS NULL THEN 'net_income' END], lambda x: x IS NOT NULL AND x <> 'revenue') AS missing FROM (FROM diag))"""


@query("r7_diagnostics", """SELECT company_id, q_index, greatest(0, least(100, 100 - len(missing) * 14 - coalesce(floor(greatest(0.85 - seg, 0) * 24 + 1e-9), 0) - CASE WHEN has_profile THEN 0 ELSE coalesce(floor(greatest(0.75 - cst, 0) * 18 + 1e-9), 0) END - coalesce(floor(greatest(0.75 - opx, 0) * 18 + 1e-9), 0) + least(source_fields, 6)))::BIGINT AS score, (3 - len(missing))::INT AS available,
  array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'missing-required:' || array_to_string(missing, ',') END, CASE WHEN seg < 0.85 THEN 'revenue-segment-coverage-low' END, CASE WHEN NOT has_profile AND cst < 0.6 THEN 'cost-breakdown-coverage-low' END, CASE WHEN opx < 0.6 THEN 'opex-breakdown-coverage-low' END, CASE WHEN value_mode = 'derived' THEN 'statement-derived-quarter' END, CASE WHEN flag = 'summary-quarter-report' THEN 'statement-summary-quarter-report' END], lambda x: x IS NOT NULL), ';') AS issues,
  CASE WHEN cost_items IS NOT NULL THEN 'explicit' WHEN has_profile THEN 'profile-assisted' ELSE 'none' END AS cost_mode, CASE WHEN opex_items IS NOT NULL THEN 'explicit' ELSE 'none' END AS opex_mode, round(seg * 100, 1) AS segment_pct, CASE WHEN NOT has_profile THEN round(cst * 100, 1) END AS cost_pct, round(opx * 100, 1) AS opex_pct,
  CASE WHEN revenue > 0 AND segments IS NOT NULL THEN greatest(revenue - segments, 0) END AS segment_residual, CASE WHEN NOT has_profile AND cost_of_revenue > 0 AND cost_items IS NOT NULL THEN greatest(cost_of_revenue - cost_items, 0) END AS cost_residual, CASE WHEN operating_expenses > 0 AND opex_items IS NOT NULL THEN greatest(operating_expenses - opex_items, 0) END AS opex_residual FROM diag2""", DIAG, money="segment_residual cost_residual opex_residual")  # fmt: skip
def r7(t):
    return R.diagnostics(t.sql("SELECT *, array(flag) AS flags FROM diag", DIAG.split(",\n  diag2")[0]))


UNIFIED = f"unified AS (SELECT company_id, q_index, {', '.join(f'CAST({f} + 1 AS DECIMAL(20,2)) AS {f}' for f in FIELDS)} FROM statements), based AS (SELECT company_id, q_index, {_F} FROM statements WHERE company_id % 4 <> 0 AND q_index % 3 <> 0)"


def unified(t):
    one = lambda f: (F.col(f) + 1).cast("decimal(20,2)").alias(f)
    return t.statements.select("company_id", "q_index", *(one(f) for f in FIELDS)), t.statements.where("company_id % 4 <> 0 and q_index % 3 <> 0").select("company_id", "q_index", *FIELDS)


@query("r8_fill_missing", f"SELECT company_id, q_index, {', '.join(f'coalesce(b.{f}, u.{f}) AS {f}' for f in FIELDS)} FROM based b LEFT JOIN unified u USING (company_id, q_index) UNION ALL SELECT company_id, q_index, {_F} FROM unified WHERE company_id NOT IN (SELECT company_id FROM based)", UNIFIED, money=" ".join(FIELDS))
def r8(t):
    u, b = unified(t)
    return R.fill_missing(b, u, FIELDS)


@query("r9_apply_overrides", f"SELECT company_id, q_index, {', '.join(f'coalesce(u.{f}, b.{f}) AS {f}' for f in FIELDS)} FROM based b FULL JOIN (FROM unified WHERE q_index % 5 = 0) u USING (company_id, q_index)", UNIFIED, money=" ".join(FIELDS))
def r9(t):
    u, b = unified(t)
    return R.apply_overrides(b, u.where("q_index % 5 = 0"), FIELDS)


COMP = """comp AS (SELECT c_custkey AS company_id, concat('C-', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '-Inc' WHEN 1 THEN '-corporation' WHEN 2 THEN ' Company' ELSE '' END) AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('T.', c_custkey) END AS ticker, CASE WHEN c_custkey % 5 = 0 THEN concat('slug-', c_custkey, '-co') END AS slug FROM customer),
  ask AS (SELECT unnest([concat('c', company_id), concat('c-', company_id), concat(' T', company_id), concat('slug-', company_id), concat('slug', company_id, 'co'), concat('nobody', company_id)]) AS name FROM comp)"""
_VALUES = "list_distinct([lower(trim(coalesce(id, ''))), lower(trim(coalesce(ticker, ''))), lower(trim(coalesce(slug, '')))])"
_DROP = " UNION ALL ".join(f"SELECT company_id, replace(v, '{w}', '') AS key FROM vals" for w in R.SUFFIXES)
_END = " UNION ALL ".join(f"SELECT company_id, k[:len(k) - {len(w)}] AS key FROM bare WHERE k LIKE '%{w}'" for w in R.ENDINGS)


@query("r10_resolve_company", "SELECT a.name, min(k.company_id) AS company_id FROM (SELECT DISTINCT name FROM ask) a JOIN keys_ k ON k.key = lower(trim(a.name)) WHERE k.key <> '' GROUP BY a.name",
       f"{COMP}, vals AS (SELECT company_id, unnest({_VALUES}) AS v FROM comp), bare AS (SELECT company_id, regexp_replace(v, '[^a-z0-9]+', '', 'g') AS k FROM vals), keys_ AS (SELECT company_id, v AS key FROM vals UNION ALL SELECT company_id, k FROM bare UNION ALL {_DROP} UNION ALL {_END})")
def r10(t):
    comp = t.sql("SELECT * FROM comp", COMP.split(",\n  ask")[0])
    key = F.col("company_id").cast("string")
    asked = comp.select(F.explode(F.array(F.concat(F.lit("c"), key), F.concat(F.lit("c-"), key), F.concat(F.lit(" T"), key), F.concat(F.lit("slug-"), key), F.concat(F.lit("slug"), key, F.lit("co")), F.concat(F.lit("nobody"), key))).alias("name"))
    return R.resolve_company(asked, comp)


@query("r11_overlay", f"SELECT company_id, q_index, {', '.join((f'coalesce(b.{f}, u.{f})' if f == 'net_income' else f'coalesce(u.{f}, b.{f})') + f' AS {f}' for f in FIELDS)} FROM based b FULL JOIN unified u USING (company_id, q_index)", UNIFIED, money=" ".join(FIELDS))
def r11(t):
    u, b = unified(t)
    return R.overlay(b, u, FIELDS, ("net_income",))


ASOF = "asof_ AS (SELECT p.event_id, p.currency, p.at, arg_max(r.rate, r.rate_date) AS rate FROM probes p LEFT JOIN fx_rates r ON r.currency = p.currency AND r.rate_date BETWEEN p.at - 7 AND p.at GROUP BY ALL)"


@query("x1_fx_asof", "SELECT * FROM asof_", ASOF, dates="at", money="rate")
def x1(t):
    return X.fx_asof(t.probes, t.fx_rates).select("event_id", "currency", "at", "rate")


@query("x2_fx_fallback", "SELECT event_id, currency, company_id, round(coalesce(rate::DOUBLE, median(rate::DOUBLE) OVER (PARTITION BY company_id, currency)), 6) AS rate FROM (SELECT event_id, currency, event_id % 50 AS company_id, CASE WHEN event_id % 3 <> 0 THEN rate END AS rate FROM asof_)", ASOF)
def x2(t):
    rows = X.fx_asof(t.probes, t.fx_rates).select("event_id", "currency", (F.col("event_id") % 50).alias("company_id"), F.when(F.col("event_id") % 3 != 0, F.col("rate")).alias("rate"))
    return X.fx_fallback(rows).select("event_id", "currency", "company_id", F.round("rate", 6).alias("rate"))


@query("x3_scale_rows", "SELECT company_id, q_index, CAST(round(CAST(revenue * 0.913 AS DECIMAL(38,8)), 3) AS DECIMAL(24,3)) AS revenue, CAST(round(CAST(net_income * 0.913 AS DECIMAL(38,8)), 3) AS DECIMAL(24,3)) AS net_income FROM statements", money="revenue net_income")
def x3(t):
    return X.scale_rows(t.statements, ["revenue", "net_income"], F.lit(0.913).cast("decimal(4,3)")).select("company_id", "q_index", "revenue", "net_income")
