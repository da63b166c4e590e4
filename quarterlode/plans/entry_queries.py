"""Queries of period entries, quality repairs and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import entries as E
from quarterlode.operators import quality as Q
from quarterlode.plans.label_queries import ENTRIES, FIELDS, entries
from quarterlode.plans.registry import query
from quarterlode.sources import filings as S

_F = ", ".join(FIELDS)
_HAVE = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in FIELDS)
RANKED = f"{ENTRIES}, ranked AS (SELECT *, {_HAVE} AS have, coalesce(abs(revenue), 0) AS sz, CASE WHEN cost_of_revenue IS NULL THEN 0 ELSE 1 END AS hc FROM entries)"
_R = "(have, flags, hc, sz, source_id)"


def rank():
    return F.struct(E.entry_score(FIELDS, F.size("quality_flags") > 0).alias("s"), "source_id")


@query("e1_entry_score", "SELECT company_id, q_index, source_id, row_number() OVER (PARTITION BY company_id, q_index ORDER BY have DESC, flags DESC, hc DESC, sz DESC, source_id DESC) AS place FROM ranked", RANKED)
def e1(t):
    from pyspark.sql import Window

    return entries(t).select("company_id", "q_index", "source_id", F.row_number().over(Window.partitionBy("company_id", "q_index").orderBy(rank().desc())).alias("place"))


_PAGED = f"""{ENTRIES}, paged AS (SELECT *, CASE (company_id + q_index + length(source_id)) % 3 WHEN 0 THEN 'generic-ir-pdf-release-summary' WHEN 1 THEN 'generic-ir-pdf-summary' ELSE 'generic-ir-pdf' END AS source, CASE (company_id * 2 + q_index + length(source_id)) % 3 WHEN 0 THEN 'Direct' WHEN 1 THEN 'derived' END AS value_mode, (company_id + q_index) % 2 = 0 AND source_id <> 'manual_financials' AS listed FROM entries)"""


@query("e1_page_entry_score", f"""SELECT company_id, q_index, source_id, row_number() OVER (PARTITION BY company_id, q_index ORDER BY {_HAVE} DESC, listed DESC, (cost_of_revenue IS NOT NULL) DESC, CASE source WHEN 'generic-ir-pdf-release-summary' THEN 2 WHEN 'generic-ir-pdf-summary' THEN 1 ELSE 0 END DESC,
  CASE lower(value_mode) WHEN 'direct' THEN 2 WHEN 'derived' THEN 1 ELSE 0 END DESC, coalesce(abs(revenue), 0) DESC, source_id DESC) AS place FROM paged""", _PAGED)  # fmt: skip
def e1_page(t):
    from pyspark.sql import Window

    k, n = F.col("company_id") + F.col("q_index"), F.length("source_id")
    at = entries(t).withColumns({"source": F.when((k + n) % 3 == 0, "generic-ir-pdf-release-summary").when((k + n) % 3 == 1, "generic-ir-pdf-summary").otherwise("generic-ir-pdf"), "value_mode": F.when((k + F.col("company_id") + n) % 3 == 0, "Direct").when((k + F.col("company_id") + n) % 3 == 1, "derived")})
    score = F.struct(E.page_entry_score(FIELDS, (k % 2 == 0) & (F.col("source_id") != "manual_financials")).alias("s"), "source_id")
    return at.select("company_id", "q_index", "source_id", F.row_number().over(Window.partitionBy("company_id", "q_index").orderBy(score.desc())).alias("place"))


@query("e2_merge_period_entries", f"SELECT company_id, q_index, {', '.join(f'arg_max({f}, {_R}) FILTER ({f} IS NOT NULL) AS {f}' for f in FIELDS)}, arg_max(source_id, {_R}) AS source_id, CASE WHEN max(flags) > 0 THEN 'x' ELSE '' END AS flags FROM ranked GROUP BY 1, 2", RANKED, money=" ".join(FIELDS))
def e2(t):
    return E.merge_period_entries(entries(t), FIELDS, rank())


SPANS = """spans AS (SELECT *, CASE WHEN (company_id + q_index) % 7 = 0 THEN 'EUR' WHEN q_index % 5 = 0 THEN '' ELSE 'USD' END AS currency FROM (SELECT company_id, q_index, 1 AS span, qn, y, revenue, cost, tax FROM quarters WHERE (company_id + q_index) % 3 <> 0
  UNION ALL SELECT * FROM (SELECT company_id, q_index, qn AS span, qn, y, CAST(sum(revenue) OVER w AS DECIMAL(20,2)), CAST(sum(cost) OVER w AS DECIMAL(20,2)), CAST(sum(tax) OVER w AS DECIMAL(20,2)) FROM quarters WINDOW w AS (PARTITION BY company_id, y ORDER BY qn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE span >= 2 AND (company_id * 3 + q_index) % 5 <> 0) every_)"""
_STEP = """f{k} AS (SELECT * FROM f{j} UNION ALL SELECT company_id, q_index, y, true, currency, revenue - r, cost - c, tax - x FROM (
  SELECT s.company_id, s.q_index, s.y, s.currency, s.revenue, s.cost, s.tax, s.currency = '' OR bool_and(p.currency IN ('', s.currency)) AS pc, s.currency = '' OR bool_and(h.currency IN ('', s.currency)) AS mc, coalesce(any_value(p.revenue), sum(h.revenue)) AS r, coalesce(any_value(p.cost), sum(h.cost)) AS c, coalesce(any_value(p.tax), sum(h.tax)) AS x, any_value(p.revenue) IS NOT NULL AS direct, count(h.q_index) AS n
  FROM spans s LEFT JOIN spans p ON p.company_id = s.company_id AND p.q_index = s.q_index - 1 AND p.span = {k} - 1 LEFT JOIN f{j} h ON h.company_id = s.company_id AND h.q_index < s.q_index AND h.q_index > s.q_index - {k}
  WHERE s.span = {k} AND NOT EXISTS (SELECT 1 FROM f{j} z WHERE z.company_id = s.company_id AND z.q_index = s.q_index) GROUP BY s.company_id, s.q_index, s.y, s.currency, s.revenue, s.cost, s.tax) WHERE CASE WHEN direct THEN pc ELSE n = {k} - 1 AND mc END AND revenue - r >= -0.001 AND cost - c >= -0.001)"""
FINAL = SPANS + ", f1 AS (SELECT company_id, q_index, y, false AS derived, currency, revenue, cost, tax FROM spans WHERE span = 1), " + ", ".join(_STEP.format(k=k, j=k - 1) for k in (2, 3, 4))


def spans(t):
    return t.sql("SELECT * FROM spans", SPANS)


@query("e4_derive_from_cumulative", "SELECT company_id, q_index, derived, currency, revenue, cost, tax FROM f4", FINAL, money="revenue cost tax")
def e4(t):
    return E.finalize_quarters(spans(t), ["revenue", "cost", "tax"], ["revenue", "cost"])


@query("e6_derive_breakdown", "SELECT a.company_id, a.q_index, a.member_key, a.value - coalesce(b.value, 0) AS value FROM segments a LEFT JOIN (SELECT company_id, q_index + 1 AS q_index, member_key, value FROM segments) b USING (company_id, q_index, member_key) WHERE abs(a.value - coalesce(b.value, 0)) > 0.0005", money="value")
def e6(t):
    s = t.segments.select("company_id", "q_index", "member_key", "value")
    return E.derive_breakdown(s, s.withColumn("q_index", F.col("q_index") + 1))


@query("e8_drop_low_quality", "SELECT company_id, q_index FROM statements WHERE (CASE WHEN operating_income IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN gross_profit IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN cost_of_revenue IS NOT NULL THEN 1 ELSE 0 END) >= 2 OR coalesce(tax, pretax_income) IS NOT NULL")
def e8(t):
    return E.drop_low_quality(t.statements, ("operating_income", "gross_profit", "cost_of_revenue"), ("tax", "pretax_income")).select("company_id", "q_index")


INFLATED = """st AS (SELECT company_id, q_index, y, qn, CAST(CASE WHEN qn = 4 AND company_id % 3 <> 2 THEN revenue * 4 ELSE revenue END AS DECIMAL(20,2)) AS revenue FROM statements),
  sg AS (SELECT company_id, q_index, member_key, CAST(CASE WHEN q_index % 4 = 3 AND company_id % 3 = 1 THEN value * 4 ELSE value END AS DECIMAL(20,2)) AS value FROM segments)"""
REPAIR = f"""{INFLATED}, sums AS (SELECT company_id, q_index, sum(value)::DOUBLE AS seg, count(*) AS n FROM sg WHERE value > 0 GROUP BY 1, 2),
  base AS (SELECT company_id, y, median(revenue::DOUBLE) AS b, count(*) AS three, median(CASE WHEN n >= 2 THEN seg END) AS sb FROM st LEFT JOIN sums USING (company_id, q_index) WHERE qn < 4 AND revenue > 0 GROUP BY 1, 2),
  ratio AS (SELECT a.company_id, a.q_index, median(a.value::DOUBLE / b.value::DOUBLE) AS mid, max(a.value::DOUBLE / b.value::DOUBLE) - min(a.value::DOUBLE / b.value::DOUBLE) AS spread, count(*) AS pairs FROM sg a JOIN sg b ON a.company_id = b.company_id AND a.member_key = b.member_key AND a.q_index = b.q_index + 1 WHERE a.q_index % 4 = 3 AND a.value > 0.05 AND b.value > 0.05 GROUP BY 1, 2),
  x AS (SELECT st.company_id, st.q_index, st.revenue::DOUBLE AS revenue, seg, mid, coalesce(odd AND seg <= 1.6::DOUBLE * sb AND st.revenue::DOUBLE >= 1.8::DOUBLE * seg, false) AS al, coalesce(odd AND pairs >= 2 AND mid BETWEEN 2.6 AND 5.4 AND spread <= 1.8, false) AS dv FROM (
    SELECT st.*, s.seg, b.sb, r.mid, r.spread, r.pairs, st.qn = 4 AND b.three = 3 AND st.revenue::DOUBLE >= 2.6::DOUBLE * b.b AND s.n >= 2 AS odd FROM st LEFT JOIN sums s USING (company_id, q_index) LEFT JOIN base b ON b.company_id = st.company_id AND b.y = st.y LEFT JOIN ratio r ON r.company_id = st.company_id AND r.q_index = st.q_index) st)"""


def inflated(t):
    s = t.statements.withColumn("revenue", F.when((F.col("qn") == 4) & (F.col("company_id") % 3 != 2), F.col("revenue") * 4).otherwise(F.col("revenue")).cast("decimal(20,2)"))
    g = t.segments.withColumn("value", F.when((F.col("q_index") % 4 == 3) & (F.col("company_id") % 3 == 1), F.col("value") * 4).otherwise(F.col("value")).cast("decimal(20,2)"))
    return s, g


@query("q1_repair_q4", "SELECT company_id, q_index, round(CASE WHEN al THEN seg WHEN dv THEN revenue / CASE WHEN mid BETWEEN 3.3 AND 4.7 THEN 4.0::DOUBLE ELSE round(mid, 3) END ELSE revenue END, 2) AS revenue, CASE WHEN al THEN 'aligned' WHEN dv THEN 'normalized' ELSE '' END AS flag FROM x", REPAIR)
def q1(t):
    return Q.repair_q4(*inflated(t))


@query("q2_clear_bridge", "SELECT company_id, q_index, CASE WHEN NOT bad THEN gross_profit END AS gross_profit, CASE WHEN NOT bad THEN net_income END AS net_income, bad AS cleared FROM (SELECT *, coalesce(revenue > 0 AND greatest(gross_profit, net_income) > revenue * 1.18, false) AS bad FROM (SELECT company_id, q_index, CAST(CASE WHEN q_index % 5 = 0 THEN revenue / 4 ELSE revenue END AS DECIMAL(20,2)) AS revenue, gross_profit, net_income FROM statements))", money="gross_profit net_income")
def q2(t):
    s = t.statements.withColumn("revenue", F.when(F.col("q_index") % 5 == 0, F.col("revenue") / 4).otherwise(F.col("revenue")).cast("decimal(20,2)"))
    return Q.clear_bridge(s, ["gross_profit", "net_income"]).select("company_id", "q_index", "gross_profit", "net_income", "cleared")


@query("q3_repair_units", "SELECT company_id, q_index, member_key, CASE WHEN NOT coalesce(mx > 500 AND mx > revenue * 8 AND sm > revenue * 8, false) THEN v::DOUBLE WHEN q_index % 3 = 0 THEN value::DOUBLE ELSE round(value::DOUBLE / 1000, 3) END AS value FROM (SELECT *, max(v) OVER w AS mx, sum(v) OVER w AS sm FROM (SELECT a.*, CASE WHEN a.q_index % 3 = 0 THEN value * 1000 ELSE value END AS v, s.revenue FROM segments a LEFT JOIN statements s USING (company_id, q_index)) WINDOW w AS (PARTITION BY company_id, q_index))", money="value")
def q3(t):
    rows = t.segments.select("company_id", "q_index", "member_key", F.when(F.col("q_index") % 3 == 0, F.col("value") * 1000).otherwise(F.col("value")).cast("decimal(24,2)").alias("value"))
    return Q.repair_units(rows, t.statements)


@query("q4_eligible_quarters", "SELECT company_id, q_index FROM (SELECT *, bool_or(ok) OVER (PARTITION BY company_id) AS some_ FROM (SELECT s.company_id, s.q_index, company_id % 4 <> 0 AND s.q_index % 4 IN (1, 3) AND EXISTS (SELECT 1 FROM segments g WHERE g.company_id = s.company_id AND g.q_index = s.q_index) AS ok FROM statements s)) WHERE ok OR NOT some_")
def q4(t):
    return Q.eligible_quarters(t.statements, t.segments.where("company_id % 4 <> 0"), (2, 4))


@query("q5_rank_companies", "SELECT company_id, name, lower(name || ' ' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g')) AS search, s_acctbal FROM companies")
def q5(t):
    return Q.rank_companies(t.companies)


@query("q6_coverage", "SELECT company_id, count(*) AS quarters, count(gross_profit) AS n_gross_profit, count(tax) AS n_tax, min(q_index) AS first_q, max(q_index) AS last_q FROM statements GROUP BY 1")
def q6(t):
    return Q.coverage(t.statements, ["gross_profit", "tax"])


@query("q7_pick_quarter", "SELECT l.company_id, CASE WHEN l.company_id % 2 = 1 THEN l.q WHEN EXISTS (SELECT 1 FROM statements s WHERE s.company_id = l.company_id AND s.q_index = 7990) THEN 7990 END AS q_index, CASE WHEN l.company_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM statements s WHERE s.company_id = l.company_id AND s.q_index = 7990) THEN 'missing' ELSE '' END AS error FROM (SELECT company_id, max(q_index) AS q FROM statements GROUP BY 1) l")
def q7(t):
    return Q.pick_quarter(t.statements, t.companies.where("company_id % 2 = 0").select("company_id", F.lit(7990).alias("requested")))


@query("s2_read_filings", "SELECT company_id, form, accession, filing_date, primary_document FROM filings", dates="filing_date")
def s2(t):
    index = t.filings.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("accession", "primary_document", "form", "filing_date"))).alias("f")).select("company_id", *(F.col(f"f.{c}").alias(c) for c in S.FILING))
    return S.read_filings(index)


@query("s3_select_filings", "SELECT company_id, accession, filing_date, primary_document, form FROM filings WHERE form IN ('10-Q', '10-K') AND filing_date >= DATE '1996-06-01' QUALIFY row_number() OVER (PARTITION BY company_id, accession ORDER BY filing_date, primary_document, form) = 1", dates="filing_date")
def s3(t):
    return S.select_filings(t.filings, ("10-Q", "10-K"), "1996-06-01")


@query("s4_merge_filings", "SELECT company_id, accession, coalesce(b.form, a.form) AS form, coalesce(b.filing_date, a.filing_date) AS filing_date FROM (SELECT company_id, accession, min(form) AS form, min(filing_date) AS filing_date FROM filings WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2) a FULL JOIN (SELECT company_id, accession, max(form) AS form, max(filing_date) AS filing_date FROM filings WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2) b USING (company_id, accession)", dates="filing_date")
def s4(t):
    one = lambda df, f: df.groupBy("company_id", "accession").agg(f("form").alias("form"), f("filing_date").alias("filing_date"))
    return S.merge_filings(one(t.filings.where("o_orderkey % 3 <> 0"), F.min), one(t.filings.where("o_orderkey % 3 <> 1"), F.max))


@query("s10_refresh", "SELECT company_id, q_index, revenue FROM statements WHERE company_id % 5 <> 0 UNION ALL SELECT company_id, q_index, revenue + 1 FROM statements WHERE company_id % 5 = 0 AND q_index % 2 = 0", money="revenue")
def s10(t):
    s = t.statements.select("company_id", "q_index", "revenue")
    return S.refresh(s, s.where("q_index % 2 = 0").withColumn("revenue", (F.col("revenue") + 1).cast("decimal(20,2)")), F.col("company_id") % 5 == 0)


@query("s11_keep_last_good", "SELECT company_id, q_index, revenue + 1 AS revenue FROM statements WHERE company_id % 5 = 0 AND q_index % 2 = 0 UNION ALL SELECT company_id, q_index, revenue FROM statements WHERE company_id % 5 <> 0", money="revenue")
def s11(t):
    s = t.statements.select("company_id", "q_index", "revenue")
    return S.keep_last_good(s, s.where("company_id % 5 = 0 and q_index % 2 = 0").withColumn("revenue", (F.col("revenue") + 1).cast("decimal(20,2)")))


@query("s11_merge_errors", "SELECT company_id, CASE WHEN company_id % 4 = 1 THEN concat('b', company_id % 2, ',c') WHEN company_id % 5 <> 0 THEN concat('a,b', company_id % 3) ELSE concat('a,b', company_id % 3, CASE WHEN company_id % 3 <> company_id % 2 THEN concat(',b', company_id % 2) ELSE '' END, ',c') END AS errors FROM companies WHERE company_id % 4 <> 1 OR company_id % 5 = 0")
def s11_errors(t):
    b = lambda n: F.concat(F.lit("b"), (F.col("company_id") % n).cast("string"))
    old = t.companies.where("company_id % 4 <> 1").select("company_id", F.array(F.lit("a"), b(3), F.lit("a")).alias("errors"))
    new = t.companies.where("company_id % 5 = 0").select("company_id", F.array(b(2), F.lit("c")).alias("errors"))
    return S.merge_errors(old, new).select("company_id", F.array_join("errors", ",").alias("errors"))


@query("s13_resolve_identifier", "SELECT c.company_id, c.name AS ticker, r.registry_id FROM companies c LEFT JOIN (SELECT regexp_replace(upper(replace(c_name, 'Customer', 'Supplier')), '[^A-Z0-9]+', '', 'g') AS k, min(c_custkey) AS registry_id FROM customer GROUP BY 1) r ON r.k = regexp_replace(upper(c.name), '[^A-Z0-9]+', '', 'g')")
def s13(t):
    registry = t.customer.select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("ticker"), F.col("c_custkey").alias("registry_id"))
    return S.resolve_identifier(t.companies.select("company_id", F.col("name").alias("ticker")), registry)
