"""Queries of the way from facts to statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import facts as A
from quarterlode.operators.concepts import BREAKDOWN_RULES, CONCEPTS, CURRENCY_FIELDS
from quarterlode.plans.registry import query

_VALUES = ", ".join(f"('{c}', '{f}', {len(n) - i}, {len(n) + 2 - i})" for f, n in CONCEPTS.items() for i, c in enumerate(n))
CONCEPT = f"concept_t AS (SELECT * FROM (VALUES {_VALUES}) v(concept, field, concept_priority, weight))"
VALID = """valid AS (SELECT *, CASE namespace WHEN 'us-gaap' THEN 20 ELSE 18 END AS namespace_priority FROM facts
  WHERE form IN ('10-Q','10-K','20-F','6-K','8-K') AND start_date IS NOT NULL AND end_date IS NOT NULL AND value IS NOT NULL AND namespace IN ('us-gaap','ifrs-full'))"""
MAPPED = f"{CONCEPT}, {VALID}, mapped AS (SELECT v.*, c.field, c.concept_priority, filed - end_date AS gap FROM valid v JOIN concept_t c USING (concept))"
RANK = "(gap BETWEEN 0 AND 210) DESC, greatest(gap, 0), namespace_priority DESC, concept_priority DESC, filed DESC, accession DESC"
FIELD_RANK = "(gap BETWEEN 0 AND 210) DESC, concept_priority DESC, namespace_priority DESC, greatest(gap, 0), filed DESC, accession DESC"
DEDUPED = f"{MAPPED}, deduped AS (SELECT * FROM mapped QUALIFY row_number() OVER (PARTITION BY company_id, namespace, concept, start_date, end_date ORDER BY {RANK}) = 1)"
SPLIT = f"""{DEDUPED}, split AS (SELECT * FROM (SELECT *, CASE WHEN end_date - start_date + 1 BETWEEN 45 AND 120 THEN 'direct' WHEN end_date - start_date + 1 BETWEEN 121 AND 390 THEN 'cumulative' END AS span_kind FROM deduped)
  WHERE span_kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, namespace, concept, span_kind, end_date ORDER BY {RANK}) = 1)"""
# A fiscal year has year-to-date spans of two, three and four quarters: three rounds, each on the result of the one before.
_ROUND = """r{n} AS (SELECT company_id, concept, start_date, end_date, value, derived FROM r{m} UNION ALL
  SELECT c.company_id, c.concept, CAST(max(e.end_date) + 1 AS DATE), c.end_date, any_value(c.value) - sum(e.value), true
  FROM split c JOIN r{m} e ON e.company_id = c.company_id AND e.concept = c.concept AND e.start_date >= c.start_date AND e.end_date < c.end_date
  WHERE c.span_kind = 'cumulative' AND round((c.end_date - c.start_date + 1) / 91.0) = {k} AND NOT EXISTS (SELECT 1 FROM r{m} x WHERE x.company_id = c.company_id AND x.concept = c.concept AND x.end_date = c.end_date)
  GROUP BY c.company_id, c.concept, c.start_date, c.end_date HAVING count(*) = {k} - 1)"""
DERIVED = SPLIT + ", r1 AS (SELECT company_id, concept, start_date, end_date, value, false AS derived FROM split WHERE span_kind = 'direct'), " + ", ".join(_ROUND.format(n=k, m=k - 1, k=k) for k in (2, 3, 4))
SERIES = DERIVED + ", series AS (SELECT company_id, CASE concept WHEN 'Revenues' THEN 'revenue' WHEN 'CostOfRevenue' THEN 'cost_of_revenue' ELSE 'tax' END AS field, concat(year(end_date), 'Q', quarter(end_date)) AS quarter, value, derived FROM r4)"


@query("f1_valid_facts", "SELECT accession, concept, start_date, namespace_priority FROM valid WHERE filed >= DATE '1996-01-01'", VALID, dates="start_date")
def f1(t):
    return A.valid_facts(t.facts, filed_from="1996-01-01").select("accession", "concept", "start_date", "namespace_priority")


@query("f2_reporting_currency", f"""SELECT company_id, unit AS currency, CAST(score AS BIGINT) AS score FROM (SELECT company_id, unit, sum(weight) AS score FROM facts JOIN concept_t USING (concept)
  WHERE field IN {CURRENCY_FIELDS} AND form IN ('10-Q','10-K','20-F','6-K','8-K') GROUP BY company_id, unit) QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY score DESC, unit <> 'USD' DESC, unit DESC) = 1""", CONCEPT)  # fmt: skip
def f2(t):
    return A.reporting_currency(t.facts)


@query("f3_map_concepts", "SELECT accession, concept, start_date, field, concept_priority FROM mapped", MAPPED, dates="start_date")
def f3(t):
    return A.map_concepts(A.valid_facts(t.facts)).select("accession", "concept", "start_date", "field", "concept_priority")


def mapped(t):
    return A.map_concepts(A.valid_facts(t.facts))


@query("f4_fact_rank", f"SELECT company_id, concept, start_date, end_date, form, row_number() OVER (PARTITION BY company_id, concept, start_date, end_date ORDER BY {RANK}) AS by_fact, row_number() OVER (PARTITION BY company_id, concept, start_date, end_date ORDER BY {FIELD_RANK}) AS by_field FROM mapped", MAPPED, dates="start_date end_date")
def f4(t):
    from pyspark.sql import Window

    w = Window.partitionBy("company_id", "concept", "start_date", "end_date")
    # The parts of a rank as columns that both orders share, so that a row holds them once.
    parts = mapped(t).select("company_id", "concept", "start_date", "end_date", "form", A.fact_rank().alias("r")).select("company_id", "concept", "start_date", "end_date", "form", "r.*")
    order = lambda *names: w.orderBy(*(F.col(c).desc() for c in names))
    by_fact, by_field = order("timely", "near", "namespace_priority", "concept_priority", "filed", "accession"), order("timely", "concept_priority", "namespace_priority", "near", "filed", "accession")
    return parts.select("company_id", "concept", "start_date", "end_date", "form", F.row_number().over(by_fact).alias("by_fact"), F.row_number().over(by_field).alias("by_field"))


@query("f5_dedupe_facts", "SELECT company_id, concept, start_date, end_date, form, value FROM deduped", DEDUPED, dates="start_date end_date", money="value")
def f5(t):
    return A.dedupe_facts(mapped(t)).select("company_id", "concept", "start_date", "end_date", "form", "value")


@query("f6_split_spans", "SELECT company_id, concept, start_date, end_date, span_kind, value FROM split", SPLIT, dates="start_date end_date", money="value")
def f6(t):
    return A.split_spans(A.dedupe_facts(mapped(t))).select("company_id", "concept", "start_date", "end_date", "span_kind", "value")


@query("f7_derive_quarters", "SELECT * FROM r4", DERIVED, dates="start_date end_date", money="value")
def f7(t):
    return A.derive_quarters(A.split_spans(A.dedupe_facts(mapped(t)))).drop("namespace")


@query("f8_one_per_quarter", "SELECT company_id, concept, concat(year(end_date), 'Q', quarter(end_date)) AS quarter, value FROM r4 WHERE year(end_date) >= 1996", DERIVED, money="value")
def f8(t):
    made = A.derive_quarters(A.split_spans(A.dedupe_facts(mapped(t))))
    return A.one_per_quarter(made, F.struct((~F.col("derived")).alias("d"), "end_date"), floor=1996 * 4).select("company_id", "concept", "quarter", "value")


@query("f9_pick_field", "SELECT * FROM series", SERIES, money="value")
def f9(t):
    return A.field_series(mapped(t))


@query("f10_composite_field", "SELECT company_id, quarter, sum(value) AS value, string_agg(field, '+' ORDER BY field) AS parts, 'cost_and_tax' AS field FROM series WHERE field IN ('cost_of_revenue', 'tax') GROUP BY company_id, quarter", SERIES, money="value")
def f10(t):
    return A.composite_field(A.field_series(mapped(t)), "cost_and_tax", ("cost_of_revenue", "tax"))


_MADE = "made AS (SELECT DISTINCT concat(upper(substr(w, 1, 1)), substr(w, 2), CASE k % 5 WHEN 0 THEN 'CostOfGoodsSold' WHEN 1 THEN 'AdvertisingExpense' WHEN 2 THEN 'ImpairmentLoss' WHEN 3 THEN 'AdministrativeExpense' ELSE 'Income' END) AS concept FROM (SELECT lower(split_part(p_name, ' ', 1)) AS w, p_partkey AS k FROM part) UNION SELECT DISTINCT concept FROM facts UNION SELECT 'CostOfGoodsSold')"
_WHEN = " ".join(f"WHEN concept IN ({', '.join(repr(x) for x in r[3])}) THEN {r[0]}" for r in BREAKDOWN_RULES if r[3]) + " " + " ".join(f"WHEN regexp_matches(lower(concept), '{'|'.join(r[4])}') THEN {100 + r[0]}" for r in BREAKDOWN_RULES)
_NAME = " ".join(f"WHEN {r[0]} THEN '{r[1]}'" for r in BREAKDOWN_RULES)
_KIND = " ".join(f"WHEN {r[0]} THEN '{r[2]}'" for r in BREAKDOWN_RULES)


@query("f11_match_breakdown_rule", f"SELECT concept, CASE n % 100 {_NAME} END AS category, CASE n % 100 {_KIND} END AS kind, n < 100 AS exact FROM (SELECT concept, CASE {_WHEN} END AS n FROM made) WHERE n IS NOT NULL", _MADE)
def f11(t):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, "CostOfGoodsSold").when(k == 1, "AdvertisingExpense").when(k == 2, "ImpairmentLoss").when(k == 3, "AdministrativeExpense").otherwise("Income")
    made = t.part.select(F.concat(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), tail).alias("concept"))
    return A.match_breakdown_rule(made.union(t.facts.select("concept")).union(made.limit(1).select(F.lit("CostOfGoodsSold"))))


@query("f14_quarter_metadata", f"""SELECT company_id, concat(year(end_date), 'Q', quarter(end_date)) AS quarter, end_date, fiscal_year, CASE WHEN fiscal_period IN ('Q1','Q2','Q3','Q4') THEN fiscal_period WHEN fiscal_period = 'FY' THEN 'Q4'
  WHEN end_date - start_date + 1 BETWEEN 120 AND 210 THEN 'Q2' WHEN end_date - start_date + 1 BETWEEN 211 AND 310 THEN 'Q3' WHEN end_date - start_date + 1 >= 311 THEN 'Q4' ELSE '' END AS fiscal_quarter, concept FROM mapped
  QUALIFY row_number() OVER (PARTITION BY company_id, year(end_date), quarter(end_date) ORDER BY {RANK}, concept DESC, start_date DESC) = 1""", MAPPED, dates="end_date")  # fmt: skip
def f14(t):
    return A.quarter_metadata(mapped(t))


COMPLETE = """full_ AS (SELECT *, CASE WHEN operating_expenses - sgna - rnd > 0.01 THEN operating_expenses - sgna - rnd END AS other_opex, pretax_income - operating_income AS non_operating FROM (
  SELECT company_id, q_index, revenue, coalesce(cost_of_revenue, revenue - g) AS cost_of_revenue, g AS gross_profit, sgna, rnd, coalesce(operating_expenses, g - coalesce(operating_income, g - operating_expenses)) AS operating_expenses,
    coalesce(operating_income, g - operating_expenses) AS operating_income, pretax_income, coalesce(tax, pretax_income - net_income) AS tax, net_income FROM (SELECT *, coalesce(gross_profit, revenue - cost_of_revenue) AS g FROM statements)))"""
MONEY = "revenue cost_of_revenue gross_profit sgna rnd operating_expenses operating_income pretax_income tax net_income other_opex non_operating"


@query("f15_complete_statement", "SELECT * FROM full_", COMPLETE, money=MONEY)
def f15(t):
    return A.complete_statement(t.statements).select("company_id", "q_index", *MONEY.split())


def _pct(a: str, b: str, places: int = 2) -> str:
    return f"CAST(round(CAST(({a})::DECIMAL(20,4) * 100 / CASE WHEN ({b}) <> 0 THEN ({b})::DECIMAL(20,4) END AS DECIMAL(38,12)), {places}) AS DOUBLE)"


MARGINS = f"{COMPLETE}, margin_ AS (SELECT *, {_pct('gross_profit', 'revenue')} AS gross_margin_pct, {_pct('operating_income', 'revenue')} AS operating_margin_pct, {_pct('net_income', 'revenue')} AS profit_margin_pct, {_pct('tax', 'pretax_income')} AS effective_tax_rate_pct FROM full_)"
RATES = "gross_margin_pct operating_margin_pct profit_margin_pct effective_tax_rate_pct"


@query("f16_margins", f"SELECT company_id, q_index, {', '.join(RATES.split())} FROM margin_", MARGINS)
def f16(t):
    return A.margins(A.complete_statement(t.statements)).select("company_id", "q_index", *RATES.split())


_PREV = "p AS (SELECT *, lag(revenue, 1) OVER w AS r1, lag(revenue, 4) OVER w AS r4_, lag(net_income, 4) OVER w AS n4, lag(gross_margin_pct, 4) OVER w AS g4 FROM margin_ WINDOW w AS (PARTITION BY company_id ORDER BY q_index))"


@query("f17_growth_positional", f"SELECT company_id, q_index, {_pct('revenue - r1', 'r1')} AS revenue_qoq_pct, {_pct('revenue - r4_', 'r4_')} AS revenue_yoy_pct, CASE WHEN net_income <> 0 THEN {_pct('net_income - n4', 'n4')} END AS net_income_yoy_pct, CAST(round(gross_margin_pct::DECIMAL(38,12) - g4::DECIMAL(38,12), 2) AS DOUBLE) AS gross_margin_yoy_delta_pp FROM p", f"{MARGINS}, {_PREV}")
def f17(t):
    return A.growth_positional(A.margins(A.complete_statement(t.statements))).select("company_id", "q_index", "revenue_qoq_pct", "revenue_yoy_pct", "net_income_yoy_pct", "gross_margin_yoy_delta_pp")


@query("f18_growth_calendar", f"SELECT s.company_id, s.q_index, {_pct('s.revenue - a.revenue', 'a.revenue', 3)} AS revenue_qoq_pct, {_pct('s.revenue - b.revenue', 'b.revenue', 3)} AS revenue_yoy_pct FROM statements s LEFT JOIN statements a ON a.company_id = s.company_id AND a.q_index = s.q_index - 1 LEFT JOIN statements b ON b.company_id = s.company_id AND b.q_index = s.q_index - 4")
def f18(t):
    return A.growth_calendar(t.statements).select("company_id", "q_index", "revenue_qoq_pct", "revenue_yoy_pct")


@query("statements", f"""SELECT s.company_id, s.quarter, s.revenue, s.cost_of_revenue, s.revenue - s.cost_of_revenue AS gross_profit, s.tax, {_pct('s.revenue - s.cost_of_revenue', 's.revenue')} AS gross_margin_pct,
  CASE WHEN s.revenue > 0 AND b.revenue > 0 THEN {_pct('s.revenue - b.revenue', 'b.revenue', 3)} END AS revenue_yoy_pct FROM wide s LEFT JOIN wide b ON b.company_id = s.company_id AND b.q_index = s.q_index - 4""",
       SERIES + ", wide AS (SELECT company_id, quarter, CAST(substr(quarter, 1, 4) AS INT) * 4 + CAST(substr(quarter, 6, 1) AS INT) - 1 AS q_index, max(value) FILTER (field = 'revenue') AS revenue, max(value) FILTER (field = 'cost_of_revenue') AS cost_of_revenue, max(value) FILTER (field = 'tax') AS tax FROM series GROUP BY company_id, quarter)", money="revenue cost_of_revenue gross_profit tax")
def flagship(t):
    return A.statements(t.facts).select("company_id", "quarter", "revenue", "cost_of_revenue", "gross_profit", "tax", "gross_margin_pct", "revenue_yoy_pct")
