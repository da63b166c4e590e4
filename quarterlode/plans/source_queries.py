"""Queries of documents as sources and of breakdown rules over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import breakdowns as K
from quarterlode.plans.registry import query
from quarterlode.sources import documents as S


@query("s1_read_company_facts", "SELECT company_id, namespace, concept, unit, form, accession, filed, fiscal_year, fiscal_period, start_date, end_date, value FROM facts", dates="filed start_date end_date", money="value")
def s1(t):
    f = t.facts
    fact = F.struct(F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"), F.col("value").alias("val"), F.col("accession").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), "form", F.col("filed").cast("string").alias("filed"))
    units = f.groupBy("company_id", "namespace", "concept", "unit").agg(F.collect_list(fact).alias("f"))
    concepts = units.groupBy("company_id", "namespace", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "f"))).alias("units"))
    spaces = concepts.groupBy("company_id", "namespace").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("u")))).alias("c"))
    docs = spaces.groupBy("company_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("namespace", "c"))).alias("facts"))).alias("body"))
    return S.read_company_facts(docs)


@query("s5_read_segment_facts", "SELECT company_id, concept, start_date, end_date, regexp_replace(dims, '[a-z-]+:', '', 'g') AS dims, value FROM dim_facts", dates="start_date end_date", money="value")
def s5(t):
    d = t.dim_facts
    members = F.replace(F.replace("dims", F.lit("="), F.lit('">')), F.lit(";"), F.lit('</explicitMember><explicitMember dimension="'))
    context = F.concat(F.lit('<context id="'), "fact_id", F.lit('"><entity><identifier>x</identifier><segment>'), F.lit('<explicitMember dimension="'), members, F.lit("</explicitMember>"), F.lit("</segment></entity><period><startDate>"), F.col("start_date").cast("string"), F.lit("</startDate><endDate>"), F.col("end_date").cast("string"), F.lit("</endDate></period></context>"))
    fact = F.concat(F.lit("<us-gaap:"), "concept", F.lit(' unitRef="usd" contextRef="'), "fact_id", F.lit('">'), F.col("value").cast("string"), F.lit("</us-gaap:"), "concept", F.lit(">"))
    docs = d.groupBy("company_id", F.year("end_date").alias("y")).agg(F.concat(F.lit("<xbrl>"), F.array_join(F.collect_list(F.concat(context, fact)), ""), F.lit("</xbrl>")).alias("body"))
    dims = F.array_join(F.transform("dims", lambda x: F.concat_ws("=", x["dimension"], x["member"])), ";")
    return S.read_segment_facts(docs).select("company_id", "concept", "start_date", "end_date", dims.alias("dims"), "value")


@query("s6_read_wide_statement", "SELECT company_id, concat(y, 'Q', qn) AS quarter, CAST(round(revenue * 0.001, 3) AS DOUBLE) AS revenue, CAST(round(cost * 0.001, 3) AS DOUBLE) AS cost_of_revenue, CASE WHEN revenue - cost - tax <> 0 THEN CAST(round((revenue - cost - tax) * 0.001, 3) AS DOUBLE) END AS net_income FROM quarters")
def s6(t):
    q = t.quarters.withColumn("quarter", F.concat("y", F.lit("Q"), "qn")).withColumn("net", F.col("revenue") - F.col("cost") - F.col("tax"))
    shown = lambda c: F.when(F.col(c) < 0, F.concat(F.lit("("), F.format_number(-F.col(c), 2), F.lit(")"))).otherwise(F.format_number(F.col(c), 2))
    cells = q.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("q_index", "quarter", shown("revenue").alias("a"), shown("cost").alias("b"), shown("net").alias("c")))).alias("x"))
    lines = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.col(f"x.{k}").alias("cells")) for i, (label, k) in enumerate((("Revenue ", "a"), ("Cost of Sales", "b"), ("Total Revenue", "b"), ("Net Income", "c"), ("Dividends", "a")))))
    table = cells.select("company_id", F.col("x.quarter").alias("quarters"), F.explode(lines).alias("l")).select("company_id", "quarters", "l.*")
    return S.read_wide_statement(table).select("company_id", "quarter", "revenue", "cost_of_revenue", "net_income")


@query("s7_read_overrides", "SELECT CAST(company_id AS VARCHAR) AS company, quarter, revenue, CAST(NULL AS DOUBLE) AS tax FROM statements", money="revenue")
def s7(t):
    q = t.statements.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("quarter", F.struct("revenue", F.lit("n/a").alias("tax"))))).alias("q"))
    docs = q.select(F.to_json(F.create_map(F.col("company_id").cast("string"), "q")).alias("body"))
    return S.read_overrides(docs, ("revenue", "tax"))


SUPPLEMENTS = """sup AS (SELECT company_id, '_default' AS quarter, CAST(NULL AS DECIMAL(20,2)) AS traffic_acquisition_cost, CAST(5 AS DECIMAL(20,2)) AS other_cost_of_revenue, CAST(NULL AS DECIMAL(20,2)) AS sgna, CAST(company_id AS DECIMAL(20,2)) AS rnd, 'd' AS profile FROM companies WHERE company_id % 3 = 0
  UNION ALL SELECT company_id, quarter, cost_of_revenue, CASE WHEN q_index % 2 = 0 THEN revenue END, sgna, NULL, CASE WHEN q_index % 4 = 0 THEN 'q' END FROM statements WHERE company_id % 2 = 0 AND q_index % 3 = 0)"""


@query("s8_expand_supplements", """SELECT company_id, quarter, t AS traffic_acquisition_cost, o AS other_cost_of_revenue, r AS rnd, p AS profile, (CASE WHEN t IS NULL THEN 0 ELSE 1 END + CASE WHEN o IS NULL THEN 0 ELSE 1 END + CASE WHEN g IS NULL THEN 0 ELSE 1 END + CASE WHEN r IS NULL THEN 0 ELSE 1 END)::INT AS items FROM (
  SELECT s.company_id, s.quarter, coalesce(a.traffic_acquisition_cost, d.traffic_acquisition_cost) AS t, coalesce(a.other_cost_of_revenue, d.other_cost_of_revenue) AS o, coalesce(a.sgna, d.sgna) AS g, coalesce(a.rnd, d.rnd) AS r, coalesce(a.profile, d.profile) AS p
  FROM statements s LEFT JOIN sup a ON a.company_id = s.company_id AND a.quarter = s.quarter LEFT JOIN sup d ON d.company_id = s.company_id AND d.quarter = '_default') WHERE coalesce(t, o, g, r) IS NOT NULL OR p IS NOT NULL""", SUPPLEMENTS, money="traffic_acquisition_cost other_cost_of_revenue rnd")  # fmt: skip
def s8(t):
    return S.expand_supplements(t.sql("SELECT * FROM sup", SUPPLEMENTS), t.statements).select("company_id", "quarter", "traffic_acquisition_cost", "other_cost_of_revenue", "rnd", "profile", F.size("items").alias("items"))


@query("s9_derive_opex_from_profit_items", "SELECT company_id, q_index, CASE WHEN q_index % 2 = 0 THEN 'own' WHEN rnd > 20000 THEN 'Research' END AS first_item, CASE WHEN q_index % 2 = 0 THEN 1 WHEN rnd > 20000 THEN 1 ELSE 0 END AS items FROM statements")
def s9(t):
    item = lambda name, value, fmt: F.struct(F.lit(name).alias("name"), value.alias("value"), fmt.alias("value_format"))
    fmt = F.when(F.col("rnd") > 20000, "negative-parentheses").otherwise("plain")
    profit = F.array(item("Research", F.col("rnd"), fmt), item("Gain", F.col("revenue"), F.lit("plain")), item("Nothing", F.lit(None).cast("decimal(20,2)"), F.lit("negative-parentheses")))
    at = t.statements.withColumn("profit_items", profit).withColumn("opex", F.when(F.col("q_index") % 2 == 0, F.array(item("own", F.col("sgna"), F.lit("plain")))).otherwise(F.array().cast("array<struct<name:string,value:decimal(20,2),value_format:string>>")))
    return S.derive_opex_from_profit_items(at).select("company_id", "q_index", F.get("opex", F.lit(0))["name"].alias("first_item"), F.size("opex").alias("items"))


@query("s12_write_dataset", "SELECT c.company_id, count(s.q_index) AS quarter_count, count(g.q_index) AS segment_quarter_count, min(s.q_index) AS first_q, coalesce(sum(g.n), 0)::BIGINT AS segment_rows FROM companies c LEFT JOIN statements s USING (company_id) LEFT JOIN (SELECT company_id, q_index, count(*) AS n FROM segments GROUP BY ALL) g ON g.company_id = s.company_id AND g.q_index = s.q_index GROUP BY c.company_id")
def s12(t):
    docs = S.dataset(t.companies.select("company_id", "name"), t.statements, t.segments)
    rows = F.aggregate(F.coalesce("quarters", F.array()), F.lit(0).cast("long"), lambda a, q: a + F.greatest(F.size(q["segments"]), F.lit(0)))
    return docs.select("company_id", "quarter_count", "segment_quarter_count", F.get("quarters", F.lit(0))["q_index"].alias("first_q"), rows.alias("segment_rows"))


COMPANIES = """dim AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN concat('T.', c_custkey) END AS ticker, CASE WHEN c_custkey % 5 = 0 THEN 'My Slug!' END AS slug, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS rank FROM customer),
  back AS (SELECT c_custkey AS company_id, concat('Back ', c_custkey) AS name FROM customer WHERE c_custkey % 6 = 0)"""
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("q8_complete_companies", f"""SELECT company_id, name, {_SLUG.format('coalesce(slug, ticker, name)')} AS slug, coalesce(rank, (SELECT max(rank) FROM dim) + row_number() OVER (PARTITION BY rank IS NULL ORDER BY name, company_id))::INT AS rank
  FROM (SELECT d.company_id, coalesce(nullif(trim(d.name), ''), b.name) AS name, ticker, slug, rank FROM dim d LEFT JOIN back b USING (company_id))""", COMPANIES)  # fmt: skip
def q8(t):
    dim = t.sql("SELECT company_id, name, ticker, slug, CAST(rank AS INT) AS rank FROM dim", COMPANIES)
    return S.complete_companies(dim, t.sql("SELECT * FROM back", COMPANIES), ("name",)).select("company_id", "name", "slug", "rank")


LINES = """opex_t AS (SELECT company_id, q_index, revenue * 0.3 AS total, CASE WHEN q_index % 3 = 0 THEN revenue * 0.05 END AS sales_marketing, revenue * 0.04 AS marketing, CASE WHEN q_index % 2 = 0 THEN revenue * 0.03 END AS general_administrative, revenue * 0.1 AS sgna,
  CASE WHEN company_id % 3 = 0 THEN -1 ELSE revenue * 0.12 END AS rnd, CASE WHEN q_index % 5 = 0 THEN revenue * 0.02 END AS fulfillment FROM quarters)"""
_ITEMS = [("Fulfillment", "fulfillment"), ("Sales & Marketing", "sales_marketing"), ("Marketing", "CASE WHEN sales_marketing > 0 THEN NULL ELSE marketing END"), ("G&A", "general_administrative"), ("SG&A", "CASE WHEN general_administrative > 0 THEN NULL ELSE sgna END"), ("R&D", "rnd")]


@query("f13_opex_breakdown", "SELECT company_id, q_index, name, CAST(value AS DECIMAL(20,2)) AS value FROM long UNION ALL SELECT company_id, q_index, 'Other OpEx', CAST(total - s AS DECIMAL(20,2)) FROM (SELECT company_id, q_index, any_value(total) AS total, sum(value) AS s FROM long GROUP BY ALL) WHERE total > 0 AND s > 0 AND total - s > greatest(25000, total * 0.01)",
       LINES + ", long AS (" + " UNION ALL ".join(f"SELECT company_id, q_index, total, '{n}' AS name, CAST({c} AS DECIMAL(20,2)) AS value FROM opex_t WHERE {c} > 0" for n, c in _ITEMS) + ")", money="value")
def f13(t):
    cols = ("total", "sales_marketing", "marketing", "general_administrative", "sgna", "rnd", "fulfillment")
    at = t.sql("SELECT * FROM opex_t", LINES).select("company_id", "q_index", *(F.col(c).cast("decimal(20,2)").alias(c) for c in cols))
    return K.opex_breakdown(at, least=25_000)


LISTS = """lists AS (SELECT company_id, q_index, source_id, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM labels_seen GROUP BY ALL)"""


@query("e3_merge_breakdown_longer", "SELECT company_id, q_index, source_id, n, names FROM lists QUALIFY row_number() OVER (PARTITION BY company_id, q_index ORDER BY n DESC, source_id) = 1", LISTS)
def e3(t):
    items = t.labels_seen.groupBy("company_id", "q_index", "source_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("items"))
    return K.merge_breakdown_longer(items, F.col("source_id")).select("company_id", "q_index", "source_id", F.size("items").cast("long").alias("n"), F.array_join(F.col("items.name"), "|").alias("names"))


MODES = """modes AS (SELECT company_id, q_index, 'direct' AS value_mode, CASE WHEN (company_id + q_index) % 4 <> 0 THEN revenue END AS revenue, CASE WHEN q_index % 3 <> 0 THEN net_income END AS net_income, 'own|derived-from-cumulative' AS flags, 'x' AS derived_from FROM statements WHERE (company_id + q_index) % 3 <> 0
  UNION ALL SELECT company_id, q_index, 'derived', CAST(revenue + 1 AS DECIMAL(20,2)), CAST(net_income + 1 AS DECIMAL(20,2)), 'derived-from-cumulative', 'span' FROM statements WHERE q_index % 5 <> 0)"""


@query("e7_prefer_direct", """SELECT company_id, q_index, coalesce(d.value_mode, v.value_mode) AS value_mode, coalesce(d.revenue, v.revenue) AS revenue, coalesce(d.net_income, v.net_income) AS net_income, CASE WHEN d.value_mode IS NULL THEN v.flags WHEN v.value_mode IS NULL THEN d.flags ELSE 'own' END AS flags, CASE WHEN d.value_mode IS NULL THEN v.derived_from WHEN v.value_mode IS NULL THEN d.derived_from END AS derived_from
  FROM (FROM modes WHERE value_mode = 'direct') d FULL JOIN (FROM modes WHERE value_mode = 'derived') v USING (company_id, q_index)""", MODES, money="revenue net_income")  # fmt: skip
def e7(t):
    at = t.sql("SELECT * FROM modes", MODES).withColumn("flags", F.split("flags", "\\|"))
    return K.prefer_direct(at, ("revenue", "net_income"), ("derived_from",)).withColumn("flags", F.array_join("flags", "|"))
