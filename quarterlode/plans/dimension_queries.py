"""Queries of dimensional facts and revenue structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import dimensions as D
from quarterlode.plans.registry import query

_L = "list_transform({0}, lambda m: lower(m))"


def _list(words) -> str:
    return "[" + ", ".join(repr(w) for w in words) + "]"


def _any(text: str, words) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


LABEL = "trim(regexp_replace(regexp_replace({0}, '(?i)member$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))"
NORM = "trim(regexp_replace(lower(replace({0}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"
_ML = NORM.format(LABEL.format("member"))
_AXIS = f"CASE WHEN {_any('lower(axis)', D.BUSINESS_AXES)} THEN 100 WHEN {_any('lower(axis)', D.PRODUCT_AXES)} THEN 80 WHEN contains(lower(axis), 'segment') OR contains(lower(axis), 'business') THEN 60 ELSE 0 END"
_PLACE = f"({_any(_ML, D.PLACES)} OR ({_ML} <> '' AND len(list_filter(string_split({_ML}, ' '), lambda w: NOT list_contains({_list(D.PLACE_WORDS)}, w))) = 0))"
_REV = "CASE concept " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.REVENUE_CONCEPTS.items()) + " ELSE 70 END"
_GENERIC = f"""(lower(member) IN {D.WHOLE_MEMBERS} OR (lower(member) IN {D.PRODUCT_MEMBERS} AND len(list_distinct(list_filter({_L.format('among')}, lambda m: NOT list_contains({_list((*D.PRODUCT_MEMBERS, *D.SERVICE_MEMBERS))}, m)))) >= 2)
  OR (lower(member) IN {D.SERVICE_MEMBERS} AND len(list_filter({_L.format('among')}, lambda m: NOT list_contains({_list(D.SERVICE_MEMBERS)}, m) AND {_any('m', D.SERVICE_WORDS)})) > 0))"""
PARTS = """parts AS (SELECT fact_id, i, regexp_replace(split_part(p, '=', 1), '^.*:', '') AS axis, regexp_replace(split_part(p, '=', 2), '^.*:', '') AS member FROM (
  SELECT fact_id, unnest(string_split(dims, ';')) AS p, generate_subscripts(string_split(dims, ';'), 1) AS i FROM dim_facts) WHERE contains(p, '='))"""
CHOSEN = f"""{PARTS}, known AS (SELECT *, {_AXIS} AS axis_priority FROM parts WHERE lower(axis) NOT IN {D.IGNORED_AXES}),
  axes AS (SELECT fact_id, axis, axis_priority FROM known WHERE axis_priority > 0 QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY axis_priority DESC, i) = 1),
  own AS (SELECT fact_id, i, axis, a.axis_priority, member, list(member) OVER (PARTITION BY fact_id) AS among FROM known k JOIN axes a USING (fact_id, axis)),
  members AS (SELECT fact_id, axis, axis_priority, member FROM own QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY CASE WHEN lower(member) IN {D.GENERIC_MEMBERS} THEN 3 WHEN {_GENERIC} THEN 2 WHEN {_PLACE} THEN 1 ELSE 0 END, i DESC) = 1),
  chosen AS (SELECT f.*, m.axis, m.axis_priority, m.member, {_REV} AS concept_priority FROM dim_facts f JOIN members m USING (fact_id))"""


def revenue_facts(t):
    return t.dim_facts.withColumn("concept_priority", D.revenue_priority(F.col("concept"))).where("concept_priority > 0")


def facts(t):
    return revenue_facts(t).withColumn("dims", D.parse_dims(F.col("dims")))


def chosen(t):
    return D.select_axis(facts(t))


@query("g1_select_axis", "SELECT fact_id, axis, axis_priority, member FROM chosen", CHOSEN)
def g1(t):
    return chosen(t).select("fact_id", "axis", "axis_priority", "member")


SCORED = f"""{CHOSEN}, stat AS (SELECT company_id, axis, max(axis_priority) AS p, list(DISTINCT member) AS among, count(DISTINCT end_date) AS periods, sum(concept_priority)::BIGINT AS weight FROM chosen GROUP BY ALL),
  each_ AS (SELECT company_id, axis, member, {_GENERIC} AS generic, {_PLACE} AS place, {_any(_ML, ('aggregation before other operating', 'reportable aggregation', 'segment aggregation', 'business segments', 'operating segments', 'consolidated', 'total company', 'total segment'))} AS whole FROM (SELECT company_id, axis, among, unnest(among) AS member FROM stat)),
  sums AS (SELECT company_id, axis, count(*) AS n, count(*) FILTER (NOT generic) AS own, count(*) FILTER (place) AS places, count(*) FILTER (whole) AS wholes FROM each_ GROUP BY ALL),
  score_t AS (SELECT company_id, axis, p + CASE WHEN {_any('lower(axis)', D.PRODUCT_AXES)} THEN CASE WHEN own >= 3 AND places = 0 THEN 28 ELSE 0 END WHEN own >= 2 AND places = 0 THEN 12 ELSE 0 END
    - CASE WHEN places >= n * 0.95 THEN 90 WHEN places >= n * 0.66 THEN 70 WHEN places >= n * 0.4 THEN 36 ELSE 0 END - CASE WHEN own < 2 THEN 18 ELSE 0 END - 18 * wholes - CASE WHEN n > 12 THEN 10 ELSE 0 END AS score,
    periods, CASE WHEN own BETWEEN 2 AND 8 THEN 1 ELSE 0 END AS fits, own, weight FROM stat JOIN sums USING (company_id, axis)),
  picked AS (SELECT company_id, arg_max(axis, (score, periods, fits, own, weight, axis)) AS axis FROM score_t GROUP BY company_id)"""


@query("g4_pick_axis", "SELECT s.company_id, s.axis, s.score::BIGINT AS score, s.own::BIGINT AS own, p.axis IS NOT NULL AS picked FROM score_t s LEFT JOIN picked p USING (company_id, axis)", SCORED)
def g4(t):
    at = D.marked_axes(revenue_facts(t).select("company_id", "dims", "end_date", "concept_priority"))
    return at.select("company_id", "axis", F.col("score").cast("long").alias("score"), F.col("own").cast("long").alias("own"), "picked")


_SPAN, _LAG = "(end_date - start_date + 1)", "(filing_date - end_date)"
_QUAL = f"""(concept_priority, CASE WHEN {_SPAN} BETWEEN 45 AND 120 THEN CASE WHEN form IN ('10-Q', '6-K') THEN 3 WHEN form IN ('10-K', '20-F', '40-F') THEN 2 ELSE 1 END ELSE CASE WHEN form IN ('10-K', '20-F', '40-F') THEN 3 WHEN form IN ('10-Q', '6-K') THEN 2 ELSE 1 END END,
  CASE WHEN {_LAG} < -2 THEN 0 WHEN {_LAG} <= 220 THEN 5 WHEN {_LAG} <= 450 THEN 4 WHEN {_LAG} <= 720 THEN 3 ELSE 2 END,
  CASE WHEN {_LAG} < -2 THEN -9999 WHEN {_LAG} <= 220 THEN -abs({_LAG} - 45) WHEN {_LAG} <= 450 THEN -abs({_LAG} - 120) WHEN {_LAG} <= 720 THEN -abs({_LAG} - 240) ELSE -abs({_LAG} - 360) END, -abs({_SPAN} - 91), filing_date)"""
RANKED = f"{SCORED}, axis_facts AS (SELECT c.*, {_QUAL} AS quality FROM chosen c JOIN picked USING (company_id, axis))"


def on_axis(t, *columns):
    """Facts of the picked axis; columns: those that are read besides what ranks a fact."""
    return D.facts_on_axis(revenue_facts(t).select("company_id", "dims", "concept", "concept_priority", "start_date", "end_date", "form", "filing_date", *columns))


@query("g5_segment_quality", "SELECT fact_id, dense_rank() OVER (PARTITION BY company_id, member, end_date ORDER BY quality DESC) AS place FROM axis_facts", RANKED)
def g5(t):
    from pyspark.sql import Window

    w = Window.partitionBy("company_id", "member", "end_date").orderBy(D.segment_quality().desc())
    return on_axis(t, "fact_id").select("fact_id", F.dense_rank().over(w).alias("place"))


DEDUPED = f"{RANKED}, deduped AS (SELECT * FROM axis_facts QUALIFY row_number() OVER (PARTITION BY company_id, member, start_date, end_date, concept ORDER BY quality DESC, value DESC) = 1)"


@query("g6_dedupe_segment_facts", "SELECT company_id, member, start_date, end_date, concept, form, value FROM deduped", DEDUPED, dates="start_date end_date", money="value")
def g6(t):
    return D.dedupe_segment_facts(on_axis(t, "value")).select("company_id", "member", "start_date", "end_date", "concept", "form", "value")


_SPLIT = f"""{DEDUPED}, split AS (SELECT * FROM (SELECT *, CASE WHEN {_SPAN} BETWEEN 45 AND 120 THEN 'direct' WHEN {_SPAN} BETWEEN 121 AND 390 THEN 'cumulative' END AS span_kind FROM deduped) WHERE span_kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY company_id, member, span_kind, end_date ORDER BY quality DESC, concept DESC, value DESC) = 1)"""
_ROUND = """d{n} AS (SELECT company_id, member, start_date, end_date, value, derived FROM d{m} UNION ALL
  SELECT c.company_id, c.member, CAST(max(e.end_date) + 1 AS DATE), c.end_date, any_value(c.value) - sum(e.value), true FROM split c JOIN d{m} e ON e.company_id = c.company_id AND e.member = c.member AND e.start_date >= c.start_date AND e.end_date < c.end_date
  WHERE c.span_kind = 'cumulative' AND round((c.end_date - c.start_date + 1) / 91.0) = {n} AND NOT EXISTS (SELECT 1 FROM d{m} x WHERE x.company_id = c.company_id AND x.member = c.member AND x.end_date = c.end_date)
  GROUP BY c.company_id, c.member, c.start_date, c.end_date HAVING count(*) = {n} - 1)"""
SERIES = f"{_SPLIT}, d1 AS (SELECT company_id, member, start_date, end_date, value, false AS derived FROM split WHERE span_kind = 'direct'), " + ", ".join(_ROUND.format(n=k, m=k - 1) for k in (2, 3, 4))


@query("g8_segment_series", "SELECT company_id, member, concat(year(end_date), 'Q', quarter(end_date)) AS quarter, value, derived FROM d4", SERIES, money="value")
def g8(t):
    return D.segment_series(D.dedupe_segment_facts(on_axis(t, "value")))


HIERARCHY = (
    {"member_key": "core", "name": "Core", "filters": {"StatementBusinessSegmentsAxis": ("STANDARDMember", "MEDIUMMember")}, "aggregate": True},
    {"member_key": "promo", "name": "Promo", "filters": {"StatementBusinessSegmentsAxis": ("PROMOMember",)}, "exact": ("StatementBusinessSegmentsAxis",)},
    {"member_key": "brands", "name": "Brands", "filters": {"ProductOrServiceAxis": tuple(f"Brand{i}Member" for i in range(1, 13))}, "exact": ("ProductOrServiceAxis",), "aggregate": True},
)


@query("g13_match_hierarchy", f"""SELECT company_id, concept, start_date, end_date, member_key, name, value FROM (
  SELECT company_id, concept, start_date, end_date, 'core' AS member_key, 'Core' AS name, sum(value) AS value FROM dim_facts WHERE regexp_matches(dims, 'StatementBusinessSegmentsAxis=co:(STANDARD|MEDIUM)Member') AND NOT contains(dims, 'StatementBusinessSegmentsAxis=us-gaap') GROUP BY ALL
  UNION ALL SELECT company_id, concept, start_date, end_date, 'promo', 'Promo', value FROM dim_facts WHERE regexp_matches(dims, '^[a-z-]+:StatementBusinessSegmentsAxis=co:PROMOMember$')
  UNION ALL SELECT company_id, concept, start_date, end_date, 'brands', 'Brands', sum(value) FROM dim_facts WHERE regexp_matches(dims, '^[a-z]+:ProductOrServiceAxis=co:Brand([1-9]|1[0-2])Member$') GROUP BY ALL)""", dates="start_date end_date", money="value")  # fmt: skip
def g13(t):
    return D.match_hierarchy(facts(t), HIERARCHY)


ALLOWED = {"StatementBusinessSegmentsAxis": {"SMALLMember": "Small things", "LARGEMember": "Large things"}, "ProductOrServiceAxis": {"Brand7Member": "Seventh"}}
_ALLOW = " ".join(f"WHEN '{a}|{m}' THEN '{n}'" for a, ms in ALLOWED.items() for m, n in ms.items())


@query("g14_label_allowlist", f"SELECT fact_id, axis, member, name FROM (SELECT *, CASE concat(axis, '|', member) {_ALLOW} END AS name FROM chosen) WHERE name IS NOT NULL", CHOSEN)
def g14(t):
    return D.label_allowlist(chosen(t), ALLOWED).select("fact_id", "axis", "member", "name")


# Quarters of a year as records: some are given alone, some as a year-to-date record, some members are missing in places.
RECORDS = """records AS (SELECT company_id, q_index, 1 AS span, member_key, CAST(value AS DECIMAL(24,3)) AS value FROM segments WHERE (company_id + q_index) % 3 <> 0 AND NOT (member_key = 'PROMO' AND q_index % 8 = 1)
  UNION ALL SELECT company_id, q_index, n, member_key, CAST(v AS DECIMAL(24,3)) FROM (SELECT company_id, q_index, CAST(q_index % 4 + 1 AS INT) AS n, member_key, sum(value) OVER (PARTITION BY company_id, member_key, floor(q_index / 4) ORDER BY q_index) AS v FROM segments) x WHERE n > 1 AND (company_id + q_index) % 3 = 0)"""
_FOLD = """m{n} AS (SELECT * FROM m{m} UNION ALL SELECT company_id, q_index, member_key, value - before, true FROM (SELECT *, bool_and(n = {n} - 1) OVER (PARTITION BY company_id, q_index) AS whole FROM (
    SELECT r.company_id, r.q_index, r.member_key, r.value, sum(h.value) AS before, count(h.value) AS n FROM records r LEFT JOIN m{m} h ON h.company_id = r.company_id AND h.member_key = r.member_key AND h.q_index < r.q_index AND h.q_index > r.q_index - {n}
    WHERE r.span = {n} AND NOT EXISTS (SELECT 1 FROM m{m} x WHERE x.company_id = r.company_id AND x.q_index = r.q_index AND x.member_key = r.member_key) GROUP BY ALL)) WHERE whole)"""
FOLDED = f"{RECORDS}, m1 AS (SELECT company_id, q_index, member_key, value, false AS derived FROM records WHERE span = 1), " + ", ".join(_FOLD.format(n=k, m=k - 1) for k in (2, 3, 4))


@query("g15_derive_member_quarters", "SELECT * FROM m4", FOLDED, money="value")
def g15(t):
    return D.derive_member_quarters(t.sql("SELECT *, 0 AS ord FROM records", RECORDS))


TOTALS = """records AS (SELECT company_id, q_index, 1 AS span, 'total' AS member_key, CAST(revenue AS DECIMAL(24,3)) AS value FROM quarters WHERE (company_id + q_index) % 3 <> 0
  UNION ALL SELECT * FROM (SELECT company_id, q_index, CAST(q_index % 4 + 1 AS INT) AS n, 'total', CAST(sum(revenue) OVER (PARTITION BY company_id, y ORDER BY q_index) AS DECIMAL(24,3)) FROM quarters) x WHERE n > 1)"""


@query("g16_derive_display_revenue", "SELECT company_id, q_index, value, derived FROM m4 WHERE value > 0", TOTALS + ", m1 AS (SELECT company_id, q_index, member_key, value, false AS derived FROM records WHERE span = 1), " + ", ".join(_FOLD.format(n=k, m=k - 1) for k in (2, 3, 4)), money="value")
def g16(t):
    return D.derive_display_revenue(t.sql("SELECT * FROM records", TOTALS))


@query("g17_fallback_structure", "SELECT company_id, q_index, member_key, value FROM segments WHERE value > 20000 QUALIFY count(*) OVER (PARTITION BY company_id, q_index) >= 2", money="value")
def g17(t):
    return D.fallback_structure(t.segments, 20000).select("company_id", "q_index", "member_key", "value")


@query("g18_first_available", "SELECT company_id, q_index, member_key, value, CASE WHEN company_id % 3 = 0 THEN 0 WHEN company_id % 2 = 0 THEN 1 ELSE 2 END AS source_rank FROM segments WHERE CASE WHEN company_id % 3 = 0 THEN true WHEN company_id % 2 = 0 THEN q_index % 2 = 0 ELSE true END", money="value")
def g18(t):
    s = t.segments.select("company_id", "q_index", "member_key", "value")
    return D.first_available([s.where("company_id % 3 = 0"), s.where("company_id % 2 = 0 and q_index % 2 = 0"), s])
