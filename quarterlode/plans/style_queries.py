"""Queries of styles, regrouped rows and the generic split of operating expenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import styles as S
from quarterlode.plans.registry import query

#: Members under names that the rules know, companies that they name, quarters with a style of their own or details.
KNOWN = """known AS (SELECT company_id, q_index, CASE (company_id + CASE member_key WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 WHEN 'MEDIUM' THEN 4 WHEN 'ECONOMY' THEN 5 ELSE 6 END + q_index) % 17 WHEN 0 THEN 'Ad revenue' WHEN 1 THEN 'Google Cloud' WHEN 2 THEN 'Online-stores' WHEN 3 THEN 'AWS' WHEN 4 THEN 'Auto' WHEN 5 THEN 'Services' WHEN 6 THEN 'Membership' WHEN 7 THEN 'CNBU'
      WHEN 8 THEN 'Family of Apps' WHEN 9 THEN 'Reality Labs' WHEN 10 THEN 'Club membership' WHEN 11 THEN 'Internet Services' WHEN 12 THEN 'Data processing revenues' WHEN 13 THEN 'International transaction revenues' ELSE concat('x', lower(member_key)) END AS name, CAST(value AS DECIMAL(20,2)) AS value, CASE WHEN (company_id + q_index) % 4 = 0 THEN NULL ELSE q_index % 9 - 4 END AS yoy_pct FROM segments),
  told AS (SELECT company_id, q_index, CASE company_id % 8 WHEN 0 THEN 'alphabet' WHEN 1 THEN 'amazon' WHEN 2 THEN 'tesla' WHEN 3 THEN 'xiaomi' WHEN 4 THEN 'visa' WHEN 5 THEN 'micron' WHEN 6 THEN 'alibaba' ELSE 'none' END AS company, CASE WHEN q_index % 13 = 5 THEN 'own' WHEN q_index % 13 = 6 THEN ' ' END AS style, q_index % 3 = 0 AS has_details FROM quarters)"""
_KEYED = KNOWN + """, ks AS (SELECT company_id, q_index, list(DISTINCT regexp_replace(lower(name), '[^0-9a-z]', '', 'g')) AS k FROM known GROUP BY 1, 2)"""


def _rule(rules, otherwise):
    has = lambda keys, least: f"len(list_intersect(coalesce(k, []), [{', '.join(repr(x) for x in keys)}])) >= {least}"
    whens = " ".join(f"WHEN {'true' if c is None else f'company = {c!r}'} AND {' AND '.join(has(*x) for x in clauses)} THEN '{style}'" for c, style, clauses in rules)
    return f"SELECT company_id, q_index, CASE WHEN trim(style) <> '' THEN trim(style) {whens} {otherwise} END AS style FROM told LEFT JOIN ks USING (company_id, q_index)"


LAYOUT = f"{_KEYED}, laid AS ({_rule(S.LAYOUT_RULES, chr(32).join(['WHEN has_details THEN', repr('hierarchical-detail-bridge'), 'ELSE', repr('default-replica')]))})"


def known(t):
    return t.sql("SELECT *, name AS member_key FROM known", KNOWN), t.sql("SELECT * FROM told", KNOWN)


@query("v21_company_style", _rule(S.COMPANY_RULES, ""), _KEYED)
def v21(t):
    rows, quarters = known(t)
    return S.classify_style(rows, quarters, S.rule_table(rows, S.COMPANY_RULES))


@query("v21_layout_style", "SELECT * FROM laid", LAYOUT)
def v21_layout(t):
    rows, quarters = known(t)
    return S.classify_style(rows, quarters, S.rule_table(rows, S.LAYOUT_RULES), "default-replica")


@query("v22_regroup_style", """SELECT company_id, q_index, CASE WHEN NOT coalesce(apart, false) THEN name WHEN r = 1 THEN 'membershipfee' ELSE 'netsales' END AS member_key, sum(value) AS value, CASE WHEN any_value(apart) AND any_value(r) > 1 THEN round(sum(value * yoy_pct)::DOUBLE / sum(value)::DOUBLE, 1) ELSE any_value(yoy_pct) END AS yoy_pct FROM (
  SELECT *, count(*) OVER w >= 2 AND style = 'membership-fee-bridge' AND bool_or(contains(key, 'membership')) OVER w AS apart, row_number() OVER (PARTITION BY company_id, q_index ORDER BY CASE WHEN key = 'membership' THEN 0 WHEN contains(key, 'membership') THEN 1 ELSE 2 END, value DESC, name) AS r FROM (SELECT *, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') AS key FROM known) LEFT JOIN laid USING (company_id, q_index) WINDOW w AS (PARTITION BY company_id, q_index))
  GROUP BY company_id, q_index, member_key, CASE WHEN coalesce(apart, false) AND r > 1 THEN 0 ELSE r END""", LAYOUT, money="value yoy_pct")  # fmt: skip
def v22(t):
    rows, quarters = known(t)
    styles = S.classify_style(rows, quarters, S.rule_table(rows, S.LAYOUT_RULES), "default-replica")
    return S.regroup_style(rows, styles, metrics=("yoy_pct",)).drop("name")


SPLIT = """split_ AS (SELECT company_id, q_index, CASE WHEN q_index % 5 <> 1 THEN rnd END AS rnd, CASE WHEN q_index % 7 <> 2 THEN sgna END AS sgna, CASE WHEN (company_id + q_index) % 3 = 0 THEN CAST(rnd * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(20,2)) END AS other_opex,
  CAST(CASE q_index % 6 WHEN 0 THEN revenue * CAST(0.2 AS DECIMAL(3,2)) WHEN 1 THEN revenue * CAST(0.12 AS DECIMAL(3,2)) WHEN 2 THEN revenue * CAST(0.04 AS DECIMAL(3,2)) WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE revenue * CAST(0.15 AS DECIMAL(3,2)) END AS DECIMAL(20,2)) AS operating_expenses FROM statements)"""
_ITEMS = SPLIT + """, li AS (SELECT company_id, q_index, greatest(coalesce(operating_expenses, 0), 0) AS t, unnest(['R&D', 'SG&A', 'Other OpEx']) AS name, unnest([rnd, sgna, other_opex]) AS v, unnest([1, 1, 0]) AS a FROM split_),
  ok AS (SELECT *, count(*) OVER w AS n, sum(v) OVER w AS s, max(v) OVER w AS mx, coalesce(sum(CASE WHEN a = 1 AND v <= t + 0.08 THEN v END) OVER w, 0) AS az FROM li WHERE v > 0.05 WINDOW w AS (PARTITION BY company_id, q_index)),
  way AS (SELECT *, CASE WHEN t <= 0.05 THEN 'as' WHEN mx <= t + 0.08 AND s <= t + 0.08 THEN 'fit' WHEN n = 1 THEN 'cut' WHEN az > t + 0.08 THEN 'scale' ELSE 'anchor' END AS how FROM ok)"""


@query("v7_generic_opex", """SELECT company_id, q_index, name, CASE how WHEN 'cut' THEN least(v, t)::DOUBLE WHEN 'scale' THEN round(v::DOUBLE * t::DOUBLE / az::DOUBLE, 4) ELSE v::DOUBLE END AS value FROM way WHERE how IN ('as', 'fit', 'cut') OR (a = 1 AND v <= t + 0.08)
  UNION ALL SELECT DISTINCT company_id, q_index, CASE how WHEN 'fit' THEN 'Residual OpEx' ELSE 'Other OpEx' END, (t - CASE how WHEN 'fit' THEN s ELSE az END)::DOUBLE FROM way WHERE (how = 'fit' AND t - s > 0.08) OR (how = 'anchor' AND t - az > 0.08)""", _ITEMS, money="value")  # fmt: skip
def v7(t):
    return S.generic_opex(t.sql("SELECT * FROM split_", SPLIT))
