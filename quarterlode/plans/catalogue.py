"""All registered queries outside the corpus subpackage."""

from quarterlode.plans import box_queries, candidate_queries, corpus_queries, dimension_queries, entry_queries, fact_queries, history_queries, phase_queries, label_queries, more_queries, period_queries, row_queries, sandwich_queries, section_queries, source_queries, style_queries, subset_queries, table_queries  # noqa: F401
from quarterlode.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
