"""SQL counterparts of the corpus queries, where SQL can express them."""

from __future__ import annotations

from tallyforge.llm.license_scan import license_scan_sql
from tallyforge.llm.row_pattern import match_rows_sql
from tallyforge.llm.vector_search import top_k_sql


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": license_scan_sql(), "op10_exact_top_k": top_k_sql(), "op13_row_pattern": match_rows_sql()}
