"""The query catalogue: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from millrace.plans import dataset_plans, evidence_plans, fit_plans, header_plans, identity_plans, record_plans, review_plans, score_plans, shape_plans, stats_plans, text_plans  # noqa: F401  they register
from millrace.plans.spec import SPECS

__all__ = ["SPECS"]
