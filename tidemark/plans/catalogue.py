"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from tidemark.plans import analytics_queries, context_queries, evaluation_queries, explain_queries, inference_queries, model_queries, ranking_queries, selection_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
