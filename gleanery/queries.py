"""The registry of named queries."""

from __future__ import annotations

from gleanery.plans import analytics, clinical, context, evaluation, extraction, fusion, layout, relational, reranking, retrieval, shaping, streams, texts  # noqa: F401
from gleanery.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
