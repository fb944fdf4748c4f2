"""Registered queries with their SQL counterparts; importing this registers all."""

from . import aggregate_queries, block_queries, evaluation_queries, loss_queries, match_queries, official_queries, pipeline_queries, prepare_queries, scalar_queries, scan_queries, sidecar_queries, source_queries, window_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
