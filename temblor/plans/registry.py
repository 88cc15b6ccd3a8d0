"""All queries of the quake engine and, where SQL can express them, their SQL."""

from __future__ import annotations

from temblor.plans import basic, cluster_queries, signal_queries, stream_queries  # noqa: F401

QUERIES, ORACLE = basic.QUERIES, basic.ORACLE
