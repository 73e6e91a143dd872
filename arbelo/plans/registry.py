"""Registered queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbelo.plans import answer_queries, fact_queries, layer_queries, name_queries, stream_queries, study_queries, trial_queries

FLAGSHIP = "dossier"
_PARTS = [name_queries, fact_queries, study_queries, stream_queries, layer_queries, answer_queries, trial_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
