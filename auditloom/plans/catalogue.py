"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.plans import curation, details, evaluation, images, integrity, scalars, similarity, splitting, trees

_FAMILIES = (evaluation, integrity, splitting, similarity, scalars, curation, images, trees, details)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _FAMILIES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["gate_sweep"](spark, sf_dir)
