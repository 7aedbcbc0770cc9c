"""Registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, evaluation, lexical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**lexical.QUERIES, **analytics.QUERIES, **evaluation.QUERIES}
ORACLES: dict[str, str] = {**lexical.ORACLES, **analytics.ORACLES, **evaluation.ORACLES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
