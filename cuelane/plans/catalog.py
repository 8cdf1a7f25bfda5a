"""All queries of the library and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelane.plans import q_words
from cuelane.plans.session import ship

MODULES = ["q_words", "q_intervals", "q_qc", "q_review", "q_signals", "q_text", "q_align", "q_hungarian", "q_records"]


def _all() -> list:
    return [importlib.import_module(f"cuelane.plans.{m}") for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_words.flagship(spark, sf_dir)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package sent to the executors first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for m in _all() for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _all() for k, s in m.SQL.items()}
