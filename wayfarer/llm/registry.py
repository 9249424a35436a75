"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    numbered = [f for name, f in vars(q).items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in numbered} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
