"""The registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import EMAIL, IPV4, SSN, count_matches
from .catalog import CATALOG, read


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social security numbers, e-mail and IPv4 addresses in documents, by language."""
    parts = (("ssn", SSN, "[0-9]-[0-9]"), ("email", EMAIL, "@"), ("ipv4", IPV4, "[0-9]\\.[0-9]"))
    counts = [F.sum(count_matches("text", pattern, holds)).alias(name) for name, pattern, holds in parts]
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), *counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
