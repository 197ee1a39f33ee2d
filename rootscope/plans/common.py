"""A registry of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import oracle, view

DIGITS = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(x: str) -> str:
    return f"(round({x}, {DIGITS}) + 0e0)"


def query(name: str, views: list[str], sql: str | None = None, recursive: bool = False):
    """Registers f(*views) as a query; sql is its check, over the same views."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(*(view(spark, sf_dir, v) for v in views)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle(views, sql, recursive)
        return f

    return register


def case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in pairs) + f" ELSE '{otherwise}' END"
