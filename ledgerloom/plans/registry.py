"""Registry of queries: a name, a builder (spark, sf_dir) -> DataFrame, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its name; ``sql`` is the statement that gives the same rows."""

    def add(f: Builder) -> Builder:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def catalog(spark: SparkSession) -> DataFrame:
    """The registered queries: name, family, description, whether SQL stands beside it."""
    rows = [(k, k.split("_")[0], (f.__doc__ or "").split("\n")[0], k in SQL) for k, f in sorted(QUERIES.items())]
    return spark.createDataFrame(rows, "name string, family string, description string, has_sql boolean")
