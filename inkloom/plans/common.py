"""Table access for the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


#: Tables whose texts take far longer to work on than to read.
TEXTS = {"documents": "text", "source_documents": "body", "search_results": "content", "evidence_chunks": "text"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if TEXTS.get(name) in df.columns else df


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, SQL, decorator): the decorator files a query under its name."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(statement: str = ""):
        def add(f):
            queries[f.__name__] = f
            if statement:
                sql[f.__name__] = statement
            return f

        return add

    return queries, sql, query
