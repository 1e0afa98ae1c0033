"""The register of queries: a function of (spark, sf_dir) under a name, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Registers a function; oracle: DuckDB SQL over the driver's tables, none where results aren't fixed."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Registers Spark SQL over the tables, written {table}; the oracle is the same text unless another is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [t for t in TABLES if re.search(rf"\{{{t}\}}", spark_sql)]
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in names})

    query(name, oracle or re.sub(r"\{(\w+)\}", r"\1", spark_sql))(run)


def plan_nodes(df: DataFrame) -> list[str]:
    """Names of the physical operators, from the top."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+\-|*()\d]*([A-Z]\w+)", text, re.M)
