"""User-defined functions of each kind. Built-in functions come first; these show the ways out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query, table

ROT = "SELECT n_nationkey, upper(n_name) || '!' AS x FROM nation"


@query("udf_scalar_arrow", ROT)
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(lambda s: s.upper() + "!", "string", useArrow=True)
    return table(spark, d, "nation").select("n_nationkey", f("n_name").alias("x"))


@query("udf_pandas", "SELECT o_orderkey, o_totalprice * 2 + o_custkey AS x FROM orders")
def udf_pandas(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return a * 2 + b

    return table(spark, d, "orders").select("o_orderkey", f("o_totalprice", "o_custkey").alias("x"))


@query("udf_arrow", "SELECT o_orderkey, o_custkey + 1 AS x FROM orders")
def udf_arrow(spark: SparkSession, d: str) -> DataFrame:
    @F.arrow_udf("bigint")
    def f(a: pa.Array) -> pa.Array:
        return pc.add(a, 1)

    return table(spark, d, "orders").select("o_orderkey", f("o_custkey").alias("x"))


@query("udaf_pandas", "SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority")
def udaf_pandas(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return table(spark, d, "orders").groupBy("o_orderpriority").agg(spread("o_totalprice").alias("spread"))


@query("udtf", "SELECT n_nationkey, unnest(range(n_regionkey))::INT AS i FROM nation")
def udtf(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="i int")
    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("upto", Upto)
    return spark.sql("SELECT n_nationkey, i FROM {nation}, LATERAL upto(n_regionkey)", nation=table(spark, d, "nation"))


@query("map_in_pandas", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
def map_in_pandas(spark: SparkSession, d: str) -> DataFrame:
    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.loc[p["o_totalprice"] > 250000, ["o_orderkey"]]

    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").mapInPandas(f, "o_orderkey bigint")


@query("map_in_arrow", "SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0")
def map_in_arrow(spark: SparkSession, d: str) -> DataFrame:
    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            yield p.filter(pc.equal(pc.bit_wise_and(p.column("o_custkey"), 1), 0)).select(["o_orderkey"])

    return table(spark, d, "orders").select("o_orderkey", "o_custkey").mapInArrow(f, "o_orderkey bigint")


@query("apply_in_pandas", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events")
def apply_in_pandas(spark: SparkSession, d: str) -> DataFrame:
    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts", "event_id"])
        return p.assign(nth=range(1, len(p) + 1))[["user_id", "event_id", "nth"]]

    return table(spark, d, "events").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(f, "user_id bigint, event_id bigint, nth bigint")


@query("cogroup", "SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
def cogroup(spark: SparkSession, d: str) -> DataFrame:
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r_regionkey": a["r_regionkey"], "n": len(b)})

    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.groupBy("r_regionkey").cogroup(n.groupBy("n_regionkey")).applyInPandas(f, "r_regionkey int, n bigint")


@query("sql_function", "SELECT n_nationkey, n_regionkey * 10 + 1 AS x FROM nation")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ten_and_one(x INT) RETURNS INT RETURN x * 10 + 1")
    return spark.sql("SELECT n_nationkey, ten_and_one(n_regionkey) AS x FROM {nation}", nation=table(spark, d, "nation"))


@query("scalar_api", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def scalar_api(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(F.col("o_totalprice") == o.agg(F.max("o_totalprice")).scalar()).select("o_orderkey")
