"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import delete_path, scratch_path, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs: (u, root) for every node of an edge, root the smallest of its component.

    Kiveris et al., "Connected Components in MapReduce and Beyond": the large
    star hangs a node's larger neighbours onto its smallest one, the small star
    the smaller ones; after O(log^2 n) rounds all are stars. A node's neighbours
    are never gathered: their minimum is a partial aggregate, joined back.
    """
    spark = edges.sparkSession
    seen, old = None, None

    def written(df: DataFrame):
        path = scratch_path(spark, "edges")
        write_table(df, path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        old, (path, e) = path, written(small)
        delete_path(spark, old)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            break
        seen = now
    out = e.select("u", F.col("v").alias("root")).union(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
    out.scratch_path = path  # for discard()
    return out
