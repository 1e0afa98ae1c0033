"""File formats, a connector of this library's own, and round trips through them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.plans.registry import query, table

_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or, in local mode alone, in a folder of this process's own where that is unset; deleted at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        root = _OWN[0]
    path = f"{root.rstrip('/')}/sparkloom-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def round_trip(df: DataFrame, fmt: str, **options: str) -> DataFrame:
    """df written in a format and read again with its own schema, so nothing is inferred."""
    path = scratch(df.sparkSession, fmt)
    df.write.format(fmt).options(**options).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).options(**options).load(path)


def _nation(fmt: str, **options: str) -> None:
    query(f"source_{fmt}", "SELECT * FROM nation")(lambda spark, d: round_trip(table(spark, d, "nation"), fmt, **options))


_nation("parquet")
_nation("orc")
_nation("json")
_nation("csv", header="true")
_nation("xml", rowTag="nation")


@query("source_text", "SELECT r_name AS value FROM region")
def source_text(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(table(spark, d, "region").select(F.col("r_name").alias("value")), "text")


@query("source_binary", "SELECT 1::BIGINT AS files, sum(length(r_name) + 1)::BIGINT AS bytes FROM region")
def source_binary(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "binary")
    table(spark, d, "region").select("r_name").coalesce(1).write.text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("sink_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def sink_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned sink; the filter prunes folders."""
    path = scratch(spark, "partitioned")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path).where("o_orderstatus = 'F'")


class Numbers(DataSource):
    """Connector `numbers`: the integers below option n, in as many partitions as option partitions says."""

    @classmethod
    def name(cls) -> str:
        return "numbers"

    def schema(self) -> str:
        return "n bigint"

    def reader(self, schema) -> DataSourceReader:
        return NumbersReader(int(self.options["n"]), int(self.options.get("partitions", 2)))


class NumbersReader(DataSourceReader):
    def __init__(self, n: int, parts: int) -> None:
        self.n, self.parts = n, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition):
        k = partition.value
        for i in range(self.n * k // self.parts, self.n * (k + 1) // self.parts):
            yield (i,)


@query("source_connector", "SELECT count(*) AS n, sum(i)::BIGINT AS total FROM range(1000) t(i)")
def source_connector(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(Numbers)
    return spark.read.format("numbers").option("n", 1000).option("partitions", 4).load().agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query("scan_sample", "SELECT true AS size_ok, true AS subset_ok")
def scan_sample(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sample of a tenth has a tenth of the rows, but for five standard deviations, each of them a row of the table and none twice."""
    orders = table(spark, d, "orders").select("o_orderkey")
    sample = orders.sample(0.1, seed=7)
    sizes = sample.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("k"))
    known = sample.join(orders, "o_orderkey", "left_semi").agg(F.count("*").alias("m"))
    both = sizes.join(known).join(orders.agg(F.count("*").alias("total")))
    return both.select((F.abs(F.col("n") - 0.1 * F.col("total")) <= 5 * F.sqrt(0.09 * F.col("total"))).alias("size_ok"), ((F.col("n") == F.col("k")) & (F.col("n") == F.col("m"))).alias("subset_ok"))
