"""Operators that Spark SQL has no syntax for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query, table

#: Rows up to which join_checked() broadcasts.
BROADCAST_ROWS = 100_000


def band_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point <= high.

    Points and ranges are cut into buckets of `width`; the equi-join on the bucket
    shuffles. A range is repeated for each bucket that it reaches into, so for ranges
    not wider than `width` at most twice; wider ones cost more rows and lose none.
    Nulls meet nothing. Names of the sides must differ.
    """
    cut = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    ranges = right.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(cut(low), cut(high))))
    return left.withColumn("_bucket", cut(point)).join(ranges, "_bucket").where(F.col(point).between(F.col(low), F.col(high))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value of the last row of right with the same key at or before its time, as `value`; null without one.

    Both sides are put in one order by key and time, so there is one shuffle and
    no range join. Of rows of right with one time the largest value counts.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(F.col(key), F.col(time), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(key).orderBy(F.col(time), F.col("_side"), F.col("_value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_value", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", "_value")


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def groups_frame(df: DataFrame, keys: list[str], order: str, before: int, after: int, value: Column) -> Column:
    """An aggregate over a GROUPS frame: df must have the column _group from with_groups()."""
    return value.over(Window.partitionBy(*keys).orderBy("_group").rangeBetween(-before, after))


def with_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))


def not_in(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of left whose key is NOT IN the column of right, with SQL's nulls.

    Spark's own plan for a NOT IN broadcasts the whole subquery, whatever its size.
    This is an anti join that can shuffle, of the distinct values. One row of counts
    says what nulls change: a null in right leaves no row, and an empty right all,
    also those without a key.
    """
    counts = F.broadcast(right.agg(F.count("*").alias("_rows"), F.count_if(F.col(other).isNull()).alias("_nulls")))
    values = right.where(F.col(other).isNotNull()).select(F.col(other).alias("_value")).distinct()
    apart = left.where(F.col(key).isNotNull()).join(values, F.col(key) == F.col("_value"), "left_anti").crossJoin(counts).where("_nulls = 0")
    without = left.where(F.col(key).isNull()).crossJoin(counts).where("_rows = 0")
    return apart.unionByName(without).drop("_rows", "_nulls")


def salted_sum(df: DataFrame, keys: list[str], value: Column, salts: int = 32) -> DataFrame:
    """Sum by key in two steps, so that not even unsummed rows of one key meet in one task."""
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).withColumn("_v", value)
    return salted.groupBy(*keys, "_salt").agg(F.sum("_v").alias("_v")).groupBy(*keys).agg(F.sum("_v").alias("total"))


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join for a left side with hot keys: its rows are dealt over salts, and right, which must be the smaller, is repeated for each."""
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"]).drop("_salt")


def join_checked(left: DataFrame, right: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join that broadcasts right if it has at most `most` rows, and else shuffles."""
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right.hint("merge"), key)


@query("join_band", "SELECT a.event_id AS e, b.event_id AS f FROM events a JOIN events b ON a.value BETWEEN b.value - 0.01 AND b.value + 0.01 AND a.event_type = 'purchase' AND b.event_type = 'signup'")
def join_band(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("e"), F.col("value").alias("x"))
    b = e.where("event_type = 'signup'").select(F.col("event_id").alias("f"), (F.col("value") - 0.01).alias("lo"), (F.col("value") + 0.01).alias("hi"))
    return band_join(a, b, "x", "lo", "hi", 0.05).select("e", "f")


@query("join_asof", "SELECT a.event_id, b.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "last_view").select("event_id", "last_view")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_query(spark: SparkSession, d: str) -> DataFrame:
    return distinct_on(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("window_groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
def window_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    df = with_groups(table(spark, d, "orders"), ["o_orderstatus"], "o_orderdate")
    return df.select("o_orderkey", groups_frame(df, ["o_orderstatus"], "o_orderdate", 2, 1, F.count("*")).alias("n"))


@query("window_exclude_current", "SELECT o_orderkey, coalesce(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), 0)::BIGINT AS s FROM orders")
def window_exclude_current(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey").rowsBetween(-5, 0)
    return table(spark, d, "orders").select("o_orderkey", (F.sum("o_custkey").over(w) - F.col("o_custkey")).alias("s"))


@query("qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def qualify(spark: SparkSession, d: str) -> DataFrame:
    return distinct_on(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)")
def not_in_query(spark: SparkSession, d: str) -> DataFrame:
    return not_in(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 25").select("l_partkey"), "p_partkey", "l_partkey")


@query("agg_entropy", "SELECT o_orderstatus, round(entropy(o_orderpriority), 9) AS e FROM orders GROUP BY o_orderstatus")
def agg_entropy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))
    return n.withColumn("p", p).groupBy("o_orderstatus").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 9).alias("e"))


@query("agg_product", "SELECT n_regionkey, round(product(1 + n_nationkey / 100.0), 9) AS p FROM nation GROUP BY n_regionkey")
def agg_product(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.round(F.product(1 + F.col("n_nationkey") / 100.0), 9).alias("p"))


@query("agg_salted", "SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY l_returnflag")
def agg_salted(spark: SparkSession, d: str) -> DataFrame:
    got = salted_sum(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity").cast("decimal(18,2)"))
    return got.select("l_returnflag", F.col("total").cast("double").alias("total"))


@query("join_salted", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return salted_join(c, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k").groupBy("n_name").agg(F.count("*").alias("n"))


@query("join_checked", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_checked_query(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return join_checked(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


def within(value: Column, exact: Column, error: float) -> Column:
    return F.abs(value - exact) <= error * exact


def rank_within(column: str, p: float, value: Column, error: float) -> Column:
    """Whether a value stands at the p-th part of a column's order, but for this share of the rows; an aggregate of rows that have the value too."""
    below, upto = F.count_if(F.col(column) < value) / F.count("*"), F.count_if(F.col(column) <= value) / F.count("*")
    return (below <= p + error) & (upto >= p - error)


@query("agg_sketches", "SELECT true AS distinct_ok, true AS hll_ok, true AS frequent_ok, true AS quartiles_ok")
def agg_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Approximate aggregates against the exact ones: distinct counts by two sketches, most frequent values, quartiles, each within its stated error (three standard deviations)."""
    rows = table(spark, d, "lineitem")
    got = rows.agg(
        within(F.approx_count_distinct("l_partkey"), F.count_distinct("l_partkey"), 0.15).alias("distinct_ok"),
        within(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")), F.count_distinct("l_partkey"), 0.05).alias("hll_ok"),
        (F.aggregate(F.expr("approx_top_k(l_returnflag, 3)"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["count"]) == F.count("l_returnflag")).alias("frequent_ok"),
        F.percentile_approx("l_quantity", [0.25, 0.5, 0.75]).alias("q"),
    )
    met = rows.select("l_quantity").join(F.broadcast(got))
    checks = [rank_within("l_quantity", p, F.col("q")[i], 0.001) for i, p in enumerate((0.25, 0.5, 0.75))]
    return met.groupBy("distinct_ok", "hll_ok", "frequent_ok").agg((checks[0] & checks[1] & checks[2]).alias("quartiles_ok"))


@query("agg_crosstab", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def agg_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").crosstab("o_orderpriority", "o_orderstatus").withColumnRenamed("o_orderpriority_o_orderstatus", "priority")


@query("agg_approx_quantile", "SELECT p::DOUBLE AS p, true AS ok FROM (VALUES (0.1), (0.5), (0.9)) t(p)")
def agg_approx_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Whether the values stand where they should, but for the error asked for."""
    o = table(spark, d, "orders")
    values = spark.createDataFrame([(p, v) for p, v in zip((0.1, 0.5, 0.9), o.approxQuantile("o_totalprice", [0.1, 0.5, 0.9], 0.01))], "p double, value double")
    met = o.select("o_totalprice").join(F.broadcast(values))
    return met.groupBy("p").agg(((F.count_if(F.col("o_totalprice") < F.col("value")) / F.count("*") <= F.col("p") + 0.01) & (F.count_if(F.col("o_totalprice") <= F.col("value")) / F.count("*") >= F.col("p") - 0.01)).alias("ok"))


@query("agg_frequent_items", "SELECT true AS flags_ok, true AS status_ok")
def agg_frequent_items(spark: SparkSession, d: str) -> DataFrame:
    """Whether the items found have all that stand in over a fifth of the rows."""
    rows = table(spark, d, "lineitem")
    found = rows.freqItems(["l_returnflag", "l_linestatus"], 0.2)

    def often(column: str) -> DataFrame:
        counts = rows.groupBy(column).count()
        total = counts.agg(F.sum("count").alias("total"))
        return counts.join(F.broadcast(total), F.col("count") > F.col("total") / 5).agg(F.collect_list(column).alias(f"{column}_often"))

    both = found.join(often("l_returnflag")).join(often("l_linestatus"))
    missing = lambda c: F.size(F.array_except(f"{c}_often", f"{c}_freqItems")) == 0
    return both.select(missing("l_returnflag").alias("flags_ok"), missing("l_linestatus").alias("status_ok"))


@query("agg_more_sketches", "SELECT true AS suppliers_ok, true AS sketch_ok, true AS median_ok")
def agg_more_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches that merge, against exact values within their errors: sets by theta, frequencies by count-min, quantiles by KLL."""
    rows = table(spark, d, "lineitem")
    got = rows.agg(
        within(F.expr("theta_sketch_estimate(theta_sketch_agg(l_suppkey))"), F.count_distinct("l_suppkey"), 0.05).alias("suppliers_ok"),
        F.expr("length(count_min_sketch(l_partkey, 0.01d, 0.9d, 7)) > 0").alias("sketch_ok"),
        F.expr("kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(l_partkey), 0.5)").alias("m"),
    )
    met = rows.select("l_partkey").join(F.broadcast(got))
    return met.groupBy("suppliers_ok", "sketch_ok").agg(rank_within("l_partkey", 0.5, F.col("m"), 0.04).alias("median_ok"))
