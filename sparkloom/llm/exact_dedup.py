"""Exact deduplication by sorting content.

Normalised texts are range-partitioned with Spark's sampled splitters, each
partition is sorted externally, so equal texts are neighbours, and each row is
compared in full with the one before it. The first row of a run has the
smallest identifier and stays.

The range key is (first 32 characters, hash of the whole text, salt), so what
the splitter sample sends to the driver doesn't grow with the length of texts;
the sort inside a partition has the whole text. Texts with very many copies are
found beforehand by counting hashes. Only they get salts, one for SALT_ROWS of
their copies, so a run has about as many rows however large the table; the heads
of salted runs, one for each, meet in a second, small aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, shuffle_partitions

#: A text has salts if it has this many copies at least, and is among the HOT_KEYS most frequent; one for SALT_ROWS copies, 64 at least.
HOT_ROWS, HOT_KEYS = 256, 100_000
SALT_ROWS = 10_000


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256, and the columns named in carry.

    The carried columns take part in the sort, so no join has to find them again;
    if the text is one of them it goes as it is and is normalised on either side.

    Nulls in the text count as empty. A null id sorts after all others, and is
    keep_id only where the whole group has no id. Of repeated rows with the same
    id and text exactly one is kept. Texts of any length are compared whole. Other
    columns are not read, whatever their names; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    others = [F.col(c).alias(f"_c_{c}") for c in carry]
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_n"), *others)
    keyed = base.select("_id", "_n", F.substring("_n", 1, 32).alias("_p"), F.xxhash64("_n").alias("_h"), *[f"_c_{c}" for c in carry])
    # HOT_KEYS rows of 16 bytes at most; a text that isn't among them has fewer copies than one in HOT_KEYS of all rows, or than HOT_ROWS.
    counted = keyed.groupBy(F.col("_h").alias("_hot")).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") >= HOT_ROWS)
    most = materialize(counted.orderBy(F.col("_copies").desc(), "_hot").limit(HOT_KEYS), "hot-texts")
    hot = F.broadcast(most) if most.count() else None
    # By id, and by place for rows that repeat one; each small before they add up, for sums that overflow are errors.
    salts = F.greatest(F.lit(64), F.ceil(F.col("_copies") / SALT_ROWS)).cast("bigint")
    salt = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.pmod(F.xxhash64("_id"), salts) + F.pmod(F.monotonically_increasing_id(), salts), salts))

    def salted_rows(rows: DataFrame) -> DataFrame:
        if hot is None:
            return rows.withColumn("_s", F.lit(0).cast("bigint")).withColumn("_is_hot", F.lit(False))
        return rows.join(hot, F.col("_h") == F.col("_hot"), "left").withColumn("_s", salt.cast("bigint")).withColumn("_is_hot", F.col("_copies").isNotNull()).drop("_hot", "_copies")

    salted = salted_rows(keyed)
    ranged = salted.repartitionByRange(shuffle_partitions(spark), "_p", "_h", "_s")

    if text_col in carry:
        ranged = salted_rows(keyed.drop("_n")).repartitionByRange(shuffle_partitions(spark), "_p", "_h", "_s").withColumn("_n", normalised(F.col(f"_c_{text_col}")))
    kept_columns = [f"_c_{c}" for c in carry]
    # _is_hot follows from the hash; as a part of the key its filter below reaches the scan.
    key = ["_p", "_h", "_s", "_is_hot"]
    by_content = Window.partitionBy(*key).orderBy(F.col("_n"), F.col("_id").asc_nulls_last())
    runs = (
        ranged.withColumn("_q", F.row_number().over(by_content))
        .withColumn("_new", F.when(F.lag("_n").over(by_content) == F.col("_n"), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(by_content))
    )
    digests = runs.select("_id", *key, "_q", "_run", F.sha2(F.encode("_n", "UTF-8"), 256).alias("_d"), *kept_columns)
    in_run = Window.partitionBy(*key, "_run").orderBy("_q")
    whole = in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = digests.select("_id", *key, "_d", F.first("_id").over(whole).alias("_k"), F.count(F.lit(1)).over(whole).alias("_c"), F.row_number().over(in_run).alias("_r"), *kept_columns)
    if hot is not None:
        heads = local.where(F.col("_is_hot") & (F.col("_r") == 1))
        # A row for each hot text: HOT_KEYS at most, and few more for hashes that texts share.
        first = F.min(F.struct(F.col("_k").isNull().alias("z"), F.col("_k").alias("k"), F.col("_s").alias("s")))
        joined = heads.groupBy(F.col("_h").alias("_hh"), F.col("_d").alias("_dd")).agg(first.alias("_f"), F.sum("_c").alias("_cc"))
        local = local.join(F.broadcast(joined), (F.col("_h") == F.col("_hh")) & (F.col("_d") == F.col("_dd")), "left").select(
            "_id",
            "_d",
            F.when(F.col("_cc").isNull(), F.col("_k")).otherwise(F.col("_f.k")).alias("_k"),
            F.coalesce("_cc", "_c").alias("_c"),
            F.when(F.col("_cc").isNull() | (F.col("_s") == F.col("_f.s")), F.col("_r")).otherwise(2).alias("_r"),
            *kept_columns,
        )
    return local.select(F.col("_id").alias(id_col), F.col("_k").alias("keep_id"), F.col("_c").cast("long").alias("group_size"), (F.col("_r") == 1).alias("kept"), F.col("_d").alias("text_sha256"), *[F.col(f"_c_{c}").alias(c) for c in carry if c != id_col])
