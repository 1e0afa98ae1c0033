"""Mixing sources to target weights by weighted fair queueing.

Targets: the budget is shared by weight; a source whose share is above `repeats`
times its size is held there and the excess is shared again among the others.
Queueing: the documents of a source, in shuffled order and repeated in epochs,
get a virtual finish time: words of the source up to and with the copy, over the
source's target. All copies of all sources are range-sorted by finish time, their
words add up in that order, and the mix is truncated where they reach the total
budget; the copy that crosses it is cut. So each source takes its target but for
parts of one document each.

No source is gathered in one task: the shuffled order is a range sort by source,
hash and row, with Spark's sampled splitters, so a partition holds a part of a
source, whatever its size and however many rows share an id. Words before a
partition come from one small row for each source and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, materialize, shuffle_partitions


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """sources (source, size): adds target. The sources' weights repeat in the order of the code points of their names, null last.

    One small row per source; each pass is one aggregate over them, and each but
    the last holds at least one more weight class's sources at their limit.
    """
    spark = sources.sparkSession
    n = shuffle_partitions(spark)
    # Rank without one task: range partitions, their row counts, and the place inside a partition.
    ranged = materialize(
        sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()).withColumn("_null", F.col("source").isNull()),
        "sources",
    )
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row for each partition
    before, at = {}, 0
    for part, count in counts:
        before[part] = at
        at += count
    if not before:
        return ranged.select("source", "size", F.lit(0.0).alias("target"))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + first
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranged.select("source", "size", weight.cast("long").alias("weight")).withColumn("cap", F.lit(repeats) * F.col("size"))
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    budget = share * total
    level = 0.0
    while True:
        held = F.col("cap") <= F.lit(level) * F.col("weight")
        r = ranked.agg(F.sum(F.when(held, F.col("cap"))).alias("c"), F.sum(F.when(~held, F.col("weight"))).alias("w")).first()
        if not r["w"]:
            break
        higher = (budget - (r["c"] or 0)) / r["w"]
        if higher <= level:
            break
        level = higher
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "size", target.alias("target"))


def served_until(copies: DataFrame, budget: float) -> tuple | None:
    """copies (_f, _src, _e, _o, _part, _q, _z): the first in the queue's order that ends beyond the budget, with the words of it that the budget has room for; None if all fit.

    The queue is range-sorted and written, so that the sums of its partitions and
    the rows of one that crosses the budget are the same when they are read again.
    """
    order = [F.col("_f"), F.col("_src").asc_nulls_last(), F.col("_e"), F.col("_part"), F.col("_q")]
    n = shuffle_partitions(copies.sparkSession)
    queue = materialize(copies.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "queue")
    at, crossing = 0, None
    for part, words in sorted(tuple(r) for r in queue.groupBy("_p").agg(F.sum("_z")).collect()):  # a row for each partition
        if at + words > budget:
            crossing = part
            break
        at += words
    found = None
    if crossing is not None:
        w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ends = queue.where(F.col("_p") == crossing).withColumn("_end", F.sum("_z").over(w) + F.lit(at)).where(F.col("_end") > F.lit(budget))
        found = ends.orderBy("_end", *order).select("_f", "_src", "_e", "_part", "_q", (F.floor(F.lit(budget)).cast("long") - F.col("_end") + F.col("_z")).alias("_room")).first()
    discard(queue)
    return tuple(found) if found else None


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: the id, source, size, source_size, target, taken, finish, and the columns named in carry.

    size is the number of words; taken is the number of words that the mix
    takes, over all its repeats; finish is the virtual time at which the first
    copy ends (null for a document of no words, which takes nothing). Null is a
    source of its own. Order within a source is that of md5(seed, id, md5 of the
    text), then size; rows that tie in both are alike, and which of them is cut is
    open. Copies that finish together are served by source, epoch and order. A
    null text has size 0; a null id is shuffled as the text "null", and so is a
    null text. Texts of any length count whole. Other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(c, F.lit("null"))
    shuffled = F.md5(F.concat(F.lit(seed), text(F.col(id_col).cast("string")), F.lit(":"), text(F.md5(F.col(text_col)))))
    counted = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), word_count(F.col(text_col)).alias("_z"), shuffled.alias("_o"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    rows = materialize(counted, "counted")  # range partitions read their input twice
    # The row's place keeps rows apart that are alike, so that a partition holds a bounded part of any key.
    spread = rows.withColumn("_r", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), F.col("_src").asc_nulls_last(), "_o", "_z", "_r")
    sized = materialize(spread.withColumn("_part", F.spark_partition_id()), "sizes")
    discard(rows)
    sums = sized.groupBy("_src", "_part").agg(F.sum("_z").alias("_bz"))
    starts = sums.withColumn("_before", F.sum("_bz").over(Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select(F.col("_src").alias("_s2"), F.col("_part").alias("_p2"), F.coalesce("_before", F.lit(0)).alias("_before"))
    sources = sums.groupBy("_src").agg(F.sum("_bz").alias("size"))
    targets = with_targets(sources.select(F.col("_src").alias("source"), "size"), weights, share, repeats)
    placed = starts.join(targets, F.col("_s2").eqNullSafe(F.col("source")))
    within = Window.partitionBy("_part", "_src").orderBy("_o", "_z", "_r")
    numbered = sized.withColumn("_in", F.sum("_z").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_q", F.row_number().over(within))
    served = numbered.join(placed, F.col("_src").eqNullSafe(F.col("_s2")) & (F.col("_part") == F.col("_p2")))
    fields = ["_id", "_src", "_z", "_part", "_q", "size", "target", *[f"_c_{c}" for c in carry]]
    served = materialize(served.withColumn("_hi", F.col("_before") + F.col("_in")).select(*fields, "_hi"), "served")
    ends = lambda e: (F.col("_hi") + F.lit(e) * F.col("size")) / F.col("target")
    waiting = served.where((F.col("_z") > 0) & (F.col("target") > 0))
    copies = waiting.select("_src", "_part", "_q", "_z", F.explode(F.array(*[F.struct(F.lit(e).alias("_e"), ends(e).alias("_f")) for e in range(repeats)])).alias("x")).select("x._f", "_src", "x._e", "_part", "_q", "_z")
    # What the targets add up to: no source can give more than its repeats.
    budget = min(share, repeats) * targets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    last = served_until(copies, budget)
    discard(sized)
    taken = F.lit(0).cast("long")
    for e in range(repeats):
        if last is None:
            taken = taken + F.col("_z")
            continue
        finish, source, epoch, part, place, room = last
        kind = sized.schema["_src"].dataType
        # Whether the copy stands before the last one in the queue, or is it.
        key = lambda s: F.struct(s.isNull(), s)
        mine = F.struct(ends(e).alias("f"), key(F.col("_src")).alias("s"), F.lit(e).alias("e"), F.col("_part").alias("p"), F.col("_q").alias("q"))
        its = F.struct(F.lit(finish).alias("f"), key(F.lit(source).cast(kind)).alias("s"), F.lit(epoch).alias("e"), F.lit(part).alias("p"), F.lit(place).alias("q"))
        taken = taken + F.when(mine < its, F.col("_z")).when(mine == its, F.lit(room)).otherwise(F.lit(0))
    waits = (F.col("_z") > 0) & (F.col("target") > 0)
    return served.select(
        F.col("_id").alias(id_col),
        F.col("_src").alias(source_col),
        F.col("_z").alias("size"),
        F.col("size").cast("long").alias("source_size"),
        "target",
        F.when(waits, taken).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.when(waits, ends(0)).alias("finish"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )
