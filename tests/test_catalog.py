import random
import re
import subprocess
import sys
import time
from pathlib import Path

import __spark_entry__
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from sparkloom import catalog
from sparkloom.operators import recipes
from sparkloom.plans.registry import plan_nodes, table
from sparkloom.streaming.events import finished


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLES:
        same_rows(got, duck.sql(catalog.ORACLES[name]))
    else:
        assert got.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_llm_folders():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'sparkloom.llm' or name.startswith('sparkloom.llm.') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in __spark_entry__.queries())
assert 'revenue_by_priority' in __spark_entry__.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_plans(spark):
    assert "SortMergeJoin" in plan_nodes(recipes.join_checked(table(spark, DATA, "orders"), table(spark, DATA, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", most=3))
    assert "BroadcastHashJoin" in plan_nodes(recipes.join_checked(table(spark, DATA, "orders"), table(spark, DATA, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"))
    band = catalog.QUERIES["join_band"](spark, DATA)
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(plan_nodes(band))
    scan = catalog.QUERIES["project_prune"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in scan
    assert "PushedFilters: [IsNotNull(l_quantity)" in catalog.QUERIES["filter_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_asof_and_band_against_brute_force(spark):
    r = random.Random(3)
    left = [(k, r.choice("abc"), r.randint(0, 50)) for k in range(80)]
    right = [(r.choice("abd"), r.randint(0, 50), r.randint(0, 9)) for _ in range(60)]
    got = recipes.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "k", "t", "v").select("id", "v").collect()
    want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(0, None))[1] for i, k, t in left}
    assert {x["id"]: x["v"] for x in got} == want
    points, ranges = [(k, r.uniform(-9, 9)) for k in range(100)], [(k, lo := r.uniform(-9, 9), lo + r.uniform(0, 0.9)) for k in range(40)]
    got = recipes.band_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "q int, lo double, hi double"), "x", "lo", "hi", 1.0).select("p", "q").collect()
    assert sorted(map(tuple, got)) == sorted((p, q) for p, x in points for q, lo, hi in ranges if lo <= x <= hi)


def test_late_rows(spark, tmp_path):
    """A row later than the watermark of the batch before is dropped; one inside it counts."""
    for times in (["2024-01-01 02:00"], ["2024-01-01 01:45", "2024-01-01 00:10", "2024-01-01 06:00"], ["2024-01-01 00:15", "2024-01-01 05:45"], ["2024-01-02 00:00"]):
        spark.createDataFrame([(t,) for t in times], "t string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        time.sleep(1.1)
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in")
    df = raw.select(F.to_timestamp("value").alias("ts")).withWatermark("ts", "30 minutes")
    counts = df.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.hour("w.start").alias("h"), "n")
    # 00:10 comes in the batch after the watermark has moved to 01:30, and 00:15 after it has moved to 05:30.
    got = dict(map(tuple, finished(counts, "append").collect()))
    assert got[2] == 1 and got[1] == 1 and got[5] == 1 and got[6] == 1 and got.get(0, 0) <= 1


def test_streams_reject_what_they_cannot_keep(spark):
    from pyspark.errors import AnalysisException
    from sparkloom.streaming.events import stream

    raw = spark.readStream.schema(table(spark, DATA, "events").schema).parquet(f"{DATA}/events.parque[t]")
    for df, mode in ((stream(spark, DATA).orderBy("ts"), "append"), (raw.groupBy("event_type").count(), "append"), (stream(spark, DATA), "complete")):
        with pytest.raises(AnalysisException):
            finished(df, mode)
    with pytest.raises(AnalysisException):
        raw.withWatermark("ts", "1 hour").groupBy("ts").count()


def test_vector_dot_reads_every_embedding(spark):
    ids = {r["vec_id"] for r in table(spark, DATA, "embeddings").collect()}
    got = catalog.QUERIES["vector_dot"](spark, DATA).collect()
    assert {(r["u"], r["v"]) for r in got} == {(u, v) for u in ids if u % 20 == 0 for v in ids}


def test_whole_texts(spark):
    docs = table(spark, DATA, "documents").where("text IS NOT NULL")
    got = {r["doc_id"]: r["c"] for r in catalog.QUERIES["fn_regex"](spark, DATA).collect()}
    assert all(got[r["doc_id"]] == re.sub("[0-9]+", "#", r["text"]) for r in docs.collect())
    words = sum(len(r["text"].split(" ")) for r in table(spark, DATA, "conversations").where("text IS NOT NULL").collect())
    assert catalog.QUERIES["fn_explode"](spark, DATA).count() == words


def test_no_row_left_out(spark):
    assert catalog.QUERIES["join_natural"](spark, DATA).count() == table(spark, DATA, "documents").join(table(spark, DATA, "labels"), "doc_id").count()
    got = [r["x"] for r in catalog.QUERIES["sort_nulls_last"](spark, DATA).collect()]
    n = table(spark, DATA, "nation").where("n_regionkey = 1").count()
    assert len(got) == table(spark, DATA, "nation").count() and n and got[-n:] == [None] * n


def test_band_join_of_wide_and_empty_ranges(spark):
    from sparkloom.operators.recipes import band_join

    points = spark.createDataFrame([(1, 5.0), (2, -3.5), (3, None), (4, 10.0)], "e int, x double")
    ranges = spark.createDataFrame([(1, 0.0, 10.0), (2, -100.0, -3.5), (3, 6.0, 4.0), (4, None, 9.0), (5, 5.0, 5.0)], "f int, lo double, hi double")
    assert sorted(map(tuple, band_join(points, ranges, "x", "lo", "hi", 1.0).select("e", "f").collect())) == [(1, 1), (1, 5), (2, 2), (4, 1)]


def test_not_in_shuffles(spark):
    """The subquery isn't broadcast; Spark's own plan for NOT IN does so whatever the threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_nodes(catalog.QUERIES["not_in"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("parts", [[1, 2, 3, 3], [1, 2, None, None], []])
@pytest.mark.parametrize("lines", [[(1, 30.0), (1, 40.0), (2, 25.0), (9, 30.0)], [(1, 30.0), (None, 26.0)], [(1, 30.0), (None, 2.0), (3, None)], [(1, 3.0), (None, 3.0)], []])
def test_not_in_with_nulls(spark, tmp_path, parts, lines):
    import duckdb

    spark.createDataFrame([(p,) for p in parts], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same_rows(catalog.QUERIES["not_in"](spark, str(tmp_path)), con.sql(catalog.ORACLES["not_in"]))
