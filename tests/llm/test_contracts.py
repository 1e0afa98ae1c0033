import os
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import DATA
from sparkloom.llm import common, queries

CONTRACTS = {
    "op1": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9": "doc_id bigint, fingerprint string, component_id bigint",
    "op10": "page_id bigint, url string, text string, n_chars bigint",
}


def named(op):
    return [q for q in queries.QUERIES if q.split("_")[0] == op]


def test_one_query_for_each():
    assert all(len(named(op)) == 1 for op in CONTRACTS) and len(queries.QUERIES) == len(CONTRACTS)
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("op", CONTRACTS)
def test_columns_and_rows(spark, op):
    got = queries.QUERIES[named(op)[0]](spark, DATA)
    kinds = dict(got.dtypes)
    for column in CONTRACTS[op].split(", "):
        name, kind = column.split()
        assert kinds[name] == kind
    key = CONTRACTS[op].split()[0]
    rows = spark.read.parquet(f"{DATA}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


class Session:
    """A session whose cluster names a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: "hdfs://somewhere/shared/" if key == "spark.checkpoint.dir" else default)


def test_scratch_tables(spark, tmp_path, monkeypatch):
    assert common.shared_dir(Session) == "hdfs://somewhere/shared"
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    df = common.materialize(spark.range(5).toDF("x"), "t")
    assert df.scratch_path.startswith(f"file://{tmp_path}/") and df.count() == 5
    common.discard(df)
    assert not any(p.is_dir() for p in tmp_path.iterdir())


@pytest.mark.parametrize("op", ["op3", "op8"])
def test_native_plans(spark, op):
    plan = queries.QUERIES[named(op)[0]](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_batches_are_bounded(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    common.bounded_arrow(spark, rows=100, size=1 << 20)
    try:

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

        long = spark.range(0, 50, 1, 1).select(F.repeat(F.lit("x"), 200_000))
        assert max(r["bytes"] for r in long.mapInArrow(sizes, "n bigint, bytes bigint").collect()) < 2 << 20
        assert max(r["n"] for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n bigint, bytes bigint").collect()) == 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package by its own path only, and workers start in another folder."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from sparkloom.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("op1_ctw", "op2_decontaminate", "op9_simhash", "op7_warc"):
    assert queries.QUERIES[name](spark, {DATA!r}).count() in (50, 200)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
