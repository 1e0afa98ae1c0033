"""The thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ctw, decontaminate, exact_dedup, html_extract, license_scan, simhash, source_mix, suffix_dedup, toxicity, warc
from sparkloom.llm.common import table


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_covered(F.col("spans")).cast("long")
    items = F.sha2(F.encode(F.concat_ws(",", F.array_sort("items")), "UTF-8"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find_licenses(table(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    covered = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("shared").alias("n_shared_words"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_source_mix": op6_source_mix,
    "op10_html_extract": op10_html_extract,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
        h AS (SELECT doc_id, dw.m, p, item_id FROM dw JOIN iw USING (m, g)),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
        s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
    "op3_license_scan": license_scan.oracle(),
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
        FROM k
    """,
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op6_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 md5('mix' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS o
          FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
        -- the level at which sources are held: those held come first by cap / weight
        f AS (
          SELECT *, coalesce(sum(cap) OVER before, 0)::DOUBLE AS held, sum(w) OVER after AS open,
                 (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS budget
          FROM r WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        after AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        l AS (SELECT arg_min((budget - held) / open, cap / w) AS level FROM f WHERE (budget - held) / open <= cap / w),
        t AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * w THEN cap::DOUBLE ELSE level * w END AS target FROM r, l),
        q AS (
          SELECT d.doc_id, d.source, d.size, t.source_size, t.target, row_number() OVER w AS place, (sum(d.size) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS hi
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY d.source ORDER BY o, size, doc_id)),
        -- the queue: two copies of each document in order of their virtual finish
        c AS (SELECT q.*, e, (hi + e * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(e) WHERE size > 0 AND target > 0),
        z AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, e, place ROWS UNBOUNDED PRECEDING) AS upto FROM c),
        k AS (SELECT source, place, sum(greatest(0, least(size, floor((SELECT 1.5::DOUBLE * sum(source_size) FROM s)) - upto + size))) AS taken FROM z GROUP BY ALL)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
        FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.place = k.place
    """,
}
