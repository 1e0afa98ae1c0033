"""Licence scans with a positional index of rare tokens.

Templates are word sequences, each with a mandatory key phrase inside. The index
maps a word to its postings: template and place. The inverse document frequency
of each licence word comes from all files, and a template is looked up by its
rarest word only: a file is a candidate where it has that word, and nothing else
opens a template. The other postings of a candidate are then intersected by
relative position, each asking for its word at its place, and a candidate counts
if every word of the key phrase is there. Its score is the share of the template's
frequency weight that was found.

All of it is DataFrame functions; the index has a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ascii_lower, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Label, template, key phrase (part of the template).
BASE = [
    ("mit", "mit license", "mit license"),
    ("apache", "apache license", "apache license"),
    ("gpl", "general public license", "general public license"),
]
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "http www apache org licenses license 2 0", "apache org licenses license 2"),
    ("artistic", "artistic license", "artistic license"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "binary form must reproduce"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "source code must retain"),
    ("bsd", "bsd license", "bsd license"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0", "licensed under cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "isc license", "isc license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("spdx-mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released"),
    ("zlib", "zlib license", "zlib license"),
]
#: Words that are no licence words: indexed only for key phrases that have them, never looked up on their own, of the least weight.
COMMON = "a above and any by copy free in into is must notice of the this to".split()


def postings() -> list[tuple[int, str, int, bool]]:
    """Template number, word, place, whether the key phrase has it."""
    out = []
    for t, (_, text, key) in enumerate(BASE + TEMPLATES):
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        for i, w in enumerate(words):
            mandatory = at <= i < at + len(phrase)
            if mandatory or w not in COMMON:
                out.append((t, w, i, mandatory))
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, found (array of template, label, base, start, score).

    A null text is empty. Base templates are the first of the index; start counts
    words from 0 and is that of the template's first word. Texts of any length are
    scanned whole, and of a word that repeats each place counts. Repeated rows come
    out repeated, a null id stays null, other columns are not read, whatever their
    names, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    index = postings()
    labels = [label for label, _, _ in BASE + TEMPLATES]
    vocabulary = sorted({w for _, w, _, _ in index})
    tokens = docs.select(F.col(id_col).alias("_id"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("_w"))
    rare = [w for w in vocabulary if w not in COMMON]
    placed = F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.when(F.arrays_overlap("_w", F.array(*[F.lit(w) for w in rare])), F.filter(placed, lambda x: x["w"].isin(vocabulary)))
    files = materialize(tokens.select(F.monotonically_increasing_id().alias("_row"), "_id", F.size("_w").cast("long").alias("n_words"), hits.alias("_hits")), "licence-words")

    each = files.where("_hits is not null").select("_row", F.explode("_hits").alias("x")).select("_row", "x.w", "x.i")
    total = files.agg(F.count(F.lit(1))).first()[0]
    # One row per word of the vocabulary at most.
    seen = {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count_distinct("_row").alias("n")).collect()}
    idf = {w: 1 if w in COMMON else idf_of(total, seen.get(w, 0)) for w in vocabulary}
    full = {t: sum(idf[w] for u, w, _, _ in index if u == t) for t in range(len(labels))}
    needed = {t: sum(m for u, _, _, m in index if u == t) for t in range(len(labels))}
    # The first step of a search: of each template one posting, that of the rarest word of its key phrase (of equals the first).
    entry = {t: min((-idf[w], i) for u, w, i, m in index if u == t and m)[1] for t in range(len(labels))}
    rarest = spark.createDataFrame([(w, t, i) for t, w, i, _ in index if entry[t] == i], "pw string, t int, entry int")
    candidates = each.join(F.broadcast(rarest), F.col("w") == F.col("pw")).select(F.col("_row").alias("_r"), "t", (F.col("i") - F.col("entry")).alias("start"))
    # The second: the other postings of a candidate ask for their words at their places beside it.
    rows = [(t, w, i, idf[w], int(m), full[t], needed[t], labels[t], t < len(BASE)) for t, w, i, m in index]
    postings_of = spark.createDataFrame(rows, "t int, pw string, place int, idf bigint, mandatory int, full bigint, needed int, label string, base boolean")
    asked = candidates.join(F.broadcast(postings_of), "t").withColumn("at", F.col("start") + F.col("place"))
    agreed = (
        asked.join(each, (F.col("_r") == F.col("_row")) & (F.col("at") == F.col("i")) & (F.col("pw") == F.col("w")))
        .groupBy("_row", "t", "label", "base", "full", "needed", F.col("start").cast("long").alias("start"))
        .agg(F.sum("idf").alias("weight"), F.sum("mandatory").alias("got"))
        .where(F.col("got") == F.col("needed"))
    )
    # The key phrase may start later than the template, so a start can lie before the text.
    found = agreed.groupBy(F.col("_row").alias("_r2")).agg(F.sort_array(F.collect_list(F.struct("t", "label", "base", "start", (F.col("weight") / F.col("full")).alias("score")))).alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    return files.join(found, F.col("_row") == F.col("_r2"), "left").select(F.col("_id").alias(id_col), "n_words", F.coalesce("found", none).alias("found"))


def idf_of(files: int, having: int) -> int:
    """Inverse document frequency in thousandths, so that sums are exact."""
    import math

    return 1 + round(1000 * math.log((files + 1) / (having + 1)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, from find_licenses()."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    text = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))))
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return found.select(id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), text(base).alias("base_labels"), text(F.col("found")).alias("labels"), score.alias("score"))


def oracle() -> str:
    """DuckDB SQL for the digest over `documents`."""
    index = postings()
    values = ", ".join(f"({t}, '{w}', {i}, {int(m)})" for t, w, i, m in index)
    names = ", ".join(f"({t}, '{label}', {t < len(BASE)})" for t, (label, _, _) in enumerate(BASE + TEMPLATES))
    common = ", ".join(f"'{w}'" for w in COMMON)
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p(t, word, place, mandatory) AS (VALUES {values}),
        n(t, label, base) AS (VALUES {names}),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
        e AS (SELECT * FROM x WHERE word IN (SELECT word FROM p)),
        v AS (SELECT word, CASE WHEN word IN ({common}) THEN 1 ELSE 1 + round(1000 * ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT doc_id) + 1)))::BIGINT END AS idf FROM (SELECT DISTINCT word FROM p) LEFT JOIN e USING (word) GROUP BY word),
        f AS (SELECT t, sum(idf) AS total, sum(mandatory) AS needed FROM p JOIN v USING (word) GROUP BY t),
        a AS (SELECT doc_id, t, i - place AS start, sum(idf) AS weight, sum(mandatory) AS got FROM e JOIN p USING (word) JOIN v USING (word) GROUP BY ALL),
        g AS (SELECT a.*, label, base, weight::DOUBLE / total::DOUBLE AS score FROM a JOIN f USING (t) JOIN n USING (t) WHERE got = needed),
        s AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
              FROM g GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN s USING (doc_id)
    """
