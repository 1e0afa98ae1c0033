import random

import pytest
from sparkloom.llm import license_scan as ls
from test_decontaminate import words

SCHEMA = "doc_id bigint, text string, _w int, w string, n_words int"


def brute(rows):
    out = []
    for i, t in rows:
        w = words(t)
        found = [(k, label) for label, _, key in ls.BASE for k in range(len(w)) if w[k : k + len(key.split())] == key.split()]
        out.append((i, len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "mit", 5) for i, t in rows], SCHEMA)
    return ls.digest(ls.find_licenses(df)).collect()


def base(got):
    return sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_base_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = "mit MIT license License apache general public gnu the in é licenſe licenses mitlicense".split()
    rows = [(i, r.choice((" ", "-", "\n")).join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(None, None), (5, ""), (6, "MIT license"), (6, "MIT license"), (7, "mit " * 100_000 + "license"), (8, "MITK license general public\x00license")]
    got = run(spark, rows)
    assert base(got) == brute(rows)
    assert all(0 <= x["score"] <= 1 and set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) for x in got)


def test_templates_need_their_key_phrase(spark):
    rows = [(i, f"some words {text} and more") for i, (_, text, _) in enumerate(ls.TEMPLATES)]
    rows += [(100 + i, " x ".join(text.split())) for i, (_, text, _) in enumerate(ls.TEMPLATES)]
    got = {r["doc_id"]: r for r in run(spark, rows)}
    for i, (label, _, _) in enumerate(ls.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] > 0.99
        assert got[100 + i]["labels"] == ""


def test_empty_table(spark):
    assert run(spark, []) == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id bigint, text string")
    plan = ls.digest(ls.find_licenses(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_the_rarest_word_opens_a_template(spark, monkeypatch):
    """With an index whose lookup finds another word at a template's entry, its phrase is found no more."""
    rows = [(1, "the mit license"), (2, "license of mit"), (3, "license"), (4, "an isc license")]
    assert [r["base_labels"] for r in sorted(run(spark, rows))] == ["mit", "", "", ""]
    real = ls.idf_of
    seen = []
    monkeypatch.setattr(ls, "idf_of", lambda files, having: seen.append(having) or real(files, having))
    run(spark, rows)
    assert max(seen) == 4 and seen.count(2) == 1  # license, mit: mit is the rarer
    postings = ls.postings()
    monkeypatch.setattr(ls, "postings", lambda: [(t, "nowhere" if (t, w) == (0, "mit") else w, i, m) for t, w, i, m in postings])
    assert {r["base_labels"] for r in run(spark, rows)} == {""}


def test_frequent_licence_words(spark):
    rows = [(1, "license " * 30_000 + "mit license"), (2, "general public " * 20_000 + "license")]
    assert base(run(spark, rows)) == brute(rows)
