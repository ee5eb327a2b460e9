"""Keyword tables: equal to SQL contains, on both paths, and plans that don't grow."""

import random

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from docmill.operators import dictionary as D
from docmill.operators import generate
from docmill.plans import registry as R

SF = "/root/testdata/sf0.001"
SCHEMA = "feature_ord int, feature string, keyword string, cased boolean"


def brute(rows, needles):
    return sorted((d, n if c else n.lower(), c) for d, t in rows if t is not None for n, c in needles
                  if n and (n in t if c else n.lower() in t.lower()))


@pytest.mark.parametrize("bound", [D.MAX_KEYWORDS, 0])
def test_hits_equal_contains(spark, bound):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdeÉß 漢", k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "ABab" * 500)]
    needles = {("".join(rng.choices("abcdeÉß漢", k=rng.randint(1, 6))), rng.random() < 0.3) for _ in range(400)}
    words = [(0, "f", n, c) for n, c in needles] + [(0, "f", None, False), (0, "f", "", True), (1, "f", "ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = D.keyword_hits(df, spark.createDataFrame(words, SCHEMA), ["doc_id"], max_keywords=bound)
    want = sorted(set(brute(rows, needles | {("ab", False)})))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 1000
    assert D.keyword_hits(df, spark.createDataFrame(words, SCHEMA).where("false"), ["doc_id"], max_keywords=bound).count() == 0
    assert D.keyword_hits(df.where("false"), spark.createDataFrame(words, SCHEMA), ["doc_id"], max_keywords=bound).count() == 0


def test_features_equal_the_plan_time_dictionary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = spark.createDataFrame(D.keyword_rows(R.CORPUS_FEATURES), SCHEMA)
    want = generate.feature_rows(docs, ["doc_id"], ["text"], R.CORPUS_FEATURES)
    for bound in (D.MAX_KEYWORDS, 0):
        got = D.feature_hits(docs, words, ["doc_id"], max_keywords=bound)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_specs_need_every_keyword(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha Beta"), (3, "beta")], "doc_id long, text string")
    specs = spark.createDataFrame([(7, "alpha", False), (7, "Beta", True), (8, "BETA", None), (9, None, None)],
                                  "spec_id int, keyword string, cased boolean")
    assert sorted(map(tuple, D.spec_hits(docs, specs, ["doc_id"]).collect())) == [(1, 8), (2, 7), (2, 8), (3, 8)]


def test_many_keywords_one_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    words = sorted({w.lower() for r in rows for w in (r["text"] or "").split()} | {f"zz{i}" for i in range(100_000)})
    plans = {}
    for n in (10, len(words)):
        df = spark.createDataFrame([(i, w, w, False) for i, w in enumerate(words[-n:])], SCHEMA)
        hits = D.keyword_hits(docs, df, ["doc_id"])
        plans[n] = len(plan_text(hits))
    assert len(words) > 100_000 and abs(plans[10] - plans[len(words)]) < 200
    some = spark.createDataFrame([(w,) for w in words[::2000]], "needle string")
    want = docs.join(F.broadcast(some), F.contains(F.lower("text"), "needle")).select("doc_id", "needle").collect()
    got = hits.join(F.broadcast(some), "needle").select("doc_id", "needle").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
