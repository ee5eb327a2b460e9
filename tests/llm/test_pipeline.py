"""The pipeline against a brute-force version of each stage on its own input."""

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from docmill.llm import bpe, jaccard
from docmill.llm.common import written
import test_decontaminate as dec
import test_jaccard as jac
import test_line_templates as lines
import test_quality as qual
from odd_rows import texts  # noqa: F401 (fixtures)

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), "test"))
    return [d.collect() for d in docs]


def test_columns_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join",
                                         "benchmark decontamination", "byte-level BPE"]


def test_quality_stage(spark, inputs):
    before, after = inputs[:2]
    left = {r["doc_id"] for r in after}
    assert all(r in before for r in after)
    assert not any(qual.brute(r["text"])[-1] for r in after)
    gone = [r["doc_id"] for r in before if r["doc_id"] not in left and not qual.brute(r["text"])[-1]]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passing = [r["doc_id"] for r in before if not qual.brute(r["text"])[-1]]
    share = [sum(labels.get(d) == q for d in gone) / sum(labels.get(d) == q for d in passing) for q in (0, 1)]
    assert share[0] >= 0.8 and share[1] <= 0.02


def test_line_stage(inputs):
    before, after = inputs[1:3]
    want = lines.brute([(r["doc_id"], r["doc_id"], r["text"]) for r in before], 10)
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after) and after[0].__fields__ == before[0].__fields__


def test_near_duplicate_stage(inputs):
    before, after = inputs[2:4]
    groups = {}
    for d, *_, g in jac.brute([(r["doc_id"], r["text"]) for r in before]):
        groups[g] = min(d, groups.get(g, d))
    assert {r["doc_id"] for r in after} == set(groups.values()) and len(after) == len(groups) < len(before)
    texts = {r["doc_id"]: r for r in before}
    assert all(r == texts[r["doc_id"]] for r in after)


def test_decontamination_stage(spark, inputs):
    before, after = inputs[3:5]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + 13]) for _, t in items for w in [dec.words(t)] for i in range(max(1, len(w) - 12))}

    def bad(text):
        w = dec.words(text)
        hit = {p for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in grams
               for p in range(i, i + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert [r["doc_id"] for r in sorted(after)] == [r["doc_id"] for r in sorted(before) if not bad(r["text"])]
    assert len(after) < len(before)


def test_encoding_stage(inputs):
    import hashlib

    import tiktoken
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    texts = {r["doc_id"]: r["text"] for r in inputs[4]}
    assert len(inputs[5]) == len(texts)
    for r in inputs[5]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_chained_stages(spark, inputs):
    assert sorted(cp.run(spark, SF).collect()) == sorted(inputs[5])


def test_stages_take_odd_rows(spark, texts):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(i, t, [None, "en", "xx"][i % 3], None, None) for i, t in enumerate(texts)] * 2 + [(None,) * 5]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= len(data)
    for _, stage in cp.STAGES[1:-1]:
        out = stage(spark, spark.createDataFrame(rows, schema), SF)
        assert out.columns == schema.names and out.count() > 0
    assert jaccard.keep_one(spark.createDataFrame(rows, schema)).where("text is null").count() == 3
