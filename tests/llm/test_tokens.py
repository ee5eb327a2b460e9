"""Token store (op1) and byte-level BPE (op4) against the public libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import bpe, queries
from docmill.llm import token_store as ts
from docmill.session import scratch_path
from odd_rows import docs, texts  # noqa: F401 (fixtures)

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def reference_bpe():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@given(st.lists(st.integers(0, 2**32 - 1), max_size=2000), st.sampled_from([2**32, 60000, 300, 200, 1]))
@settings(max_examples=60, deadline=None)
def test_block_round_trip_and_random_access(ids, below):
    ids = np.array([i % below for i in ids], dtype=np.uint32)
    block = ts.Block(ts.pack(ids))
    assert len(block) == len(ids) and (block.ids() == ids).all()
    assert [block[i] for i in range(len(ids))] == ids.tolist()
    with pytest.raises(IndexError):
        block[len(ids)]


def test_block_rank_directory_borders():
    for n in (511, 512, 513, 1024, 5000):
        ids = (np.arange(n, dtype=np.uint32) * 7919) % 70000
        block = ts.Block(ts.pack(ids))
        assert [block[i] for i in range(n)] == ids.tolist() == block.ids().tolist()


def test_word_encoder_equals_whole_text(texts, word_tokenizer):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        made = ts.WordEncoder(f.read())([t.encode() if t is not None else None for t in texts])
    for t, got in zip(texts, made):
        assert np.frombuffer(got, "<u4").tolist() == word_tokenizer.encode(t or "", add_special_tokens=False).ids


def test_op1_matches_brute_force(spark, word_tokenizer):
    want, start = {}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = word_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op1_token_store(spark, SF).collect()}
    assert got == want


def test_store_of_odd_rows_and_random_access(spark, docs, word_tokenizer):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        path = scratch_path(spark, "tokens")
        ts.write(docs, f.read(), 2, path)
    segs = ts.segments(spark, path)
    back = ts.documents_of(segs).orderBy("start").collect()
    assert len(back) == docs.count() and back[0]["doc_id"] is None
    assert [r["doc_id"] for r in back[1:]] == sorted(r["doc_id"] for r in back[1:])
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in back])
    assert [r["start"] for r in back] == [0] + np.cumsum([r["n_tokens"] for r in back])[:-1].tolist()
    ask = [0, 5, len(ids) - 1, len(ids), -1, 5, None]
    got = ts.tokens_at(segs, spark.createDataFrame([(a, "x") for a in ask], "pos long, token_at string"))
    assert sorted((str(r["pos"]), r["token"]) for r in got.collect()) == sorted(
        (str(a), int(ids[a]) if a is not None and 0 <= a < len(ids) else None) for a in ask)


def test_store_of_no_rows(spark, docs):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        path = scratch_path(spark, "tokens")
        ts.write(docs.where("false"), f.read(), 2, path)
    assert ts.documents_of(ts.segments(spark, path)).count() == 0


@given(st.lists(st.sampled_from(list("abth eing AB\n\t\r .,'01é漢🙂 \x0b\x1c") + ["'s", "'re", " \n"]),
                max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_library(encoder, reference_bpe, text):
    assert np.frombuffer(encoder(text.encode()), "<u4").tolist() == reference_bpe.encode_ordinary(text)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS)), P.PATTERN)


def test_bpe_other_vocabulary():
    import tiktoken
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN)
    for t in ("Größe straße ciónes", "über 漢字 ñandú étéééé", "aaaaaaaaaabbbbbbb"):
        assert np.frombuffer(mine(t.encode()), "<u4").tolist() == library.encode_ordinary(t)


def test_bpe_round_trip_of_odd_rows(spark, docs, reference_bpe):
    coded = bpe.encode(docs, RANKS, P.PATTERN)
    assert coded.columns == ["doc_id", "n_words", "n_tokens", "ids"]
    rows = bpe.decode(coded.join(docs.select("doc_id", "text"), "doc_id"), RANKS).collect()
    assert rows
    for r in rows:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference_bpe.encode_ordinary(r["text"] or "")
    assert bpe.encode(docs.where("false"), RANKS, P.PATTERN).count() == 0
    both = bpe.round_trip(docs, RANKS, P.PATTERN, keep=["doc_id"])
    apart = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, keep=["doc_id"]), RANKS)
    assert sorted(str(r) for r in both.collect()) == sorted(str(r) for r in apart.collect())


def test_op4_matches_brute_force(spark, reference_bpe):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, SF).collect():
        ids = reference_bpe.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_cuts_at_odd_white_space_equal_tiktoken():
    """Stretches between clean spaces are encoded alone, whatever white space is elsewhere."""
    import random
    import struct

    import public_tokenizers as P
    import tiktoken

    from docmill.llm import bpe
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN)
    decode = bpe._decoding(ranks)
    rng = random.Random(9)
    parts = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " ", "\x1c", " ", "word", "thanonti", "word,", "it's", "we'll.", "12",
             "é", "漢字", "'", "...", "dogs'", "(a)", "!?", "\r\n", "aab", "ereintzch"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20000)]
    coded = [encoder(t.encode()) for t in texts]
    for t, ids in zip(texts, coded):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(t), repr(t)
    assert decode(coded)[0].to_pylist() == [t.encode() for t in texts]
    assert decode([None, b"", None])[0].to_pylist() == [b"", b"", b""] and decode([])[0].to_pylist() == []


def test_memories_hold_no_long_text():
    from docmill.llm.common import Memory
    made = []
    memory = Memory(lambda key: made.append(key) or len(key), 10)
    assert [memory["a" * n] for n in (5, 5, 5000, 5000, 64)] == [5, 5, 5000, 5000, 64]
    assert [len(k) for k in made] == [5, 5000, 5000, 64] and max(map(len, memory)) == 64
    made_of = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS)), P.PATTERN)
    made_of(b"a word and " + b"x1" * 4000 + b" more")
    assert max(map(len, made_of.later)) <= 64
