"""Substring dedup (op2) against counting all windows."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import rlz
from docmill.llm.common import plain_words
from odd_rows import texts  # noqa: F401 (fixtures)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [list(rng.choice(vocab, k)) for k in (34, 35, 36, 60, 100, 34, 40)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts += list(rng.choice(vocab, rng.integers(0, 50)))
            if rng.random() < 0.7:
                p = passages[rng.integers(len(passages))]
                a = rng.integers(0, 4)
                parts += p[a:len(p) - rng.integers(0, 3)]
            if rng.random() < 0.1:
                parts += ["again"] * int(rng.integers(1, 90))
        texts.append(str(rng.choice([" ", "\n", " \t"])).join(parts))
    return texts + texts[:5]


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, i int, kept string")
    got = rlz.remove_repeats(df, **options).collect()
    want = brute(texts, options.get("window", rlz.WINDOW))
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["i"]], r["i"]
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages_of_all_lengths(spark, seed):
    check(spark, corpus(seed))


def test_small_windows(spark):
    check(spark, ["a b c d e f", "x a b c d y", "c d e f g", "a a a a a a a", "q a a a q", None, "", "b c d"],
          window=4, seed=2)


def test_odd_rows(spark, texts):
    check(spark, texts + texts[:3] + ["word " * 34, "word " * 35 + "end"])
    df = spark.createDataFrame([(None, "w " * 40), (None, "w " * 40), (None, None)], "doc_id long, text string")
    assert [r["n_removed"] for r in rlz.remove_repeats(df.limit(2)).collect()] == [40, 40]
    assert rlz.remove_repeats(df.where("false")).count() == 0


def greedy(texts, window, seed):
    """Greedy factors by trying every reference block at every place."""
    words = [plain_words((t or "").encode()) for t in texts]
    blocks = []
    for d, w in enumerate(words):
        found = rlz.cut_blocks([w], window, seed)
        blocks += [(d, a, w[a:a + n + window - 1]) for a, n in zip(found["at"].tolist(), found["n"].tolist())]
    out = []
    for d, w in enumerate(words):
        factors, p = [], 0
        while p < len(w):
            best = 0
            for e, at, b in blocks:
                for o in range(len(b) - window + 1):
                    if b[o:o + window] == w[p:p + window] and (e, at + o) != (d, p):
                        size = window
                        while o + size < len(b) and p + size < len(w) and b[o + size] == w[p + size]:
                            size += 1
                        best = max(best, size)
            if best:
                factors.append((p, best))
            p += best or 1
        out.append(factors)
    return words, out


@pytest.mark.parametrize("window,seed,made", [
    (6, 3, lambda: [" ".join(np.random.default_rng(s).choice(list("abcd"), 60 + s)) for s in range(12)]),
    (6, 2, lambda: ["a b c d e f g h i j k", "x b c d e f g h y", "z c d e f g h i j w", "a a a a a a a a a a a"]),
    (35, 8, lambda: corpus(3, 14))])
def test_factors_are_the_greedy_parse(spark, window, seed, made):
    """Equal to the brute-force parse, and copies from the reference give the text."""
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, want = greedy(texts, window, seed)
    source = {(r["seed"], r["block"]): r for r in rlz.reference(docs, window=window, seed=seed).collect()}
    assert any(want)
    for r in rlz.remove_repeats(docs, window=window, seed=seed).collect():
        w = words[r["doc_id"]]
        assert [(f["at"], f["n"]) for f in r["factors"]] == want[r["doc_id"]], r["doc_id"]
        for f in r["factors"]:
            ref = source[f["seed"], f["block"]]
            start = ref["anchor"] + f["shift"]
            assert words[ref["doc_id"]][start:start + f["n"]] == w[f["at"]:f["at"] + f["n"]]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_equal_windows_share_seed_and_place(docs):
    """Every window lies in one block, and equal windows have one seed and one
    place from their anchor."""
    blocks, _ = rlz.parse(docs, 6, 3)
    total = 0
    for words, rows in zip(docs, blocks.to_pylist()):
        windows = max(0, len(words) - 5)
        distinct = {tuple(words[i:i + 6]) for i in range(windows)}
        inside = {tuple(words[r["at"] + k:r["at"] + k + 6]) for r in rows for k in range(r["n"])}
        assert inside == distinct
        total += windows
    seeds = {}
    for words, rows in zip(docs, blocks.to_pylist()):
        for r in rows:
            for k in range(r["n"]):
                assert seeds.setdefault(tuple(words[r["at"] + k:r["at"] + k + 6]), r["seed"]) == r["seed"]
