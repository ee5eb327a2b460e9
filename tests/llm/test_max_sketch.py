"""Ranked lexical search (op12): brute-force scores, ties, bounds, blocks, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docmill.llm import max_sketch as ms
from odd_rows import docs, texts  # noqa: F401 (fixtures)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [w.translate(LOW) for w in WORD.findall(text or "")]


def brute(rows, items, top):
    """item -> [(score, doc_id)] best first."""
    bags = [(d, Counter(terms(t))) for d, t in rows]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = {}
    for item, text in items:
        out.setdefault(item, set()).update(terms(text))
    for item, own in out.items():
        scored = []
        for d, c, n in bags:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((s, d))
        out[item] = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
    return {k: v for k, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["score"], r["doc_id"]))
        assert len(out[r["item_id"]]) == r["rank"]
    return out


def corpus(n=700, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["École", "Straße", "漢字", "A1b"]
    p = 1 / np.arange(1, len(words) + 1)
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(70)] + [(3, "w250 w251"), (None, "w250 w251"), (n + 99, None)]
    return rows, [(int(i % 23), " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(25)] + [(77, rows[5][1]), (78, "--"), (79, None)]


def test_equals_brute_force_with_ties_and_small_sketches(spark):
    rows, items = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(5)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, 20)
    assert len(want[77]) == 20
    for width, sample, blocks in ((4, 0, 100), (64, 60, 100), (2048, 60, 7)):
        assert got(ms.rank(df, it, top=20, width=width, sample=sample, block_items=blocks)) == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    v, n = 500, 4000
    items = ms.Items(list(range(10)), [[b"%d" % t for t in rng.choice(v, 12, replace=False)] for _ in range(10)])
    size = len(items.vocabulary)
    weights = ms.Weights(n, 60 * n, rng.integers(1, n // 4, size))
    lists = [np.sort(rng.choice(size, rng.integers(0, 40), replace=False)) for _ in range(n)]
    tf = [rng.integers(1, 5, len(x)) for x in lists]
    lengths = np.full(n, 60)
    search = ms.Search(items, weights, 10)
    search.add(pa.array(np.arange(n)), lengths, pa.array([x.tolist() for x in lists], pa.list_(pa.int32())),
               pa.array([x.tolist() for x in tf], pa.list_(pa.int32())))
    for i, own in enumerate(items.terms):
        scores = [(-int(weights.impacts(np.array([60]), x[hit], c[hit]).sum()), d)
                  for d, (x, c) in enumerate(zip(lists, tf)) if (hit := np.isin(x, own)).any()]
        want = sorted(scores)[:10]
        assert [(-s, d) for s, _, d in zip(*search.best[i])] == want
    assert search.rescored < 10 * n / 3  # far from all pairs


def test_odd_rows(spark, docs, texts):
    items = spark.createDataFrame([(1, "the cat sat"), (1, "THE mat"), (None, "word"), (3, None), (4, "..."), (5, "zzzz")],
                                  "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()], 50)
    found = ms.rank(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and set(want) == {1, None}
    assert got(found) == want
    assert ms.rank(docs.where("false"), items).count() == 0 == ms.rank(docs, items.where("false")).count()
