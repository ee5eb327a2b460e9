"""N-gram Jaccard join (op10) against all pairs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import jaccard, queries
from odd_rows import texts  # noqa: F401 (fixtures)

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id, text -> per row (class, copies, links, group)."""
    texts = sorted({t for _, t in rows if t is not None})
    sets = [shingles(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1:])
    linked = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a, b in linked:
        links[a] += 1
        links[b] += 1
        root[find(a)] = find(b)
    number = {t: i for i, t in enumerate(texts)}
    least, group, copies = {}, {}, Counter(t for _, t in rows)
    for d, t in rows:
        if t is not None and d is not None:
            least[t] = min(d, least.get(t, d))
            g = find(number[t])
            group[g] = min(d, group.get(g, d))
    return [(d, least.get(t), copies[t], links[number[t]], group.get(find(number[t]))) if t is not None
            else (d, d, 1, 0, d) for d, t in rows]


def same(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cid string")
    got = [(r["doc_id"], r["class_id"], r["n_copies"], r["n_links"], r["group_id"])
           for r in jaccard.join(df, **options).collect()]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= jaccard.TARGET_RECALL
    assert 1 - (1 - 0.8 ** rows) ** (bands - 1) < jaccard.TARGET_RECALL


def test_op10_matches_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.op10_jaccard_join(spark, SF).collect()}
    assert got == set(brute(rows))


def near_copies(n, words=120, changes=8, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 500, words)]
    out = []
    for k in range(n):
        w = list(base)
        for i in rng.integers(0, words, rng.integers(0, changes)):
            w[i] = f"v{rng.integers(0, 500)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block_rows", [256, 16])
def test_a_large_group_of_near_copies_in_blocks(spark, block_rows):
    rows = [(i, t) for i, t in enumerate(near_copies(120))] + [(1000 + i, t) for i, t in
                                                               enumerate(near_copies(30, seed=9) * 2)]
    same(spark, rows, block_rows=block_rows)


def test_few_long_members_in_several_blocks(spark):
    rows = []
    for k in range(12):  # two members, so many shingles that they are dealt into two blocks or five
        words = [f"p{k}w{i}" for i in range(150)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1] + ["end"]))]
    for block_shingles in (200, 60):
        same(spark, rows, block_shingles=block_shingles)


def test_odd_rows(spark, texts):
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a b c"), (50, "A, b! c"), (51, "a b c"), (None, None),
                                     (52, "one"), (53, "ONE"), (54, "two three four five six"), (None, "only null id"),
                                     (55, "a b c")]
    same(spark, rows)
    df = spark.createDataFrame([(d, t, i, {"k": 1}) for i, (d, t) in enumerate(rows)],
                               "doc_id long, text string, __row int, m map<string,int>")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    want, seen = [], set()
    for (d, t), (_, c, _, _, g) in sorted(zip(rows, brute(rows)), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        name = ("t", t) if g is None else ("g", g)
        if t is None or name not in seen:
            want.append((d is None, d or 0, t or ""))
            seen.add(name)
    assert got == sorted(want)
    assert jaccard.join(df.where("false")).count() == 0 and jaccard.keep_one(df.where("false")).count() == 0
