"""Spelling variants (op13): brute force over all word pairs, pivots, chains, odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from docmill.llm import queries, spelling
from odd_rows import docs, texts  # noqa: F401 (fixtures)

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=97):
    n = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n):
    close = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters,size", [("ab", 260), ("abcdé", 500), ("ÿàb", 300)])
def test_dense_words_equal_all_pairs(spark, letters, size):
    rng = random.Random(size)
    n = {"".join(rng.choices(letters, k=rng.randint(5, 8))): rng.choice([3, 4, 7, 20, 100]) for _ in range(size)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert rows_of(spelling.group(df)) == grouped(n)


def test_documents_equal_brute_force(spark):
    rng = random.Random(6)
    base = ["straße", "colour", "naïveté", "grouping", "ñandúes", "élève", "abcdef", "zzzzzzz", "MiXeD", "été", "a÷b×c"]
    rows = []
    for i in range(900):
        words = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", w[at] * 2]) + w[at + 1:]
            words.append(w)
        rows.append((i if i % 50 else None, rng.choice([" ", "-", "漢", "7", " "]).join(words)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(3)
    want = counted(rows)
    assert len(want) > 60 and {k: v for k, v in counted(rows, None).items()} != want
    assert rows_of(spelling.group(spelling.word_counts(df, slip_every=97))) == grouped(want)


def test_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == grouped(counted(rows))


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(3, 6)))
        prefix = [(p, rng.randint(0, 9)) for p in places]
        got = spelling.pivots(prefix)
        want = min(a[1] + b[1] for a, b in itertools.combinations(prefix, 2) if b[0] - a[0] >= 2)
        assert sum(c for _, c in got) == want and got[1][0] - got[0][0] >= 2


def test_long_chain_and_hot_root(spark):
    chain = ["aaaaa" + "b" * i for i in range(12)]
    n = {w: 3 * 2 ** i for i, w in enumerate(chain)}
    hot = "qwertyuiop"
    n[hot] = 10 ** 6
    long = "qwert" * 9
    n |= {long[:20] + "x" + long[20:]: 9, long: 40, long[1:]: 3, long[:31]: 5, long[:32]: 6, long[:33]: 30}
    for i, c in itertools.product(range(10), "abcdefgh"):
        n[hot[:i] + c + hot[i + 1:]] = 3
    got = rows_of(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n)
    assert {r[2] for r in got if r[0] in chain} == {chain[-1]}


def test_odd_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    many = docs.unionByName(docs).unionByName(docs)
    assert rows_of(spelling.group(spelling.word_counts(many, slip_every=97))) == grouped(counted(rows * 3))
    assert spelling.group(spelling.word_counts(docs.where("false"))).count() == 0
    assert spelling.runs(None) == [] == spelling.runs(b"")
