"""Line dedup (op3): plans without Python, and a brute-force version."""

import re
from collections import defaultdict

import numpy as np

from docmill.llm import line_templates as lt
from docmill.llm import queries
from tests.conftest import plan_text
from odd_rows import docs, texts  # noqa: F401 (fixtures)

FIELD = re.compile("[0-9@]|://")


def brute(rows, min_docs, long_docs=lt.LONG_DOCS):
    """(key, doc_id, text) per distinct document -> text left."""
    leaves, long = defaultdict(list), defaultdict(list)
    for key, d, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            for c in "\t\x0b\x0c\r":
                line = line.replace(c, " ")
            raw = re.split(" +", line.strip(" "))
            if raw == [""]:
                continue
            at = ((d is None, d or 0), key, pos)
            w = raw if len(raw) <= lt.DEPTH else ["<*>" if FIELD.search(x) else x for x in raw]
            leaves[len(w), tuple(w[:lt.DEPTH])].append((at, w))
            if len(raw) >= lt.LONG_TOKENS or len(" ".join(raw)) >= lt.LONG_CHARS:
                long[tuple(raw)].append(at)
    groups = [(at, long_docs) for at in long.values()]
    for lines in leaves.values():
        if len({at[1] for at, _ in lines}) < min_docs:
            continue
        having = defaultdict(set)
        for at, w in lines:
            for p, x in enumerate(w[lt.DEPTH:]):
                having[p, x].add(at[1])
        shapes = defaultdict(list)
        for at, w in lines:
            tail = list(enumerate(w[lt.DEPTH:]))
            kept = tuple(x for x in tail if len(having[x]) >= min_docs)
            if len(kept) >= len(tail) * lt.SIMILARITY:
                shapes[kept].append(at)
        groups += [(at, min_docs) for at in shapes.values()]
    lost = set()
    for held, need in groups:
        if len({key for _, key, _ in held}) >= need:
            first = min(held)[1]
            lost |= {(key, pos) for _, key, pos in held if key != first}
    return {key: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (key, p) not in lost)
            for key, d, t in rows}


def corpus(n=80):
    rng = np.random.default_rng(4)
    vocab = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(100)]
    fixed = ["This page was built for you today", "Copyright notice of the site", "one two three", "a b c d",
             "same lead here but this one ends so", "same lead here but that one stops so"]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocab, rng.integers(0, 9))) for _ in range(rng.integers(0, 6))]
        lines += [f"Posted by user{rng.integers(99)} on 2020-01-{rng.integers(28)} at example.com in {rng.choice(vocab)}"]
        lines += [str(x) for x in rng.choice(fixed, rng.integers(0, 4))]
        out.append("\n".join(str(x) for x in rng.permutation(lines)))
    return out + ["", "\n", "x", out[0]]


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, t, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, same string, N_LINES string")
    for min_docs in (2, 5, 10):
        got = lt.drop_templates(df, min_docs=min_docs)
        assert got.columns == ["doc_id", "text", "same", "n_lines", "n_dropped"]
        want = brute([(i, i, t) for i, t in enumerate(texts)], min_docs)
        rows = got.collect()
        assert len(rows) == len(texts) and any(r["n_dropped"] for r in rows)
        for r in rows:
            assert r["text"] == want[r["doc_id"]] and r["same"] == texts[r["doc_id"]]
            assert r["n_lines"] == len(r["same"].split("\n"))


def test_variable_fields_and_clean_lines(spark):
    lines = [f"Page {i} of 90 was printed by {name} in the office" for i, name in enumerate(
        "ann bob carl dora emil fay gus hal ida jon kim lea".split())]
    rng = np.random.default_rng(8)
    prose = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(9)) for _ in lines]
    rows = [(i, f"{line}\n{p}") for i, (line, p) in enumerate(zip(lines, prose))]
    got = lt.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["text"] == rows[0][1]
    assert [r["text"] for r in got[1:]] == prose[1:]


def test_odd_rows(spark, docs):
    many = docs.unionByName(docs).unionByName(docs)
    got = lt.drop_templates(many, min_docs=2)
    assert got.columns == ["doc_id", "text", "n_words", "n_tokens", "ids", "n_lines", "n_dropped"]
    key = lambda r: (r["doc_id"], r["text"])
    rows = {key(r): r["text"] for r in many.collect()}
    want = brute([(k, *k) for k in rows], 2)
    out = got.collect()
    assert len(out) == many.count()
    assert {(r["doc_id"], r["text"]) for r in out} == {(k[0], v) for k, v in want.items()}
    assert all((r["text"] is None) == (r["n_lines"] == 0) for r in out)
    assert lt.drop_templates(docs.where("false")).count() == 0
    hot = spark.range(300).selectExpr("id as doc_id", "'one line for all of them\nand more' as text")
    left = [r["text"] for r in lt.drop_templates(hot).collect()]
    assert sorted(left) == [""] * 299 + ["one line for all of them\nand more"]


def test_plan_has_no_python(spark):
    plan = plan_text(queries.op3_line_templates(spark, "/root/testdata/sf0.001"))
    assert not re.search("Python|Pandas|Arrow", plan)


def left_of(spark, rows):
    got = lt.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts == brute([(d, d, t) for d, t in rows], lt.MIN_DOCS)
    return texts


def words(rng, n):
    return " ".join("".join(rng.choice(list("bcdfghklm"), 6)) for _ in range(n))


def test_short_lines_and_scripts_without_spaces(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"All rights reserved.\n{words(rng, 9)}\n\u672c\u7ad9\u4fdd\u7559\u6240\u6709\u6743\u5229\u3002\n") for i in range(60)]
    left = left_of(spark, rows)
    assert left[0] == rows[0][1] and all(left[d] == t.split("\n")[1] + "\n" for d, t in rows[1:])


def test_long_lines_recur_from_two_documents(spark):
    rng = np.random.default_rng(4)
    line = words(rng, 120)
    rows = [(i, f"{line}\n{words(rng, 12)}") for i in range(2)] + [(9, words(rng, 120)), (10, line.replace(" ", "  "))]
    left = left_of(spark, rows)
    assert left[0] == rows[0][1] and left[1] == rows[1][1].split("\n")[1] and left[10] == "" and left[9] == rows[2][1]


def test_families_don_t_hang_on_other_lines_or_doc_ids(spark):
    rng = np.random.default_rng(5)
    family = [f"Posted by user {words(rng, 2)} on our site with thanks today" for _ in range(60)]
    second = [f"Posted by user of {words(rng, 1)} the best of all shops in town" for _ in range(40)]
    other = "Posted by user " + words(rng, 8)
    for first in (0, 1000):  # the unrelated line in the least or in the last document
        rows = [(first, other)] + [(i + 1, x) for i, x in enumerate(family)] + [(200 + i, x) for i, x in enumerate(second)]
        left = left_of(spark, rows)
        assert left[first] == other and left[1] == family[0] and left[200] == second[0]
        assert all(left[i + 1] == "" for i in range(1, 60)) and all(left[200 + i] == "" for i in range(1, 40))
