"""Decontamination (op9) against a brute-force scan; the join beyond the size bound."""

import re

from docmill.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(13, len(b))
        for j in range(len(b) - n + 1 if b and item is not None else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == b[j:j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ITEMS = [(1, LONG), (2, "Short item."), (3, None), (4, ""), (5, "short ITEM"), (None, "seven eight"),
         (7, "École élémentaire"), (1, LONG)]
TEXTS = [None, "", "!!!", LONG.upper(), "x " + LONG + " y " * 400, "a short-item, short item b",
         "one two three four five six seven eight nine ten eleven twelve", "école ÉLÉMENTAIRE École élémentaire",
         LONG + " " + LONG, "short", "item short " * 50, LONG[4:] + " " + LONG]


def test_equals_brute_force_on_both_paths(spark):
    docs = spark.createDataFrame([(i, t, "x", ["y"]) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, n_words string, items array<string>")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    want = {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}
    for limits in ({}, {"max_rows": 1}):
        got = dc.contamination(docs, items, **limits).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            n, hit, found = want[r["doc_id"]]
            spans = sorted({p for a, b in r["hit_spans"] for p in range(a, b)})
            assert (r["n_words"], spans, r["items"]) == (n, hit, found), r
    kept = {r["doc_id"] for r in dc.decontaminate(docs, items).collect()}
    assert kept == {i for i, (n, hit, _) in want.items() if not (hit and 20 * len(hit) >= n)}
    assert dc.decontaminate(docs, items).columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    for limits in ({}, {"max_rows": -1}):
        row = dc.contamination(docs, items, **limits).first()
        assert (row["n_words"], row["hit_spans"], row["items"]) == (2, [], [])
    assert dc.contamination(docs.where("false"), items).count() == 0
