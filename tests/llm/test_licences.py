"""Licence scans (op7): automaton and base places against brute force."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import licences as lic
from docmill.llm import queries
from docmill.llm.licence_texts import PHRASES, TEMPLATES
from odd_rows import docs, texts  # noqa: F401 (fixtures)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def places(text):
    w = words(text)
    return sorted((i, label) for phrase, label in PHRASES for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split())


def contains(template, part):
    return any(template[i:i + len(part)] == part for i in range(len(template) - len(part) + 1))


small = st.lists(st.integers(1, 3), max_size=8)


@given(st.lists(small, max_size=4), st.lists(st.integers(1, 4), max_size=20))
@settings(max_examples=300, deadline=None)
def test_matching_statistics(templates, text):
    auto = lic.Automaton(templates)
    got = list(auto.matches(text))
    assert [(e, n) for e, n, _ in got] == [
        (i + 1, max((n for n in range(1, i + 2) if any(contains(t, text[i + 1 - n:i + 1]) for t in templates)), default=0))
        for i in range(len(text))]
    for e, n, s in got:
        if n:
            assert auto.ends[s] == {(k, p) for k, t in enumerate(templates) for p in range(len(t))
                                    if p + 1 >= n and t[p + 1 - n:p + 1] == text[e - n:e]}


def brute_anchors(templates, text, least):
    """Matches of each template place that can't be prolonged either way."""
    out = set()
    for k, t in enumerate(templates):
        for x in range(len(text)):
            for y in range(len(t)):
                n = 0
                while x + n < len(text) and y + n < len(t) and text[x + n] == t[y + n]:
                    n += 1
                if n >= least and not (x and y and text[x - 1] == t[y - 1]):
                    out.add((k, x, y, n))
    return out


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), max_size=4), st.lists(st.integers(1, 4), max_size=25), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_anchors_are_all_maximal_matches(templates, text, least):
    got = list(lic.Automaton(templates, least).anchors(text, templates))
    assert len(got) == len(set(got)) and set(got) == brute_anchors(templates, text, least)


def exhaustive(anchors, max_gap):
    """Most covered words of any chain, by trying all."""
    def grow(last, covered):
        best = covered
        for a in anchors:
            (u, v, m), (x, y, n) = last, a
            if u + m < x + n and v + m < y + n and u <= x and v <= y and x - u - m <= max_gap and y - v - m <= max_gap:
                gain = n - max(0, u + m - x, v + m - y)
                if gain > 0:
                    best = max(best, grow(a, covered + gain))
        return best
    return max((grow(a, a[2]) for a in anchors), default=0)


@given(st.lists(st.integers(1, 3), max_size=10), st.lists(st.integers(1, 4), max_size=14), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_chains_equal_exhaustive_search(template, text, gap):
    anchors = [a[1:] for a in brute_anchors([template], text, 2)]
    chains = lic.best_chains(anchors, gap)
    assert max((c for c, *_ in chains), default=0) == exhaustive(anchors, gap)
    assert all(0 < c <= len(template) and 0 <= a < b <= len(text) for c, a, b in chains)


def test_short_template_inside_a_longer_match():
    for more in ("", ' (the "License"); you may not use this file except in compliance.'):
        _, _, spans = scan_one("Licensed under the Apache License, Version 2.0" + more)
        assert ("apache-2.0", 1.0) in [(s["label"], s["score"]) for s in spans]


def test_own_words_in_the_middle_and_edits_at_both_ends():
    for label in ("apache-2.0", "mit", "bsd", "gpl"):
        text = max((t for k, t in TEMPLATES if k == label), key=len)
        w = text.split()
        stray = " ".join(w[:len(w) // 2] + w[:6] + w[len(w) // 2:])
        _, _, spans = scan_one(stray)
        assert max(s["score"] for s in spans if s["label"] == label) > 0.9, label
    bsd = [t for k, t in TEMPLATES if k == "bsd"][0]
    edited = bsd.replace("source and binary", "sourced and binary", 1).replace("materials provided", "goods provided")
    _, _, spans = scan_one(edited)
    assert max(s["score"] for s in spans if s["label"] == "bsd") > 0.9


def test_two_copies_are_two_spans_and_no_templates_none():
    text = TEMPLATES[-1][1]
    _, _, spans = scan_one(f"{text} {'x ' * 40} {text}")
    assert [s["score"] for s in spans] == [1.0, 1.0] and spans[0]["end"] < spans[1]["start"]
    n, base, spans = [x[0] for x in lic.Scanner(templates=[])([b"all rights reserved"])]
    assert (n, spans) == (3, []) and [p["label"] for p in base] == ["reserved"]


def scan_one(text):
    return [x[0] for x in lic.Scanner()([text.encode()])]


def test_templates_notices_and_broken_copies():
    for label, text in TEMPLATES:
        n, _, spans = scan_one("Some words before. " + text + " And words after it.")
        assert any(s["label"] == label and s["score"] == 1.0 for s in spans), label
    long = max((t for k, t in TEMPLATES if k == "mit"), key=len)
    broken = long.replace("sublicense", "hire out").replace("Software is furnished", "Product is furnished")
    _, _, spans = scan_one("x " * 500 + broken + " y" * 500)
    mit = [s for s in spans if s["label"] == "mit"]
    assert mit and all(0.8 < s["score"] < 1 and s["start"] >= 500 for s in mit)
    assert scan_one("the rights of the people and the law of the land are not subject to this")[2] == []


def test_op7_base_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_licences(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        at = places(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (len(words(texts[r["doc_id"]])), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_odd_rows(spark, docs):
    out = lic.scan(docs)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "n_words", "base", "spans"]
    assert out.count() == docs.count() and lic.scan(docs.where("false")).count() == 0
    df = spark.createDataFrame([("CC-BY all rights\nreserved All Rights Reserved cc by", "x"), (None, None)],
                               "text string, SPANS string")
    a, b = lic.scan(df).collect()
    assert [(p["start"], p["label"]) for p in a["base"]] == places(df.first()["text"]) and a["n_words"] == 10
    assert (b["n_words"], b["base"], b["spans"]) == (0, [], [])
