"""Personal data (op5): base rules against the plain patterns, and what the field adds."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import pii, queries
from odd_rows import docs, texts  # noqa: F401 (fixtures)

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    odd = [int(c) for c in d[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def plain(s):
    n = lambda m: re.sub("[^0-9]", "", m.group())
    return ([("email", *m.span()) for m in EMAIL.finditer(s)]
            + [("ip", *m.span()) for m in IP.finditer(s) if all(int(p) <= 255 for p in m.group().split("."))]
            + [("card", *m.span()) for m in CARD.finditer(s) if 13 <= len(n(m)) <= 19 and luhn(n(m))]
            + [("phone", *m.span()) for m in PHONE.finditer(s) if 9 <= len(n(m)) <= 15])


@given(st.lists(st.sampled_from(["a", "b.c", "_", "@", "@x.y", ".", "-", "+", "+1", "1", "22.3", "4.5.6.7", "256",
                                 " ", "(", ")", "4111111111111111", "555 0100", "é", "\n"]), max_size=25).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_rules_equal_plain_patterns(s):
    assert pii.base_spans(s) == plain(s)


def test_long_texts_take_linear_time():
    for s in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "a@b.c_" * 30_000):
        pii.base_spans(s)
        pii.graph(s[:20_000])


def test_field_learns_and_agrees_over_distance():
    train = []
    for i in range(60):
        spans, tokens, chained, links, labels, _ = pii.graph(
            f"call +1 (555) {200 + i}-{1000 + i} or mail u{i}.x@m{i}.example.com in 19{i:02d} at 10.0.{i}.7 about {i}")
        train.append({"tokens": tokens, "chained": chained, "links": links, "labels": labels})
    field = pii.Field().fit(train)
    s = ("Mail kim.lee7@mail.example.com or +1 (988) 555-2485 today. " + "word " * 200
         + "Again 988-555-2485 and kim.lee7 in 2019.")
    (rows,) = pii._label(field, [s.encode()])[0],
    got = {(r["kind"], s[r["start"]:r["end"]], r["base"]) for r in rows[0]}
    assert ("phone", "988-555-2485", False) in got and ("email", "kim.lee7", False) in got
    assert not any("2019" in t for _, t, _ in got)
    alone = pii._label(field, [("word " * 50 + "988-555-2485 and kim.lee7 in 2019.").encode()])[0][0]
    assert alone == []


def distant(s):
    """Text of the spans that an untrained field adds to ``s``."""
    return [s[r["start"]:r["end"]] for r in pii._label(pii.Field(), [s.encode()])[0][0] if not r["base"]]


def test_every_mention_agrees_at_any_distance():
    s = "Mail kim.lee7@mail.example.com today. " + "word kim.lee7 again. " * 60
    assert distant(s) == ["kim.lee7"] * 60
    assert distant("word kim.lee7 again. " * 60) == []
    numbers = "Call +1 (988) 555-2485. " + "word 988-555-2485 again. " * 60
    assert distant(numbers) == ["988-555-2485"] * 60


def test_numbers_across_blanks_and_plain_local_parts():
    s = "Call +44 20 7946 0958 or mail kim.lee@mail.example.com. In 2019 we said 020 7946 0958, and Kim.Lee heard it."
    assert distant(s) == ["Kim.Lee", "020 7946 0958"]
    assert distant("In 2019 we said 020 7946 0958, and Kim.Lee heard it.") == []
    assert distant("Call +44 20 7946 0958. Then 7946 0958 or 2019 020 7946 0958 or 02079460958 or 7946, 0958.") \
        == ["7946 0958", "020 7946 0958", "02079460958"]


def test_messages_settle_along_a_long_chain():
    field = pii.Field()
    field.chain = 3.0 * np.eye(5)
    n = 40
    unary = np.zeros((n, 5))
    unary[0, 1] = 9.0
    want, step = [np.exp(unary[0])], np.exp(field.chain)
    for _ in range(n - 1):  # exact: nothing but the first node has evidence
        want.append(want[-1] @ step / (want[-1] @ step).sum())
    chain = np.array([[i, i + 1] for i in range(n - 1)])
    got = pii.marginals(field, unary, chain, np.zeros((0, 2)))
    assert np.allclose(got[1:], want[1:], atol=1e-3)


def test_messages_equal_exact_marginals_on_a_tree():
    rng = np.random.default_rng(5)
    field = pii.Field()
    field.chain = rng.normal(size=(5, 5))
    field.skip = field.skip / 3
    unary = rng.normal(size=(4, 5))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    joint = np.zeros((5,) * 4)
    for at in np.ndindex(joint.shape):
        joint[at] = np.exp(sum(unary[i, at[i]] for i in range(4)) + field.chain[at[0], at[1]]
                           + field.chain[at[1], at[2]] + field.skip[at[0], at[3]])
    exact = np.stack([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)]) / joint.sum()
    assert np.allclose(pii.marginals(field, unary, chain, skip), exact, atol=1e-2)


def test_op5_base_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for r in rows:
        base = sorted(plain(texts[r["doc_id"]]), key=lambda s: (order[s[0]], s[1]))
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(said) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (order[s.split(":")[0]], int(s.split(":")[1])))


def test_odd_rows(spark, docs):
    field = pii.train(docs)
    out = pii.find(docs, field)
    assert out.columns == docs.columns + ["spans"] and out.count() == docs.count()
    assert pii.find(docs.where("false"), pii.train(docs.where("false"))).count() == 0
    df = spark.createDataFrame([("mail a.b@c.de now", "x"), (None, "y"), ("é +1 555 010 0199!", "z")],
                               "text string, spans string")
    red = pii.redact(pii.find(df, pii.Field(), keep=["text"]))
    assert [r["text"] for r in red.collect()] == ["mail <email> now", None, "é <phone>!"]
