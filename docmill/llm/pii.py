"""Personal data by a skip-chain conditional random field.

Base spans come from fixed rules (email, ip, card, phone). The field then labels
the *candidate tokens* of a document: stretches without white space that hold a
digit or an @, or equal the part before the @ of one of the document's base
emails (any other token has label O with certainty, so it cuts the chain and
needs no variable). Digit groups between blanks that together end like a base
span are one candidate. Its potentials are

* unary: shape features of the token and its neighbours,
* chain: label pairs of adjacent candidate tokens,
* skip: label pairs of distant tokens with an equal or similar key (the last
  seven digits, or the part before the @), which makes labels agree over the
  whole document, whatever the distance: each token is joined to the base spans
  of its key, and the other tokens of a key to one shared variable.

Base spans are evidence (their tokens are clamped). Loopy sum-product message
passing runs over all documents of a slice at once, in each until its messages
settle (``MAX_ROUNDS`` only ends messages that swing for ever).
Tokens outside base spans whose marginal of a label reaches ``MIN_MARGINAL``
become added spans; base spans always stay.

The weights are fitted by pseudo-likelihood with the base spans as labels on at
most ``TRAIN_DOCS`` documents (chosen by text hash among documents with
candidates) of at most ``TRAIN_TOKENS`` candidate tokens each; tokens without a
base label that share a key with a labelled one are left out, being unlabelled
rather than negative. Everything else covers every whole text.

Defined cases: NULL and empty texts have no spans; equal texts have equal spans;
a table without candidates uses the prior weights.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import carried, map_text, quoted

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_TOKENS = 2000, 200
DAMPING, SETTLED, MAX_ROUNDS, MIN_MARGINAL = 0.5, 1e-4, 2000, 0.9
#: Prior mean of the skip potential of equal labels, and strength of the priors.
AGREE, STRENGTH = 6.0, 0.02

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
FIELDS = [T.StructField("spans", T.ArrayType(SPAN))]


# -- base rules --------------------------------------------------------------
# Each rule is the plain pattern found leftmost without overlap, in linear time:
# a match can only begin where a run of its first class begins.

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(s: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, s.find("@")
    while at >= 0:
        domain = _DOMAIN.match(s, at) if at >= end else None
        if domain:
            start = at
            while start > end and _LOCAL.match(s[start - 1]):
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                end = domain.end()
        at = s.find("@", at + 1)
    return found


def base_spans(s: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(s)] if "@" in s else []
    for m in _IP.finditer(s):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(s):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in s:
        for m in _PHONE.finditer(s):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- candidate tokens and their features -------------------------------------

_HAS = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>"
_COUNTS = (0, 2, 3, 4, 6, 8, 12, 19)
N_SHAPES, N_FEATURES = 12, 12 * 3 + 9


def shape(token: str) -> int:
    """A coarse shape: @, letters mixed with digits, or the number of digits."""
    if "@" in token:
        return 9
    digits = len(_DIGITS.sub("", token))
    if any(c.isalpha() for c in token):
        return 10
    return next((i for i, n in enumerate(_COUNTS) if digits <= n), 8)


def key(token: str) -> str | None:
    """What equal or similar tokens share."""
    if "@" in token:
        return token.split("@")[0].lower() or None
    digits = _DIGITS.sub("", token)
    if any(c.isalpha() for c in token):
        return token.lower() if len(token) >= 5 else None
    return digits[-7:] if len(digits) >= 7 else None


def features(tokens: list[str], chained: list[bool]) -> np.ndarray:
    """One 0/1 row per token: its shape, the neighbours' shapes, its marks."""
    x = np.zeros((len(tokens), N_FEATURES))
    shapes = [shape(t) for t in tokens]
    for i, t in enumerate(tokens):
        before = shapes[i - 1] if i and chained[i] else N_SHAPES - 1
        after = shapes[i + 1] if i + 1 < len(tokens) and chained[i + 1] else N_SHAPES - 1
        x[i, [shapes[i], N_SHAPES + before, 2 * N_SHAPES + after]] = 1
        marks = (t[0] == "+", "(" in t, "-" in t, "/" in t, ":" in t, t.count(".") == 3, 0 < t.count(".") < 3,
                 t.count(".") > 3, True)
        x[i, 3 * N_SHAPES:] = marks
    return x


def _span_key(s: str, kind: str, a: int, b: int) -> str | None:
    """The key of a base span's whole text, blanks included."""
    digits = "" if kind == "email" else _DIGITS.sub("", s[a:b])
    return key(s[a:b]) if kind == "email" else digits[-7:] if len(digits) >= 7 else None


def _joined(s: str, spans: list, chained: list, labels: list, numbers: dict[str, list[str]]):
    """``spans`` and ``chained`` with digit groups between blanks that end like a
    base number (``numbers``: digits by key) as one span."""
    digits = ["" if label or any(c.isalpha() or c == "@" for c in s[a:b]) else _DIGITS.sub("", s[a:b])
              for (a, b), label in zip(spans, labels)]
    firsts, floor = {}, 0
    for i, (a, _) in enumerate(spans):
        if not digits[i]:
            floor = i + 1
            continue
        if i and s[spans[i - 1][1]:a].strip(" "):
            floor = max(floor, i)
        start, whole = i, digits[i]
        while len(whole) < 7 and start > floor:
            start -= 1
            whole = digits[start] + whole
        own = numbers.get(whole[-7:], ())
        while start > floor and any(n.endswith((digits[start - 1] + whole).lstrip("0")) for n in own):
            start -= 1
            whole = digits[start] + whole
        if own and start < i:
            firsts[start], floor = i, i + 1
    out, marks, i = [], [], 0
    while i < len(spans):
        end = firsts.get(i, i)
        out.append((spans[i][0], spans[end][1]))
        marks.append(chained[i])
        i = end + 1
    return out, marks


def graph(s: str):
    """(spans, tokens, chained, skip links, base labels, base spans) of a text.
    Skip links join each token to the next with its key, and to a base span of
    each kind with its key, so their number is linear in the tokens."""
    base = base_spans(s)
    order = sorted(range(len(base)), key=lambda i: base[i][1])
    local = {s[a:b].split("@")[0].lower() for kind, a, b in base if kind == "email"}
    local = {x for x in local if len(x) >= 5}
    spans, chained = [], []
    end = -2
    for m in _TOKEN.finditer(s):
        a, b = m.span()
        has = _HAS.search(m.group())
        if not has and not local:
            continue
        while a < b and s[a] in _EDGE and s[a] != "(":
            a += 1
        while a < b and s[b - 1] in _EDGE and s[b - 1] != ")":
            b -= 1
        if not has and s[a:b].strip("()").lower() not in local:
            continue
        chained.append(m.start() == end + 1)
        end = m.end()
        spans.append((a, b))

    def labelled():
        labels, touched, i = [0] * len(spans), {}, 0
        for j in order:
            kind, a, b = base[j]
            while i and spans[i - 1][1] > a:
                i -= 1
            while i < len(spans) and spans[i][0] < b:
                if spans[i][1] > a:
                    labels[i] = labels[i] or 1 + KINDS.index(kind)
                    touched.setdefault(j, i)
                i += 1
        return labels, touched

    labels, touched = labelled()
    numbers: dict[str, list[str]] = {}
    for kind, a, b in base:
        k = _span_key(s, kind, a, b)
        if k and kind in ("card", "phone"):
            numbers.setdefault(k, []).append(_DIGITS.sub("", s[a:b]))
    if numbers:
        spans, chained = _joined(s, spans, chained, labels, numbers)
        labels, touched = labelled()
    tokens = [s[a:b] for a, b in spans]
    keys = [key(t.strip("()")) for t in tokens]
    anchors: dict[str, dict[int, int]] = {}  # by key, a token of each label
    for i, k in enumerate(keys):
        if k is not None and labels[i]:
            anchors.setdefault(k, {}).setdefault(labels[i], i)
    for j, i in touched.items():
        k = _span_key(s, *base[j])
        if k and labels[i] == 1 + KINDS.index(base[j][0]):
            anchors.setdefault(k, {}).setdefault(labels[i], i)
    last, links, linked = {}, [], set()
    for i, k in enumerate(keys):
        if k is None:
            continue
        if k in last:
            links.append((last[k], i))
            linked |= {(i, labels[last[k]]), (last[k], labels[i])}
        last[k] = i
    for i, k in enumerate(keys):
        if k in anchors and not labels[i]:
            links += [(j, i) for label, j in anchors[k].items() if (i, label) not in linked]
    return spans, tokens, chained, links, labels, base


# -- training ----------------------------------------------------------------

class Field:
    """Weights of the field: unary (features x labels), chain, skip."""

    def __init__(self):
        self.unary = np.zeros((N_FEATURES, len(KINDS) + 1))
        self.chain = np.zeros((len(KINDS) + 1,) * 2)
        self.skip = AGREE * np.eye(len(KINDS) + 1)

    def fit(self, graphs: list[dict], steps: int = 300, rate: float = 0.5) -> "Field":
        """Pseudo-likelihood ascent; the prior pulls the weights to their start."""
        if not graphs:
            return self
        labels_n = len(KINDS) + 1
        x = np.concatenate([features(g["tokens"], g["chained"]) for g in graphs])
        y = np.concatenate([g["labels"] for g in graphs]).astype(int)
        before, after = np.zeros((len(y), labels_n)), np.zeros((len(y), labels_n))
        linked = np.zeros((len(y), labels_n))
        unlabelled = np.zeros(len(y), dtype=bool)
        at, one = 0, np.eye(labels_n)
        for g in graphs:
            for i in range(1, len(g["tokens"])):
                if g["chained"][i]:
                    before[at + i], after[at + i - 1] = one[y[at + i - 1]], one[y[at + i]]
            for i, j in g["links"]:
                if (y[at + i] == 0) == (y[at + j] == 0):
                    linked[at + i] += one[y[at + j]]
                    linked[at + j] += one[y[at + i]]
                unlabelled[at + i] |= y[at + i] == 0 != y[at + j]
                unlabelled[at + j] |= y[at + j] == 0 != y[at + i]
            at += len(g["tokens"])
        x, y, before, after, linked = (v[~unlabelled] for v in (x, y, before, after, linked))
        if not len(y):
            return self
        gold = one[y]
        for _ in range(steps):
            score = x @ self.unary + before @ self.chain + after @ self.chain.T + linked @ self.skip
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            d = (gold - p) / len(y)
            self.unary += rate * (x.T @ d - STRENGTH / 100 * self.unary)
            self.chain += rate * (before.T @ d + (after.T @ d).T - STRENGTH / 100 * self.chain)
            grow = linked.T @ d
            self.skip += rate * ((grow + grow.T) / 2 - STRENGTH * (self.skip - AGREE * np.eye(labels_n)))
        return self


# -- inference ---------------------------------------------------------------

def marginals(field: Field, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray,
              doc: np.ndarray | None = None) -> np.ndarray:
    """Sum-product beliefs of settled messages; ``chain`` and ``skip`` are (n, 2)
    arrays of node pairs. Messages of a document (``doc`` by node; None: one)
    stop when none of them moves by ``SETTLED``, so that its beliefs don't depend
    on the documents beside it."""
    pairs = np.concatenate([chain, skip]).astype(int)
    log = unary.copy()
    if len(pairs):
        kinds = np.concatenate([np.zeros(len(chain), int), np.ones(len(skip), int)])
        doc = (np.zeros(len(unary), int) if doc is None else doc)[pairs[:, 0]]
        m = np.zeros((2, len(pairs), unary.shape[1]))  # to the second node, to the first
        live = np.arange(len(pairs))
        tables = np.stack([field.chain, field.skip])
        tables = np.stack([tables, tables.transpose(0, 2, 1)])
        for _ in range(MAX_ROUNDS):
            p, own = pairs[live], m[:, live]
            nodes, at = np.unique(p, return_inverse=True)
            at = at.reshape(p.shape)
            log = unary[nodes]
            np.add.at(log, at[:, 1], own[0])
            np.add.at(log, at[:, 0], own[1])
            into = np.stack([log[at[:, 0]] - own[1], log[at[:, 1]] - own[0]])[..., None] + tables[:, kinds[live]]
            top = into.max(axis=2, keepdims=True)
            new = np.log(np.exp(into - top).sum(axis=2)) + top[:, :, 0]
            new -= new.max(axis=2, keepdims=True)
            moved = np.abs(new - own).max(axis=(0, 2)) > SETTLED
            m[:, live] = DAMPING * own + (1 - DAMPING) * new
            live = live[np.isin(doc[live], doc[live[moved]])]
            if not len(live):
                break
        log = unary.copy()
        np.add.at(log, pairs[:, 1], m[0])
        np.add.at(log, pairs[:, 0], m[1])
    log = log - log.max(axis=1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(axis=1, keepdims=True)


def agreement(links: list[tuple[int, int]], labels: list[int]):
    """(evidence, groups) of skip links: (token, label) for each link of a token
    to one with a base label, and the sets of two or more tokens without one that
    links join, directly or through labelled tokens."""
    evidence, root = [], list(range(len(labels)))
    for i, j in links:
        if labels[i] and not labels[j]:
            evidence.append((j, labels[i]))
        elif labels[j] and not labels[i]:
            evidence.append((i, labels[j]))
    for i, j in links:
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    groups: dict[int, list[int]] = {}
    for i in {x for pair in links for x in pair if not labels[x]}:
        r = i
        while root[r] != r:
            r = root[r]
        groups.setdefault(r, []).append(i)
    return evidence, [sorted(g) for _, g in sorted(groups.items()) if len(g) > 1]


def _label(field: Field, texts: list[bytes | None]):
    """Spans of each text: base, and those that the field adds."""
    graphs = [graph(t.decode("utf-8")) if t and _HAS_BYTES.search(t) else None for t in texts]
    some = [g for g in graphs if g and g[1]]
    sizes = np.cumsum([0] + [len(g[1]) for g in some])
    added: dict[int, list] = {}
    if some:
        unary = np.concatenate([features(g[1], g[2]) for g in some]) @ field.unary
        labels = np.concatenate([g[4] for g in some]).astype(int)
        clamped = labels > 0
        unary[clamped] = -50.0
        unary[clamped, labels[clamped]] = 0.0
        chain = [(at + i - 1, at + i) for at, g in zip(sizes, some) for i in range(1, len(g[1])) if g[2][i]]
        doc = np.repeat(np.arange(len(some)), np.diff(sizes)).tolist()
        skip, n = [], int(sizes[-1])
        for k, (at, g) in enumerate(zip(sizes.tolist(), some)):
            evidence, groups = agreement(g[3], g[4])
            for i, label in evidence:
                unary[at + i] += field.skip[label]
            for group in groups:
                if len(group) == 2:
                    skip.append((at + group[0], at + group[1]))
                else:  # one more node, to which all are joined
                    skip += [(at + i, len(doc)) for i in group]
                    doc.append(k)
        unary = np.concatenate([unary, np.zeros((len(doc) - n, unary.shape[1]))])
        p = marginals(field, unary, np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2), np.array(doc))[:n]
        best = np.where((p.max(axis=1) >= MIN_MARGINAL) & ~clamped, p.argmax(axis=1), 0)
        for at, g in zip(sizes, some):
            spans: list[list] = []
            for i, label in enumerate(best[at:at + len(g[1])].tolist()):
                a, b = g[0][i]
                if not label or a == b:
                    continue
                # one base span may touch a token whose label another kind holds
                if any(a < y and x < b for _, x, y in g[5]):
                    continue
                if spans and g[2][i] and spans[-1][0] == label and spans[-1][3] == i - 1:
                    spans[-1][2:] = [b, i]
                else:
                    spans.append([label, a, b, i])
            added[id(g)] = spans
    out = []
    for g in graphs:
        rows = []
        if g:
            rows = [(k, a, b, True) for k, a, b in g[5]]
            rows += [(KINDS[label - 1], a, b, False) for label, a, b, _ in added.get(id(g), [])]
            rows.sort(key=lambda r: (KINDS.index(r[0]), r[1]))
        out.append([dict(zip(("kind", "start", "end", "base"), r)) for r in rows])
    return [out]


_HAS_BYTES = re.compile(rb"[0-9@]")

_GRAPH = [T.StructField("tokens", T.ArrayType(T.StringType())),
          T.StructField("chained", T.ArrayType(T.BooleanType())),
          T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType()))),
          T.StructField("labels", T.ArrayType(T.IntegerType()))]


def train(docs: DataFrame, text: str = "text", max_docs: int = TRAIN_DOCS,
          max_tokens: int = TRAIN_TOKENS) -> Field:
    """The field fitted on a bounded sample of documents with candidates."""
    def kernel(texts):
        graphs = [graph(t.decode("utf-8")) for t in texts]
        fits = [0 < len(g[1]) <= max_tokens for g in graphs]
        return [[g[i] if ok and i != 3 else [list(x) for x in g[3]] if ok else None
                 for g, ok in zip(graphs, fits)] for i in (1, 2, 3, 4)]

    body = F.col(quoted(text)).cast("string")
    some = docs.select(body.alias("t")).where("t rlike '[0-9@]'").select("t", F.xxhash64("t").alias("h"))
    # about 1.5 times the documents wanted, by hash, so that few texts meet in the sort
    share = 1.5 * max_docs / max(1, some.count())
    picked = some.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))) \
        .orderBy("h", F.length("t")).limit(max_docs)
    rows = map_text(picked, "t", _GRAPH, lambda: kernel, ["h"]).where("labels is not null").toArrow()
    graphs = rows.to_pylist()
    graphs.sort(key=lambda g: (g["h"], len(g["tokens"])))
    return Field().fit(graphs)


def find(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but one named spans) plus spans: kind, start, end (code
    points, end exclusive) and whether a base rule found it, by kind, then start."""
    keep = carried(docs, ["spans"]) if keep is None else keep
    model = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        weights = model.value
        return lambda texts: _label(weights, texts)

    return map_text(docs, text, FIELDS, make, keep)


def span_string(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (with spans) with each span in ``text`` replaced by its kind in
    angle brackets; of overlapping spans the one that starts first counts."""
    ordered = F.array_sort(F.col("spans"), lambda a, b: F.when(a["start"] < b["start"], -1)
                           .when(a["start"] > b["start"], 1).otherwise(0))
    body = F.col(quoted(text))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    made = F.aggregate(
        ordered, start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                     F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"), F.length(body))))
    return found.withColumn(text, F.when(body.isNotNull(), made))
