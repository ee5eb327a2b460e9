"""Licence scans with a generalised suffix automaton.

All templates go, word by word, into one suffix automaton (broadcast; it grows
with the templates, not the documents). Documents stream through it: at each word
the automaton yields the matching statistic, the longest stretch ending there that
occurs in any template, and its suffix states give the shorter stretches that occur
in others. A stretch of ``MIN_MATCH`` words or more that a template's place can't
prolong is an anchor of that place, so a short template inside a longer one's match
and a clause that a template repeats have their own. Anchors of a template are
chained by sparse dynamic programming: in order in text and template, gaps up to
``MAX_GAP`` words, overlaps counted once; the chain with most covered words wins,
whatever stray matches lie between. Chains that cover ``MIN_COVER`` of the template
and share no anchor become spans with its label and the covered share as score.

Words outside the templates' vocabulary end every match, so only stretches of
vocabulary words of at least ``MIN_MATCH`` words are streamed; the others can't
hold a match. Base phrases are all places where a phrase's words follow each
other.

Defined cases: NULL and empty texts have no words, labels or spans (score 0);
equal texts get equal rows; texts are scanned whole; without templates there are no
spans. Work is linear in words times template places per match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.llm.common import carried, map_text, normal_words
from docmill.llm.licence_texts import PHRASES, TEMPLATES

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.6

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(PLACE)),
          T.StructField("spans", T.ArrayType(SPAN))]


class Automaton:
    """Generalised suffix automaton over words (as small integers). ``ends[s]``:
    the (template, place) pairs where the words of state s end, of states that
    hold stretches of ``least`` words or more."""

    def __init__(self, templates: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], least
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(templates):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= least:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter words that reach it from ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:  # an earlier template has these words
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def matches(self, words: list[int]):
        """(end, length, state) of the longest stretch that ends at each word."""
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield i + 1, length, state

    def anchors(self, words: list[int], templates: list[list[int]]):
        """(template, text start, template start, length) of the stretches of
        ``least`` words or more that neither side can prolong to the right (nor, being
        the longest that end there, to the left)."""
        for end, length, state in self.matches(words):
            after = words[end] if end < len(words) else None
            seen: set[tuple[int, int]] = set()
            while length >= self.least:
                for number, place in self.ends[state] - seen:
                    template = templates[number]
                    if after is None or place + 1 >= len(template) or template[place + 1] != after:
                        yield number, end - length, place + 1 - length, length
                seen |= self.ends[state]
                state = self.link[state]
                length = self.length[state]


def best_chains(anchors: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(covered, text start, text end) of chains of (text start, template start,
    length) anchors, best first, no anchor in two.

    For each anchor in text order the best chain that ends with it; only anchors that
    end at most ``max_gap`` words before it can come right before it."""
    anchors = sorted(anchors, key=lambda a: (a[0] + a[2], a[1] + a[2], a[2]))
    covered, before, reach = [], [], []
    longest = 0
    for j, (x, y, n) in enumerate(anchors):
        best, link = n, -1
        longest = max(longest, n)
        for i in range(j - 1, -1, -1):
            u, v, m = anchors[i]
            if u + m < x - max_gap:  # ends ascend: no earlier anchor is near enough
                break
            if u + m >= x + n or v + m >= y + n or u > x or v > y or y - (v + m) > max_gap:
                continue
            gain = n - max(0, u + m - x, v + m - y)
            if gain > 0 and covered[i] + gain > best:
                best, link = covered[i] + gain, i
        covered.append(best)
        before.append(link)
        reach.append(x if link < 0 else reach[link])
    used, out = set(), []
    for j in sorted(range(len(anchors)), key=lambda j: (-covered[j], anchors[j][0] + anchors[j][2], j)):
        chain, at = [], j
        while at >= 0 and at not in used:
            chain.append(at)
            at = before[at]
        if at >= 0:  # the rest belongs to a better chain
            continue
        used.update(chain)
        out.append((covered[j], reach[j], anchors[j][0] + anchors[j][2]))
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids) + 1) for w in normal_words(t.encode())] for _, t in templates]
        self.sizes = [max(1, len(c)) for c in coded]
        self.phrases = [(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in normal_words(p.encode())), label)
                        for p, label in phrases]
        self.coded = coded
        self.automaton = Automaton(coded, MIN_MATCH)

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[dict]:
        """Covered template spans of (template, text start, template start, length) anchors."""
        by_template: dict[int, list] = {}
        for number, *anchor in found:
            by_template.setdefault(number, []).append(tuple(anchor))
        out = []
        for number, anchors in by_template.items():
            size = self.sizes[number]
            if sum(a[2] for a in anchors) < MIN_COVER * size:
                continue
            out += [{"label": self.labels[number], "start": a, "end": b, "score": covered / size}
                    for covered, a, b in best_chains(anchors, MAX_GAP) if covered >= MIN_COVER * size]
        return sorted(out, key=lambda s: (s["start"], s["end"], s["label"], s["score"]))

    def __call__(self, texts: list[bytes | None]):
        get = self.ids.get
        words = [normal_words(t) for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), dtype=np.int32, count=int(counts.sum()))
        ends = np.cumsum(counts)
        first = ends - counts
        doc = np.repeat(np.arange(len(words)), counts)
        base: list[list] = [[] for _ in texts]
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n <= 0:
                continue
            hit = doc[:n] == doc[len(phrase) - 1:]
            for k, word in enumerate(phrase):
                hit &= ids[k:n + k] == word
            for i in np.where(hit)[0].tolist():
                base[doc[i]].append({"label": label, "start": i - int(first[doc[i]])})
        found: list[list] = [[] for _ in texts]
        inside = np.zeros(len(ids) + 2, dtype=np.int8)
        inside[1:-1] = ids > 0
        starts, stops = np.where(np.diff(inside) == 1)[0], np.where(np.diff(inside) == -1)[0]
        long = stops - starts >= MIN_MATCH
        for a, b in zip(starts[long].tolist(), stops[long].tolist()):
            while a < b:  # a stretch may run over document borders
                d = int(doc[a])
                to = min(b, int(ends[d]))
                if to - a >= MIN_MATCH:
                    at = a - int(first[d])
                    found[d] += [(number, at + x, y, length) for number, x, y, length
                                 in self.automaton.anchors(ids[a:to].tolist(), self.coded)]
                a = to
        return [counts.tolist(), [sorted(b, key=lambda p: (p["start"], p["label"])) for b in base],
                [self.chains(f) if f else [] for f in found]]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
         templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``keep`` columns (default: all but those named like an output) plus
    n_words, base (label and start word of every phrase place) and spans (label,
    word range, covered share of the template)."""
    keep = carried(docs, [f.name for f in FIELDS]) if keep is None else keep
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases))
    return map_text(docs, text, FIELDS, lambda: scanner.value, keep)
