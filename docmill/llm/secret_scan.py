"""Secrets by fixed rules and a battery of randomness tests.

Base spans come from three fixed rules (assign, access, hex) and always stay. The
method adds *random* spans. Candidates are the stretches of 16 or more characters
``[A-Za-z0-9+/=_-]`` (without padding and edge punctuation) that aren't all digits
and don't meet a base span. For each:

1. its encoding is inferred: the smallest of ``ENCODINGS`` that has all its
   characters;
2. the battery runs over that alphabet: chi-squared uniformity of the characters,
   runs above and below the middle of the alphabet, serial correlation of
   neighbours. Fisher's sum T of the three is small for uniform random characters
   and grows with length for language;
3. its p-value is the chance that *ordinary text* of this length, restricted to
   this alphabet, has as small a T. The law of log T by encoding and length is
   measured on windows of all the corpus' own texts (as many as fit side by side, for
   every encoding and length; equal texts count once);
4. over all distinct candidates of the corpus, false discoveries are held at
   ``FDR`` by the weighted Benjamini-Hochberg rule. A candidate's weight is the
   power that its encoding and length leave the battery, so short stretches, which
   can hardly be told from words, don't use up the allowance of the long ones.

Two narrow scans of the texts; between them only hashes of texts, (encoding, length)
sums and counts of distinct candidates by log p-value step, at most ``STEPS`` rows.

Defined cases: NULL and empty texts have no spans; repeated rows have equal spans
and a stretch counts once as a test, however often it occurs; an empty table has
no rows; an encoding and length without ordinary windows (no text in that
alphabet) adds nothing. Spans are code points, end exclusive, by start, then kind.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import SLICE_BYTES, carried, map_text, quoted, slices, small_batches, written

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Shortest candidate, allowed share of false discoveries, most windows of a text per
#: encoding and length (no bound: all that fit), windows needed for a law.
MIN_LENGTH, FDR, NULL_WINDOWS, MIN_WINDOWS = 16, 0.01, math.inf, 30
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128)
#: Log p-values are counted in steps of 1 / 50 down to exp(-STEPS / 50).
GRID, STEPS = 50, 4000
#: Cells (windows x characters or counts) of the battery's arrays at a time.
WINDOW_CELLS = 1 << 17
#: Mean and deviation of the log of a chi-squared variable with six degrees of
#: freedom: log T of uniform random characters.
RANDOM_MEAN, RANDOM_SD = 1.6159, 0.6284

_DIGIT, _UPPER, _LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {"hex": _DIGIT + b"abcdef", "upper_hex": _DIGIT + b"ABCDEF", "base32": b"234567" + _UPPER,
             "base36": _DIGIT + _LOWER, "upper_base36": _DIGIT + _UPPER, "base62": _DIGIT + _UPPER + _LOWER,
             "base64": b"+/" + _DIGIT + _UPPER + _LOWER, "base64url": b"-_" + _DIGIT + _UPPER + _LOWER,
             "mixed": b"+-/=_" + _DIGIT + _UPPER + _LOWER}
_CODE = {name: i for i, name in enumerate(ENCODINGS)}
_PLACE = {}
for _name, _alphabet in ENCODINGS.items():
    _PLACE[_name] = np.zeros(256, dtype=np.int64)
    _PLACE[_name][list(_alphabet)] = np.arange(len(_alphabet))

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
TESTED = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                       T.StructField("token", T.LongType()), T.StructField("step", T.IntegerType()),
                       T.StructField("weight", T.DoubleType())])


# -- base rules (fixed patterns of the contract) -------------------------------

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_STRETCH = re.compile(rb"[A-Za-z0-9+/=_-]{%d,}" % MIN_LENGTH)
_CLASSES = bytes(b"h"[0] if c in ENCODINGS["hex"] else b"c"[0] if c in ENCODINGS["mixed"] else 32 for c in range(256))
_ANY = bytes(b"c"[0] if c in ENCODINGS["mixed"] else 32 for c in range(256))


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, leftmost without overlap per kind."""
    out = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.translate(_CLASSES):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def candidates(text: bytes, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) in bytes of the stretches to test."""
    if b"c" * MIN_LENGTH not in text.translate(_ANY):
        return []
    out, taken, at = [], sorted((a, b) for _, a, b in base), 0
    furthest = -1  # the largest end of the base spans that start before a stretch's end
    for m in _STRETCH.finditer(text):
        token = m.group()
        start = m.start() + len(token) - len(token.lstrip(b"+-/=_"))
        token = token.strip(b"+-/=_")
        while at < len(taken) and taken[at][0] < start + len(token):
            furthest = max(furthest, taken[at][1])
            at += 1
        if len(token) >= MIN_LENGTH and furthest <= start and not token.isdigit():
            out.append((start, start + len(token)))
    return out


# -- the battery -----------------------------------------------------------------

def encoding_of(token: bytes) -> str:
    return next(name for name, alphabet in ENCODINGS.items() if not token.translate(None, alphabet))


def _log_tail(z: float) -> float:
    """Log of the upper tail of the normal law."""
    if z > 20:
        return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))
    return math.log(math.erfc(z / math.sqrt(2)) / 2)


def battery(token: bytes, encoding: str) -> float:
    """Fisher's sum over the three tests (six degrees of freedom if the characters
    are uniform and independent)."""
    k, n = len(ENCODINGS[encoding]), len(token)
    at = _PLACE[encoding][np.frombuffer(token, dtype=np.uint8)]
    counts = np.bincount(at, minlength=k)
    chi2 = k / n * float(counts @ counts) - n
    free = 2 * (k - 1) ** 2 / (2 * (k - 1) * (1 - 1 / n))  # of the scaled law with its mean and variance
    spread = 2 / (9 * free)
    z_uniform = ((chi2 / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    # unequal halves of an odd alphabet are allowed for by the share above the middle
    high = at >= (k + 1) // 2
    p = 1 - ((k + 1) // 2) / k
    change = 2 * p * (1 - p)
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (p * (1 - p) - change * change)
    z_runs = (np.count_nonzero(high[1:] != high[:-1]) - (n - 1) * change) / math.sqrt(var)
    u = (at - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    z_serial = float(u[1:] @ u[:-1]) / math.sqrt(n - 1)
    logs = _log_tail(z_uniform) + sum(min(0.0, math.log(2) + _log_tail(abs(z))) for z in (z_runs, z_serial))
    return max(-2 * logs, 1e-3)


class Ordinary:
    """Law of log T of ordinary text: mean and deviation by encoding and length."""

    def __init__(self, rows):
        cells: dict[int, list] = {}
        for code, length, n, mean, sd in rows:
            if n >= MIN_WINDOWS:
                cells.setdefault(code, []).append((math.log(length), mean, max(sd or 0.0, 0.05)))
        self.cells = {code: np.array(sorted(c)).T for code, c in cells.items()}

    def log_p_and_weight(self, encoding: str, length: int, score: float) -> tuple[float, float] | None:
        """Log p-value of a stretch's T, and the power of the tests at a 1 % level."""
        cell = self.cells.get(_CODE[encoding])
        if cell is None:
            return None
        mean, sd = (float(np.interp(math.log(length), cell[0], row)) for row in cell[1:])
        weight = 0.5 * math.erfc(-(mean - 2.3263 * sd - RANDOM_MEAN) / RANDOM_SD / math.sqrt(2))
        return _log_tail((mean - math.log(score)) / sd), max(weight, 1e-6)


@lru_cache(maxsize=None)
def _tables(encoding: str, length: int) -> tuple[np.ndarray, np.ndarray, float]:
    """For windows of one length, as :func:`battery` has it: log p of uniformity by the sum
    of the squared counts, log p of runs by the number of changes, and the factor that
    makes z of the serial products (both characters' places taken twice, less k - 1)."""
    k, n = len(ENCODINGS[encoding]), length
    free = 2 * (k - 1) ** 2 / (2 * (k - 1) * (1 - 1 / n))
    spread = 2 / (9 * free)
    uniform = [_log_tail(((max(0.0, k / n * float(s) - n) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
               for s in range(n * n + 1)]
    p = 1 - ((k + 1) // 2) / k
    change = 2 * p * (1 - p)
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (p * (1 - p) - change * change)
    runs = [min(0.0, math.log(2) + _log_tail(abs(c - (n - 1) * change) / math.sqrt(var))) for c in range(n)]
    return np.array(uniform), np.array(runs), 3 / (k * k - 1) / math.sqrt(n - 1)


#: log of the upper tail and its slope at every ``1 / _FINE`` from 0 to 20.
_FINE = 256
_TAIL = np.array([_log_tail(i / _FINE) for i in range(20 * _FINE + 1)])
_SLOPE = -np.exp(-0.5 * (np.arange(20 * _FINE + 1) / _FINE) ** 2 - 0.5 * math.log(2 * math.pi) - _TAIL) / _FINE


def _log_tails(z: np.ndarray) -> np.ndarray:
    """:func:`_log_tail` of many values from 0 on: cubics through the values and slopes of a
    fine grid, which differ from it by less than 1e-11."""
    i = np.minimum((z * _FINE).astype(np.int64), 20 * _FINE - 1)
    x = np.minimum(z * _FINE - i, 1.0)
    rise, a, b = _TAIL[i + 1] - _TAIL[i], _SLOPE[i], _SLOPE[i + 1]
    out = _TAIL[i] + x * (a + x * (3 * rise - 2 * a - b + x * (a + b - 2 * rise)))
    far = z > 20
    if far.any():
        out[far] = -z[far] * z[far] / 2 - np.log(z[far] * math.sqrt(2 * math.pi))
    return out


class Batteries:
    """:func:`battery` of many windows of one string of characters of an alphabet: changes
    and serial products are differences of running (integer) sums."""

    def __init__(self, flat: np.ndarray, encoding: str):
        self.encoding, self.k = encoding, len(ENCODINGS[encoding])
        self.at = _PLACE[encoding][flat]
        high = self.at >= (self.k + 1) // 2
        self.changes = np.r_[0, np.cumsum(high[1:] != high[:-1])]
        twice = 2 * self.at - (self.k - 1)
        self.products = np.r_[0, np.cumsum(twice[1:] * twice[:-1])]

    def logs(self, starts: np.ndarray, length: int) -> np.ndarray:
        """log T of the windows of ``length`` characters from ``starts``."""
        uniform, runs, serial = _tables(self.encoding, length)
        squares, last = np.empty(len(starts), dtype=np.int64), starts + (length - 1)
        step = max(1, WINDOW_CELLS // max(self.k, length))
        views = np.lib.stride_tricks.sliding_window_view(self.at, length)
        first = np.arange(step)[:, None] * self.k
        for a in range(0, len(starts), step):
            cells = views[starts[a:a + step]]
            cells += first[:len(cells)]
            counts = np.bincount(cells.ravel(), minlength=len(cells) * self.k).reshape(len(cells), self.k)
            np.einsum("ij,ij->i", counts, counts, out=squares[a:a + step])
        z = np.abs((self.products[last] - self.products[starts]) * serial)
        sums = uniform[squares] + runs[self.changes[last] - self.changes[starts]] \
            + np.minimum(0.0, math.log(2) + _log_tails(z))
        return np.log(np.maximum(-2 * sums, 1e-3))


_OUTSIDE = {name: bytes(set(range(256)) - set(alphabet)) for name, alphabet in ENCODINGS.items()}


def window_sums(texts: list[bytes], times: np.ndarray) -> list[tuple]:
    """(code, length, windows, sum and sum of squares of log T) over all windows that fit
    side by side into the texts, evenly spread, in every alphabet; a text that occurs
    several times counts by its share."""
    out = []
    for name in ENCODINGS:
        bodies = [t.translate(None, _OUTSIDE[name]) for t in texts]
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        if not len(sizes) or sizes.max() < min(LENGTHS):
            continue
        flat, starts = np.frombuffer(b"".join(bodies), dtype=np.uint8), np.cumsum(sizes) - sizes
        windows = []
        for length in LENGTHS:
            room = sizes - length
            n = sizes // length
            doc = np.repeat(np.arange(len(texts)), n)
            i = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            windows.append((length, starts[doc] + room[doc] * i // np.maximum(1, n[doc] - 1), 1.0 / times[doc]))
        for low in range(0, len(flat), SLICE_BYTES):  # a long text in several parts
            tests = Batteries(flat[low:low + SLICE_BYTES + max(LENGTHS)], name)
            for length, at, weight in windows:
                a, b = np.searchsorted(at, (low, low + SLICE_BYTES))
                if a < b:
                    score, w = tests.logs(at[a:b] - low, length), weight[a:b]
                    out.append((_CODE[name], length, float(w.sum()), float((w * score).sum()), float((w * score * score).sum())))
    return out


def ordinary(docs: DataFrame, text: str = "text") -> Ordinary:
    """The law measured on all texts, equal ones once: each of them has an equal share,
    so that no text is moved to meet its copies, only hashes are."""
    body = F.col(quoted(text)).cast("binary")
    hashed = docs.select(body.alias("t"), F.xxhash64(body).alias("h")).where("t is not null")
    copies = written(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    some = hashed.join(maybe_broadcast(copies), "h", "left").select("t", F.coalesce("n", F.lit(1)).alias("n"))
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            times = batch.column("n").to_numpy().astype(np.float64)
            for a, b in slices(batch.column("t")):
                rows = window_sums(batch.column("t").slice(a, b - a).to_pylist(), times[a:b])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=list("clnsq"))

    sums = some.mapInArrow(run, "c long, l long, n double, s double, q double").groupBy("c", "l").agg(
        F.sum("n"), F.sum("s"), F.sum("q")).collect()  # encodings x lengths at most
    rows = []
    for code, length, n, s, q in sums:
        mean = s / n
        # rounded: the order of summing must not decide
        rows.append((code, length, round(n), round(mean, 9), round(math.sqrt(max(0.0, (q - n * mean * mean) / max(n - 1, 1e-9))), 9)))
    return Ordinary(rows)


def _code_points(text: bytes, spans: list[tuple]) -> list[tuple]:
    """Byte spans (..., start, end) as code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(*s[:-2], int(before[s[-2]]), int(before[s[-1]])) for s in spans]


def _test(law: Ordinary, texts: list[bytes | None]):
    from xxhash import xxh3_64_intdigest
    all_base, all_tested = [], []
    for text in texts:
        text = text or b""
        base = base_spans(text)
        tested = []
        for a, b in candidates(text, base):
            token = text[a:b]
            encoding = encoding_of(token)
            found = law.log_p_and_weight(encoding, b - a, battery(token, encoding))
            if found is not None:
                key = xxh3_64_intdigest(token) - (1 << 63)
                step = max(-STEPS, math.ceil(GRID * (found[0] - math.log(found[1]))))  # rounded up: conservative
                tested.append((key, step, found[1], a, b))
        base.sort(key=lambda s: (s[1], BASE_KINDS.index(s[0])))
        all_base.append([{"kind": k, "start": a, "end": b} for k, a, b in _code_points(text, base)])
        all_tested.append([{"start": a, "end": b, "token": key, "step": step, "weight": w}
                           for key, step, w, a, b in _code_points(text, tested)])
    return [all_base, all_tested]


def cut_step(counts, fdr: float) -> int | None:
    """The largest step of log(p / weight) that the weighted Benjamini-Hochberg rule
    rejects; ``counts``: (step, distinct candidates, their summed weights)."""
    rows = sorted(counts)
    m, weights = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not m:
        return None
    cut, seen = None, 0
    for step, n, _ in rows:
        seen += n
        if math.exp(step / GRID) * weights / m <= fdr * seen / m:
            cut = step
    return cut


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """``keep`` columns (default: all but the text and one named spans) plus spans:
    kind, start and end of the base spans and of the random stretches."""
    keep = carried(docs, ["spans"], [text]) if keep is None else keep
    law = docs.sparkSession.sparkContext.broadcast(ordinary(docs, text))
    inner = docs.select(F.struct(F.lit(0), *[F.col(quoted(c)) for c in keep]).alias("__row"),
                        F.col(quoted(text)).alias("__text"))
    fields = [T.StructField("base", T.ArrayType(SPAN)), T.StructField("tested", T.ArrayType(TESTED))]

    def make():
        own = law.value
        return lambda texts: _test(own, texts)

    found = written(map_text(inner, "__text", fields, make, ["__row"]), "tested")
    distinct = found.select(F.explode("tested").alias("t")).groupBy("t.token").agg(
        F.min("t.step").alias("step"), F.max("t.weight").alias("weight"))
    counts = distinct.groupBy("step").agg(F.count(F.lit(1)), F.sum("weight")).collect()  # a row per step at most
    cut = cut_step([tuple(r) for r in counts], fdr)
    added = F.filter("tested", lambda t: t["step"] <= cut) if cut is not None else F.slice("tested", 1, 0)
    random = F.transform(added, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"),
                                                   t["end"].alias("end")))
    place = {kind: F.lit(i) for i, kind in enumerate(KINDS)}

    def rank(s):
        known = F.when(s["kind"] == KINDS[0], place[KINDS[0]])
        for kind in KINDS[1:]:
            known = known.when(s["kind"] == kind, place[kind])
        return F.struct(s["start"], known, s["end"])

    spans = F.array_sort(F.concat("base", random), lambda a, b: F.when(rank(a) < rank(b), -1)
                         .when(rank(a) > rank(b), 1).otherwise(0))
    return found.select(*[F.col("__row").getField(c).alias(c) for c in keep], spans.alias("spans"))
