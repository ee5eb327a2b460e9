"""Quality rules from tokeniser fertility.

A public sentence-piece vocabulary measures each document word by word
(remembered per task): characters per token, the share of byte-fallback tokens
and the entropy of the token distribution. A document is rejected when a measure
leaves the band of its language (or, for a language without bands, of its
script), or when the base rules fail (under 20 words; over 30 % of words in
repeated 8-word windows). One narrow pass over the texts, no shuffle of them.

:func:`fit_bands` fits the bands of each language on all documents labelled good:
limits that all but ``ALLOWED`` of them keep. Entropy grows with length, so its limit
is a curve over the log of the number of tokens, fitted on the same rows; a text of
any length is compared with what its length lets expect. The curve comes from sums,
the limits from exact order statistics (counts by bins, then within the bins needed).
Languages without enough labelled rows, and scripts, have the fixed bands ``BANDS``,
whose entropy limit is a share of log2(tokens) (up to ``ENTROPY_BITS``), its maximum.
Once fitted, a verdict depends on the document alone.

Defined cases: NULL and empty texts have 0 words and fail the base rule; a NULL
or unknown language uses the bands of its script; repeated rows get equal
verdicts; very long texts are measured whole.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import (LONGEST, Rolling, carried, filtered, map_text, mix, per_worker, plain_words, quoted,
                                small_table, written)

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Remembered words per worker (up to twice as many, none over ``LONGEST`` bytes).
REMEMBER = 80_000

#: Least labelled rows per language that bands are fitted on, and the share of them that
#: each limit may cut off. Values are counted in millionths, first in bins of so many.
FIT_LEAST, ALLOWED, BIN = 50, 0.002, 10_000
#: Bands [low, high] of characters per token, byte-fallback share and entropy
#: share where none are fitted, by language, then by script: wide, for any prose.
BANDS = {
    "en": {"chars_per_token": (1.4, 6.5), "byte_share": (0.0, 0.10), "entropy_share": (0.38, 1.0)},
    "de": {"chars_per_token": (1.4, 6.5), "byte_share": (0.0, 0.10), "entropy_share": (0.38, 1.0)},
    "fr": {"chars_per_token": (1.3, 6.5), "byte_share": (0.0, 0.10), "entropy_share": (0.38, 1.0)},
    "es": {"chars_per_token": (1.3, 6.5), "byte_share": (0.0, 0.10), "entropy_share": (0.38, 1.0)},
    "LATIN": {"chars_per_token": (1.2, 7.0), "byte_share": (0.0, 0.20), "entropy_share": (0.38, 1.0)},
    "CYRILLIC": {"chars_per_token": (1.0, 6.0), "byte_share": (0.0, 0.20), "entropy_share": (0.38, 1.0)},
    "GREEK": {"chars_per_token": (0.6, 5.0), "byte_share": (0.0, 0.35), "entropy_share": (0.38, 1.0)},
    "ARABIC": {"chars_per_token": (0.6, 5.0), "byte_share": (0.0, 0.35), "entropy_share": (0.38, 1.0)},
    "HEBREW": {"chars_per_token": (0.6, 5.0), "byte_share": (0.0, 0.35), "entropy_share": (0.38, 1.0)},
    "DEVANAGARI": {"chars_per_token": (0.5, 5.0), "byte_share": (0.0, 0.35), "entropy_share": (0.38, 1.0)},
    "THAI": {"chars_per_token": (0.5, 4.0), "byte_share": (0.0, 0.35), "entropy_share": (0.38, 1.0)},
    "HAN": {"chars_per_token": (0.5, 3.0), "byte_share": (0.0, 0.60), "entropy_share": (0.38, 1.0)},
    "KANA": {"chars_per_token": (0.5, 3.0), "byte_share": (0.0, 0.50), "entropy_share": (0.38, 1.0)},
    "HANGUL": {"chars_per_token": (0.4, 3.0), "byte_share": (0.0, 0.60), "entropy_share": (0.38, 1.0)},
    # scripts of which the vocabulary may have no piece, so that all is bytes
    "OTHER": {"chars_per_token": (0.2, 7.0), "byte_share": (0.0, 1.0), "entropy_share": (0.3, 1.0)},
    # hardly a letter: symbols, digits
    "NONE": {"chars_per_token": (1.4, 6.5), "byte_share": (0.0, 0.10), "entropy_share": (0.38, 1.0)},
}
#: Scripts by the first word of their letters' Unicode names, and the letters of
#: a hundred non-blank characters below which a text has none.
SCRIPTS = {k: k for k in BANDS if k.isupper() and k not in ("OTHER", "NONE", "HAN", "KANA")} | {
    "CJK": "HAN", "HIRAGANA": "KANA", "KATAKANA": "KANA"}
MIN_LETTERS = 10
#: Entropy that a text of any length can be asked for.
ENTROPY_BITS = 11.0

FIELDS = [T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_tokens", T.LongType()),
    ("chars_per_token", T.DoubleType()), ("byte_share", T.DoubleType()),
    ("entropy_share", T.DoubleType()), ("entropy_bits", T.DoubleType()), ("script", T.StringType()))]

_SPACE = b" \t\n\x0b\x0c\r"
_ASCII = bytes(range(0x80))
_NOT_ASCII_LETTERS = bytes(c for c in range(256) if not (c < 0x80 and chr(c).isalpha()))
_NOT_VISIBLE_ASCII = bytes(c for c in range(256) if c >= 0x80 or chr(c).isspace())
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space and continuation bytes


def repeated_words(words: list[list[bytes]], window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document: words covered by a window found twice or more in it."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    n = int(counts.sum())
    if n < window:
        return np.zeros(len(words), dtype=np.int64)
    # only compared within a document, so the process's own hash will do
    flat = mix(np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=n).view(np.uint64))
    doc = np.repeat(np.arange(len(words)), counts)
    at = np.where(doc[:n - window + 1] == doc[window - 1:])[0]
    with np.errstate(over="ignore"):
        key = mix(Rolling(flat).windows(window)[at] + mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + window] -= 1  # starts are distinct, so plain indexing counts each
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words))


def duplicate_lines(text: bytes | None) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()] if text else []
    return len(lines) - len(set(lines))


@functools.lru_cache(1 << 14)
def _script(c: str) -> str | None:
    """Script of a letter; None for any other character."""
    return SCRIPTS.get(unicodedata.name(c, "OTHER").split(" ")[0], "OTHER") if c.isalpha() else None


def script_of(text: bytes | None) -> str:
    """Script of most of the letters of the whole text (a key of ``BANDS``); NONE
    if hardly any character is a letter. ASCII is counted as bytes, the distinct
    characters beyond it one by one."""
    text = text or b""
    votes = {"LATIN": len(text.translate(None, _NOT_ASCII_LETTERS))}
    count = len(text.translate(None, _NOT_VISIBLE_ASCII))
    codes, times = np.unique(np.frombuffer(text.translate(None, _ASCII).decode("utf-8").encode("utf-32-le"), "<u4"),
                             return_counts=True)
    for c, n in zip(map(chr, codes.tolist()), times.tolist()):
        script = _script(c)
        count += 0 if c.isspace() else n
        if script:
            votes[script] = votes.get(script, 0) + n
    letters = sum(votes.values())
    if not letters or 100 * letters < MIN_LETTERS * count:
        return "NONE"
    return max(votes, key=lambda k: (votes[k], k))


class Fertility:
    """Ids of a public sentence-piece model, word by word."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, words: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.known) > REMEMBER:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        unknown = {w for ws in words for w in ws if w not in known}
        known.update((w, old[w]) for w in unknown if w in old)
        new = [w for w in unknown if w not in old]
        for w, ids in zip(new, self.model.encode([w.decode("utf-8") for w in new], num_threads=1)):
            known[w] = np.array(ids, dtype="<u4").tobytes()
        out = [np.frombuffer(b"".join([known[w] for w in ws]), dtype="<u4") for ws in words]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    def measures(self, words: list[list[bytes]]):
        """(tokens, byte-fallback tokens, entropy in bits) per document."""
        ids = self.ids(words)
        n = np.array([len(i) for i in ids], dtype=np.int64)
        flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(ids)), n)
        in_bytes = np.bincount(doc[self.is_byte[flat]], minlength=len(ids)) if len(flat) else np.zeros(len(ids), int)
        pair, times = np.unique(doc * len(self.is_byte) + flat, return_counts=True)
        spread = np.bincount(pair // len(self.is_byte), weights=times * np.log2(times), minlength=len(ids))
        some = np.maximum(n, 1)
        return n, in_bytes, np.log2(some) - spread / some


def _kernel(model):
    fertility = per_worker(("fertility", zlib.crc32(model)), lambda: Fertility(model))

    def kernel(texts):
        words = [plain_words(t) for t in texts]
        n, in_bytes, entropy = fertility.measures(words)
        chars = [len(t.translate(None, _NOT_COUNTED)) if t else 0 for t in texts]
        some = np.maximum(n, 1)
        most = np.minimum(np.log2(np.maximum(n, 2)), ENTROPY_BITS)
        return [[len(w) for w in words], chars,
                [len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts],
                [duplicate_lines(t) for t in texts],
                repeated_words(words).tolist(), n.tolist(),
                np.round(np.array(chars) / some, 6).tolist(), np.round(in_bytes / some, 6).tolist(),
                np.round(np.minimum(1.0, entropy / most), 6).tolist(), np.round(entropy, 6).tolist(),
                [script_of(t) for t in texts]]

    kernel.remembers = True
    return kernel


def base_failed(words="n_words", repeated="n_repeat_words"):
    return (F.col(words) < MIN_WORDS) | (F.col(repeated) * 100 > F.col(words) * MAX_REPEAT_PERCENT)


def in_bands(lang, bands=BANDS):
    """Every measure within the bands of the language, else of the script."""
    name = F.when(lang.isin([k for k in bands if k not in SCRIPTS and k not in ("OTHER", "NONE", "HAN", "KANA")]), lang) \
        .otherwise(F.col("script"))

    def numbers(values):
        return F.array(*[F.lit(float(v)) for v in values])

    table = F.create_map(*[x for k, b in bands.items() for x in (F.lit(k), F.struct(
        *[numbers(b[m]).alias(m) for m in ("chars_per_token", "byte_share", "entropy_share")],
        numbers(b.get("entropy_bits", (0, 0, 0, -1, 0, 64))).alias("entropy_bits")))])
    band = F.element_at(table, name)
    ok = F.lit(True)
    for measure in ("chars_per_token", "byte_share", "entropy_share"):
        ok = ok & F.col(measure).between(band[measure][0], band[measure][1])
    c0, c1, c2, low, least, most = (band["entropy_bits"][i] for i in range(6))
    size = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    x = F.greatest(least, F.least(most, size))
    # a text shorter than all fitted ones can have so many bits less
    limit = c0 + c1 * x + c2 * x * x + low - F.greatest(F.lit(0.0), least - size)
    return ok & (F.col("entropy_bits") >= limit)


def quantiles(rows: DataFrame, asked: dict[tuple[str, str], tuple[int, list[float]]]) -> dict[tuple[str, str], list[float]]:
    """Exact quantiles (linear between neighbours) of rows (name, what, v: millionths);
    ``asked``: (name, what) -> (how many, shares). Only counts leave the executors: by
    bins, then by value within the bins that hold a neighbour."""
    ranks = {key: sorted({r for p in shares for r in (int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1))})
             for key, (n, shares) in asked.items()}
    binned = rows.withColumn("b", F.floor(F.col("v") / BIN))
    bins: dict = {}
    for name, what, b, n in sorted(map(tuple, binned.groupBy("name", "what", "b").count().collect())):
        bins.setdefault((name, what), []).append((b, n))
    places, needed = {}, set()
    for key, wanted in ranks.items():
        ends = np.cumsum([n for _, n in bins[key]])
        for r in wanted:
            i = int(np.searchsorted(ends, r, side="right"))
            places[key, r] = (bins[key][i][0], r - int(ends[i] - bins[key][i][1]))
            needed.add((*key, bins[key][i][0]))
    some = small_table(rows.sparkSession, sorted(needed), "name string, what string, b long")
    values: dict = {}
    for name, what, b, v, n in sorted(map(tuple, binned.join(F.broadcast(some), ["name", "what", "b"])
                                          .groupBy("name", "what", "b", "v").count().collect())):
        values.setdefault((name, what, b), []).append((v, n))

    def at(key, r):
        b, left = places[key, r]
        held = values[(*key, b)]
        return held[int(np.searchsorted(np.cumsum([n for _, n in held]), left, side="right"))][0] / 1e6

    out = {}
    for key, (n, shares) in asked.items():
        out[key] = []
        for p in shares:
            h = (n - 1) * p
            low, high = at(key, int(h)), at(key, min(int(h) + 1, n - 1))
            out[key].append(low + (h - int(h)) * (high - low))
    return out


def fit_bands(docs: DataFrame, labels: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text",
              lang: str = "lang", good: str = "quality", least: int = FIT_LEAST, bands=BANDS,
              measured: DataFrame | None = None) -> dict:
    """``bands`` with those of each language that has ``least`` documents or more among
    all documents whose label ``good`` is 1. Only documents that pass the base rules
    count; a doc_id counts once. ``measured``: a written table of :func:`measure` with
    ``doc_id`` and ``lang``, if there is one (else the labelled documents are measured)."""
    ids = labels.where(F.col(quoted(good)) == 1).select(F.col(quoted(doc_id)).alias("__id")).distinct()
    named = [F.col(quoted(doc_id)).alias("__id"), F.col(quoted(lang)).cast("string").alias("__lang")]
    if measured is None:
        some = docs.select(*named, F.col(quoted(text)).alias("__text")).join(maybe_broadcast(ids), "__id", "left_semi")
        chosen = measure(some, model_path, "__text", "__lang", keep=["__id", "__lang"])
    else:
        chosen = measured.select("*", *named).join(maybe_broadcast(ids), "__id", "left_semi")
    once = chosen.where("not base_failed and __lang is not null").groupBy("__id").agg(F.min(F.struct(
        "__lang", "chars_per_token", "byte_share", "n_tokens", "entropy_bits")).alias("d")).select("d.*")
    rows = written(once.where(~F.col("__lang").isin(list(SCRIPTS))).select(
        F.col("__lang").alias("name"), "chars_per_token", "byte_share", "n_tokens", "entropy_bits",
        F.log2(F.greatest("n_tokens", F.lit(1)).cast("double")).alias("size")), "good")
    # least squares from sums; the middle of the sizes is taken off first
    z, bits = F.col("size") - 8, F.col("entropy_bits")
    sums = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"),
        F.count_distinct("n_tokens").alias("sizes"), F.array(*[F.sum(F.pow(z, F.lit(i))) for i in range(5)]).alias("x"),
        F.array(*[F.sum(F.pow(z, F.lit(i)) * bits) for i in range(3)]).alias("xy")).where(F.col("n") >= least).collect()
    if not sums:
        return dict(bands)
    curves = {}
    for r in sums:
        degree = 2 if r.sizes > 2 else 0
        a = np.zeros(3)
        a[:degree + 1] = np.linalg.solve([[r.x[i + j] for j in range(degree + 1)] for i in range(degree + 1)], r.xy[:degree + 1])
        # rounded: the order of summing must not decide
        curves[r.name] = [round(float(c), 6) for c in (a[0] - 8 * a[1] + 64 * a[2], a[1] - 16 * a[2], a[2])]
    table = small_table(rows.sparkSession, [(k, *c) for k, c in curves.items()], "name string, c0 double, c1 double, c2 double")
    over = F.floor((bits - (F.col("c0") + F.col("c1") * F.col("size") + F.col("c2") * F.col("size") * F.col("size"))) * 1e6)
    million = {"chars": F.round(F.col("chars_per_token") * 1e6).cast("long"),
               "bytes": F.round(F.col("byte_share") * 1e6).cast("long"), "over": over}
    values = rows.join(F.broadcast(table), "name").select("name", F.inline(F.array(*[  # a row per language
        F.struct(F.lit(k).alias("what"), v.alias("v")) for k, v in million.items()])))
    asked = {"chars": [ALLOWED, 1 - ALLOWED], "bytes": [1 - ALLOWED], "over": [ALLOWED]}
    found = quantiles(values, {(r.name, k): (r.n, p) for r in sums for k, p in asked.items()})
    out = dict(bands)
    for r in sums:  # the measures are rounded to six decimals
        low, high = found[r.name, "chars"]
        out[r.name] = {"chars_per_token": (low - 1e-6, high + 1e-6), "byte_share": (0.0, found[r.name, "bytes"][0] + 1e-6),
                       "entropy_share": (0.0, 1.0),
                       "entropy_bits": (*curves[r.name], found[r.name, "over"][0] - 1e-6, r.low, r.high)}
    return out


def measure(docs: DataFrame, model_path: str, text: str = "text", lang: str | None = "lang",
            keep: list[str] | None = None, bands=BANDS) -> DataFrame:
    """``keep`` columns (default: all but those named like an output) plus the
    measures, base_failed and kept. ``lang`` None: bands by script only. The
    model file is read on the driver."""
    outputs = [f.name for f in FIELDS] + ["base_failed", "kept"]
    keep = carried(docs, outputs) if keep is None else keep
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    inner = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("__doc"),
                        F.col(quoted(text)).alias("__body"),
                        (F.col(quoted(lang)).cast("string") if lang else F.lit(None).cast("string")).alias("__lang"))
    rows = map_text(inner, "__body", FIELDS, lambda: _kernel(model.value), ["__doc", "__lang"])
    rows = judged(rows.withColumn("base_failed", base_failed()), F.col("__lang"), bands)
    return rows.select(*[F.col("__doc").getField(c).alias(c) for c in keep], *outputs)


def judged(measured: DataFrame, lang, bands=BANDS) -> DataFrame:
    """Measured rows with the verdict of ``bands``."""
    return measured.withColumn("kept", ~F.col("base_failed") & in_bands(lang, bands))


def keep_good(docs: DataFrame, model_path: str, text: str = "text", lang: str | None = "lang",
              bands=BANDS) -> DataFrame:
    """``docs`` (all columns, unchanged) without the documents it rejects."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    language = F.col("__row").getField(lang).cast("string") if lang else F.lit(None).cast("string")
    return filtered(docs, text, FIELDS, lambda: _kernel(model.value), ~base_failed() & in_bands(language, bands))
