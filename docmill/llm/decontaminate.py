"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of all benchmark items (13 consecutive words; an item with fewer
is one window) become a hash set that every task holds. Documents stream past
it: word windows are hashed vectorised, hits are verified word by word, and the
hit spans are returned, so a caller can drop spans or whole documents. Nothing
of the documents is shuffled.

The set is broadcast only when the benchmark's measured text size is within
``max_bytes``; beyond it the same windows meet in a shuffle join on their
128-bit hash (``hits_by_join``), with equal results.

Defined cases: NULL and empty texts have no words, no hits; NULL item texts
have no windows; repeated items and rows each count as given (items are a set
of item_ids); an item_id that is NULL is ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import collect_if_within
from docmill.llm.common import (Rolling, carried, filtered, map_text, mix, normal_words, quoted, word_hashes,
                                written)

WINDOW = 13
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 500_000, 32 << 20

FIELDS = [T.StructField("n_words", T.LongType()),
          T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
          T.StructField("items", T.ArrayType(T.StringType()))]


def item_windows(words: list[bytes], window: int) -> list[tuple]:
    if not words:
        return []
    if len(words) <= window:
        return [tuple(words)]
    return [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]


def build_index(items: list[tuple[str, bytes]], window: int) -> dict:
    """{'vocab': word -> id from 1, 'grams': {id tuple: [item ids]}}."""
    vocab: dict[bytes, int] = {}
    grams: dict[tuple, set] = {}
    for item, text in items:
        for gram in item_windows(normal_words(text), window):
            ids = tuple(vocab.setdefault(w, len(vocab) + 1) for w in gram)
            grams.setdefault(ids, set()).add(item)
    return {"vocab": vocab, "grams": {k: sorted(v) for k, v in grams.items()}}


def _scanner(index: dict):
    """A kernel over UTF-8 texts for an index of ``build_index``."""
    get = index["vocab"].get
    codes = mix(np.arange(1, len(index["vocab"]) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by_length: dict[int, np.ndarray] = {}
    for gram in index["grams"]:
        by_length.setdefault(len(gram), []).append(gram)
    for n, grams in by_length.items():
        rolled = Rolling(codes[np.array(grams, dtype=np.int64).ravel()])
        by_length[n] = np.unique(rolled(np.arange(0, len(grams) * n, n), n))

    def scan(texts):
        words = [normal_words(t) for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(counts)
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), dtype=np.int64, count=int(counts.sum()))
        n = len(ids)
        # how far on words of the benchmark's vocabulary run within a document
        stops = np.where(ids == 0)[0]
        nxt = np.concatenate([stops, [n]])[np.searchsorted(stops, np.arange(n))]
        doc_of = np.repeat(np.arange(len(texts)), counts)
        run = np.minimum(nxt, ends[doc_of]) - np.arange(n) if n else np.zeros(0, dtype=np.int64)
        edge = np.zeros(n + 1, dtype=np.int64)
        found = [set() for _ in texts]
        rolled = Rolling(codes[ids]) if len(by_length) else None
        for length, known in by_length.items():
            at = np.where(run >= length)[0]
            if not len(at):
                continue
            h = rolled(at, length)
            near = known[np.minimum(np.searchsorted(known, h), len(known) - 1)]
            for i in at[near == h].tolist():
                gram = index["grams"].get(tuple(ids[i:i + length].tolist()))
                if gram is not None:  # verified word by word
                    found[doc_of[i]].update(gram)
                    edge[i] += 1
                    edge[i + length] -= 1
        hit = np.cumsum(edge[:-1]) > 0
        # spans of hit words, cut at document borders
        spans: list[list] = [[] for _ in texts]
        starts_doc = np.zeros(n, dtype=bool)
        starts_doc[(ends - counts)[counts > 0]] = True
        at = np.where(hit)[0]
        if len(at):
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(at) > 1) | starts_doc[at[1:]]
            first = at[new]
            last = np.append(at[np.where(new)[0][1:] - 1], at[-1])
            for a, b in zip(first.tolist(), last.tolist()):
                d = doc_of[a]
                base = int(ends[d] - counts[d])
                spans[d].append([a - base, b + 1 - base])
        return [counts.tolist(), spans, [sorted(f) for f in found]]

    return scan


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None,
                  max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default, but those named like an
    output) plus n_words, hit_spans (word ranges [start, end) covered by an
    item's window) and items (sorted ids of items with a window here)."""
    keep = carried(docs, [f.name for f in FIELDS]) if keep is None else keep
    wanted, index = _benchmark(items, item_id, item_text, window, max_rows, max_bytes)
    if index is None:
        return hits_by_join(docs, wanted, text, window, keep)
    return map_text(docs, text, FIELDS, lambda: _scanner(index.value), keep)


def _benchmark(items: DataFrame, item_id: str, item_text: str, window: int, max_rows: int, max_bytes: int):
    """(item, body) rows, and their broadcast index if they are within the bound."""
    wanted = items.select(F.col(quoted(item_id)).cast("string").alias("item"),
                          F.col(quoted(item_text)).cast("binary").alias("body")).where("item is not null")
    size = F.coalesce(F.octet_length("body"), F.lit(0)) + F.octet_length("item")
    small = collect_if_within(wanted, size, max_rows, max_bytes)
    if small is None:
        return wanted, None
    index = build_index(list(zip(small.column("item").to_pylist(), small.column("body").to_pylist())), window)
    return wanted, items.sparkSession.sparkContext.broadcast(index)


def _hashed(lengths: list[int], item_side: bool, window: int):
    """Kernel: the windows of a text with two independent 64-bit hashes."""
    def make():
        def kernel(texts):
            counts, rows = [], []
            for t in texts:
                words = normal_words(t)
                counts.append(len(words))
                out = []
                if words:
                    h = word_hashes(words)
                    one, two = Rolling(h), Rolling(h ^ (h << np.uint64(17)) ^ np.uint64(0xD6E8FEB86659FD93))
                    for length in ([min(window, len(words))] if item_side else lengths):
                        a, b = one.windows(length).view(np.int64), two.windows(length).view(np.int64)
                        out += [{"at": i, "len": length, "a": x, "b": y}
                                for i, (x, y) in enumerate(zip(a.tolist(), b.tolist()))]
                rows.append(out)
            return [counts, rows]

        return kernel
    return make


def hits_by_join(docs: DataFrame, wanted: DataFrame, text: str, window: int, keep: list[str]) -> DataFrame:
    """The same rows for a benchmark of any size: windows of both sides meet on
    their hashes in a shuffle join (frequent windows are split by AQE)."""
    win = T.StructType([T.StructField("at", T.LongType()), T.StructField("len", T.LongType()),
                        T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("w", T.ArrayType(win))]
    item_w = written(map_text(wanted, "body", fields, _hashed([], True, window), ["item"])
                     .select("item", F.explode("w").alias("w")).select("item", "w.len", "w.a", "w.b").distinct(),
                     "items")
    lengths = [r["len"] for r in item_w.select("len").distinct().collect()]  # at most ``window`` values
    named = docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).alias("__text")) \
        .withColumn("__row", F.monotonically_increasing_id())
    rows = written(named, "rows")
    doc_w = map_text(rows, "__text", fields, _hashed(lengths, False, window), ["__row"]) \
        .select("__row", "n_words", F.explode("w").alias("w")).select("__row", "w.*")
    hits = doc_w.join(item_w, ["len", "a", "b"]).groupBy("__row").agg(
        F.collect_set(F.array(F.col("at"), F.col("at") + F.col("len"))).alias("ranges"),
        F.sort_array(F.collect_set("item")).alias("items"))
    merged = F.aggregate(
        F.sort_array("ranges"), F.expr("cast(array() as array<array<bigint>>)"),
        lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= r[0]),
                              F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                                       F.array(F.array(F.element_at(acc, -1)[0],
                                                       F.greatest(F.element_at(F.element_at(acc, -1), 2), r[1])))))
        .otherwise(F.concat(acc, F.array(r))))
    counted = map_text(rows, "__text", fields[:1], lambda: lambda ts: [[len(normal_words(t)) for t in ts]],
                       keep + ["__row"])
    none = F.expr("cast(array() as array<array<bigint>>)")
    return counted.join(hits.withColumn("hit_spans", merged).drop("ranges"), "__row", "left").select(
        *[F.col(quoted(c)) for c in keep], "n_words",
        F.coalesce("hit_spans", none).alias("hit_spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def n_hit(spans="hit_spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def is_contaminated(hit, words):
    """The rule: some word is hit, and hit words are 5 % of all or more."""
    return (hit > 0) & (hit * 20 >= words)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, max_rows: int = MAX_BROADCAST_ROWS,
                  max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the documents that the rule calls contaminated."""
    clean = ~is_contaminated(n_hit(), F.col("n_words"))
    wanted, index = _benchmark(items, item_id, item_text, window, max_rows, max_bytes)
    if index is not None:
        return filtered(docs, text, FIELDS, lambda: _scanner(index.value), clean)
    rows = docs.select(F.struct(F.lit(0), *[F.col(quoted(c)) for c in docs.columns]).alias("__doc"),
                       F.col(quoted(text)).alias("__body"))
    found = hits_by_join(rows, wanted, "__body", window, ["__doc"]).where(clean)
    return found.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
