"""Ranked lexical search by hashed max-sketches.

Score of a document for an item: over the item's distinct terms, the sum of
w * ((10^9 * tf) div (1000 * tf + 20 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1)))
and m = 50 + ((50 * n * N) div L); N documents with a term, L their terms, n the
document's terms, df the documents that hold the term.

1. One pass turns each text into the numbers and counts of its terms that some
   item of the batch holds (terms no item holds can only loosen a bound), written
   as a narrow table; N, L and df are partial sums over it.
2. A bounded sample of documents is scored exactly: an item's k-th score there can
   only be below its final k-th score, so it is a safe first threshold.
3. Each document's impacts fold into a sketch: ``WIDTH`` coordinates (rounded up to
   a power of two), a term's coordinate is a hash of its number, each keeps the maximum. For a
   block of documents all items look their coordinates up in the sketches and add
   them: upper bounds of the scores, since a coordinate is never below the impact
   of any term that falls on it. In order of descending bounds documents are
   rescored exactly until the next bound is below the item's threshold, which
   rises with every rescored document.
4. A task emits what reached its thresholds; a window keeps the k best.

Items come in blocks of at most ``BLOCK_ITEMS`` and ``BLOCK_TERMS`` distinct terms,
broadcast; all documents are read once per block. Memory of a task is a
block of sketches and k results per item.

Defined cases: NULL texts and items without terms have none and aren't ranked;
items with one item_id count as one item (the union of their terms), a NULL
item_id is an item; repeated document rows are ranked one by one; a NULL doc_id
comes last among equal scores; scores of 0 aren't returned; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import map_text, normal_words, quoted, written

TOP, WIDTH, SAMPLE_DOCS = 50, 2048, 5000
BLOCK_ITEMS, BLOCK_TERMS = 2048, 200_000
#: Documents sketched at a time, documents rescored at a time.
SKETCHED, RESCORED = 512, 64

BAGS = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType()))]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _bags(vocabulary: dict[bytes, int], texts: list[bytes | None]) -> list:
    """(terms of the text, its term numbers in ascending order, their counts)."""
    totals, rows, numbers = [], [], []
    for i, text in enumerate(texts):
        words = normal_words(text)
        totals.append(len(words))
        known = [v for v in map(vocabulary.get, words) if v is not None]
        numbers.append(np.asarray(known, dtype=np.int64))
        rows.append(np.full(len(known), i, dtype=np.int64))
    width = len(vocabulary) + 1
    keys, counts = np.unique(np.concatenate(rows) * width + np.concatenate(numbers), return_counts=True)
    offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * width)
    return [pa.array(totals, pa.int64()), _lists(offsets, keys % width), _lists(offsets, counts)]


class Items:
    """A block of items: their ids, distinct terms by number, and the vocabulary."""

    def __init__(self, ids: list, terms: list[list[bytes]]):
        words = sorted({t for own in terms for t in own})
        self.ids = ids
        self.vocabulary = {t: i for i, t in enumerate(words)}
        self.terms = [np.array(sorted(self.vocabulary[t] for t in own), dtype=np.int64) for own in terms]


class Weights:
    """Corpus figures: N, L and each term's weight."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        # no document holds a term with df 0, so its weight doesn't matter
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()],
                               dtype=np.int64)

    def impacts(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Impact of each (document's n, term, count)."""
        m = 50 + (50 * n * self.n_docs) // max(1, self.n_terms)
        return self.weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


class Search:
    """The ``top`` best documents of a stream of blocks for every item."""

    def __init__(self, items: Items, weights: Weights, top: int, width: int = WIDTH,
                 thresholds: np.ndarray | None = None):
        self.items, self.weights, self.top = items, weights, top
        # a score must reach its threshold; equal ones are settled by doc_id
        self.thresholds = np.ones(len(items.ids), dtype=np.int64)
        if thresholds is not None:
            self.thresholds = np.maximum(self.thresholds, thresholds)
        none = np.zeros(0, dtype=np.int64)
        self.best = [(none, none, none) for _ in items.ids]  # score, doc_id is NULL, doc_id
        self.rescored = 0
        v = len(items.vocabulary)
        bits = max(1, (max(1, min(width, v)) - 1).bit_length())
        self.width = 1 << bits
        # a term's coordinate: the upper bits of a multiplicative hash of its number
        self.place = ((np.arange(v, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        self.look = [self.place[t] for t in items.terms]
        # impacts in units that let the longest item's sum fit into 32 bits
        most = int(weights.weight.max(initial=1)) * 1_000_000 * max([len(t) for t in items.terms], default=1)
        self.unit = max(1, -(-most // (1 << 30)))

    def add(self, ids: pa.Array, n: np.ndarray, terms: pa.ListArray, counts: pa.ListArray) -> None:
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        numbers = terms.flatten().to_numpy().astype(np.int64)
        tf = counts.flatten().to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(n)), np.diff(offsets))
        impacts = self.weights.impacts(n[rows], numbers, tf)
        missing = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo in range(0, len(n), SKETCHED):
            hi = min(lo + SKETCHED, len(n))
            a, b = offsets[lo], offsets[hi]
            self._block(missing[lo:hi], known[lo:hi], rows[a:b] - lo, numbers[a:b], impacts[a:b])

    def _block(self, missing, known, rows, numbers, impacts) -> None:
        v, size = len(self.items.vocabulary), len(known)
        sketch = np.zeros(self.width * size, dtype=np.int32)
        value = (-(-impacts // self.unit)).astype(np.int32)
        order = np.argsort(value, kind="stable")  # the last, largest write to a coordinate stays
        sketch[(self.place[numbers] * size + rows)[order]] = value[order]
        sketch = sketch.reshape(self.width, size)
        keys = rows * v + numbers  # ascending
        for i, look in enumerate(self.look):
            if not len(look) or not len(keys):
                continue
            bounds = np.add.reduce(sketch[look], axis=0)
            able = np.flatnonzero(bounds >= -(-int(self.thresholds[i]) // self.unit))
            able = able[np.argsort(-bounds[able], kind="stable")]
            for start in range(0, len(able), RESCORED):
                some = able[start:start + RESCORED]
                some = some[bounds[some].astype(np.int64) * self.unit >= self.thresholds[i]]
                if not len(some):
                    break
                self._rescore(i, some, missing, known, keys, impacts)

    def _rescore(self, i: int, some: np.ndarray, missing, known, keys, impacts) -> None:
        wanted = (some[:, None] * len(self.items.vocabulary) + self.items.terms[i][None, :]).ravel()
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        scores = np.where(keys[found] == wanted, impacts[found], 0).reshape(len(some), -1).sum(axis=1)
        self.rescored += len(some)
        good = np.flatnonzero(scores >= self.thresholds[i])
        if not len(good):
            return
        held = tuple(np.concatenate([a, b]) for a, b in zip(
            self.best[i], (scores[good], missing[some[good]], known[some[good]])))
        if len(held[0]) >= self.top:
            first = np.lexsort((held[2], held[1], -held[0]))[:self.top]
            held = tuple(a[first] for a in held)
            self.thresholds[i] = max(self.thresholds[i], held[0][-1])
        self.best[i] = held

    def results(self, item_type: pa.DataType, doc_type: pa.DataType) -> pa.RecordBatch:
        """(item_id, doc_id, score) of all items."""
        sizes = [len(b[0]) for b in self.best]
        score, missing, known = (np.concatenate([b[j] for b in self.best] or [np.zeros(0, np.int64)]) for j in range(3))
        items = pa.array(self.items.ids, type=item_type).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        docs = pa.array(known, mask=missing.astype(bool)).cast(doc_type)
        return pa.RecordBatch.from_arrays([items, docs, pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item_id; items without terms go."""
    field = [T.StructField("terms", T.ArrayType(T.BinaryType()))]
    cut = map_text(items.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(text)).alias("__text")), "__text",
                   field, lambda: lambda texts: [[sorted(set(normal_words(t))) for t in texts]], ["item_id"])
    return cut.select("item_id", F.explode("terms").alias("t")).groupBy("item_id") \
        .agg(F.sort_array(F.collect_set("t")).alias("terms"))


def bags(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with a term, written."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    inner = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("__text"))

    def make():
        own = known.value
        return lambda texts: _bags(own, texts)

    return written(map_text(inner, "__text", BAGS, make, ["doc_id"]).where("n > 0"), "bags")


def corpus_weights(bag_table: DataFrame, n_words: int) -> Weights:
    """N, L and df from partial sums; the df rows are as many as the block's terms."""
    n_docs, n_terms = bag_table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = bag_table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(n_words, dtype=np.int64)
    df[counted.column("t").to_numpy()] = counted.column("df").to_numpy()
    return Weights(n_docs, n_terms, df)


def _searched(bag_table: DataFrame, items: Items, weights: Weights, item_kind: T.DataType, top: int, width: int,
              thresholds: np.ndarray | None) -> DataFrame:
    shared = bag_table.sparkSession.sparkContext.broadcast((items, weights, thresholds))
    doc_kind = bag_table.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item_id", item_kind), T.StructField("doc_id", doc_kind),
                           T.StructField("score", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        own_items, own_weights, least = shared.value
        search = Search(own_items, own_weights, top, width, least)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4 * SKETCHED):
                part = batch.slice(lo, 4 * SKETCHED)
                search.add(part.column(0), part.column(1).to_numpy(), part.column(2), part.column(3))
        yield search.results(to_arrow_type(item_kind), to_arrow_type(doc_kind))

    return bag_table.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _block(docs: DataFrame, rows: list, item_kind: T.DataType, doc_id: str, text: str, top: int, width: int,
           sample: int) -> DataFrame:
    items = Items([r["item_id"] for r in rows], [[bytes(t) for t in r["terms"]] for r in rows])
    bag_table = bags(docs, items.vocabulary, doc_id, text)
    weights = corpus_weights(bag_table, len(items.vocabulary))
    share = sample / max(1, weights.n_docs)
    thresholds = None
    if share < 0.5:
        some = bag_table.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 30)) < int(share * (1 << 30)))
        first = _ranked(_searched(some, items, weights, item_kind, top, width, None), top) \
            .where(F.col("rank") == top).select("item_id", "score").collect()  # a row per item of the block
        reached = {r["item_id"]: r["score"] for r in first}
        thresholds = np.array([reached.get(i, 1) for i in items.ids], dtype=np.int64)
    return _ranked(_searched(bag_table, items, weights, item_kind, top, width, thresholds), top)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id",
         text: str = "text", item_text: str = "text", width: int = WIDTH, sample: int = SAMPLE_DOCS,
         block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id (an integer column), score of each item's ``top`` best documents."""
    wanted = written(item_terms(items, item_id, item_text), "items")
    n, terms = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(terms / block_terms))
    kind = wanted.schema["item_id"].dataType
    found = None
    for b in range(blocks):
        mine = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        part = _block(docs, mine.collect(), kind, doc_id, text, top, width, sample)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")
