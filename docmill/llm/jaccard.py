"""N-gram Jaccard join by MinHash banding.

Documents are word sets of five consecutive normalised words (a text of one to
four words is one shingle; without words there is none). Two texts are linked
when the Jaccard similarity of their shingle sets is 0.8 or more.

1. Equal texts are one *class* (keyed by the text's MD5); all later steps work on
   classes, so copies cost one row each.
2. Each class gets a MinHash signature in bands; band and row counts follow from
   the target recall at the threshold (``choose_bands``).
3. Bands meet in a shuffle on their hash, counted with map-side combining.
   Buckets of different bands with the same members (equal count, hash XOR and
   hash sum) are one *set*, so a pair of copies is verified once, not once per band.
4. The full shingle sets of a set's members meet in blocks of bounded size; every
   pair of members is verified where its first common band says so, by exact set
   intersections (a blocked matrix product). A block returns one row per linked
   member: its number of links and its block component's least member. No pair
   rows exist, whatever a bucket's size.
5. Links are summed per class; components follow by least-label propagation with
   pointer jumping over the blocks' star edges, each round a written table.

Defined cases: NULL texts are alone in their class and without links; texts
without words are linked to nothing, equal ones share a class; rows repeated with
the same doc_id are copies; a class's id is its least doc_id (NULL if all are).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import Rolling, map_text, mix, normal_words, quoted, word_hashes, written

SHINGLE, THRESHOLD, TARGET_RECALL, ROWS = 5, 0.8, 0.9999, 6
#: Members and shingles of one side of a verification block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20

KEYED = [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n_shingles", T.LongType())]
SETS = [T.StructField("bands", T.BinaryType()), T.StructField("shingles", T.BinaryType())]
LINKED = T.StructType([T.StructField("cid", T.BinaryType()), T.StructField("n", T.LongType()),
                       T.StructField("root", T.BinaryType())])


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` rows that find a pair at the
    threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)), rows


def shingle_sets(words: list[list[bytes]], n: int = SHINGLE):
    """Shingle hashes of all texts in a row and the number of each text's."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    if not counts.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(len(words), dtype=np.int64)
    rolled = Rolling(word_hashes(w for ws in words for w in ws))
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    length = np.repeat(np.minimum(counts, n), sizes)
    first = np.repeat(np.cumsum(counts) - counts, sizes)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rolled(first + inside, length), sizes


def band_hashes(shingles: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) band hashes; texts without shingles have arbitrary ones."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factor, offset = seeds[0::2] | np.uint64(1), seeds[1::2]
    out = np.zeros((len(sizes), bands), dtype=np.uint64)
    some = np.where(sizes > 0)[0]
    if not len(some):
        return out
    starts = (np.cumsum(sizes) - sizes)[some]
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(some), np.uint64(band + 1))
            for i in range(band * rows, (band + 1) * rows):
                key = mix(key ^ np.minimum.reduceat(shingles * factor[i] + offset[i], starts))
            out[some, band] = key
    return out


def _signatures(bands: int, rows: int, with_sets: bool):
    def make():
        def kernel(texts):
            shingles, sizes = shingle_sets([normal_words(t) for t in texts])
            keys = band_hashes(shingles, sizes, bands, rows).view(np.int64)
            if not with_sets:
                return [[k.tolist() if n else [] for k, n in zip(keys, sizes)], sizes.tolist()]
            ends = np.cumsum(sizes)
            return [[k.tobytes() for k in keys],
                    [np.unique(shingles[e - n:e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]]

        return kernel
    return make


# -- verification in blocks ---------------------------------------------------

def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all pairs of sets, by products of 0/1 blocks
    over the shingles that two sets or more have."""
    sizes = np.array([len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times >= 2
    column = np.cumsum(shared) - 1
    use = shared[place]
    row, at = row[use], column[place[use]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(at, [start, start + columns])
        block = np.zeros((len(sets), columns), dtype=np.float32)
        block[row[a:b], at[a:b] - start] = 1
        out += block @ block.T
    return out


def verify(cids: list[bytes], bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, band: int,
           crossed: bool, threshold: float):
    """Links of a block: pairs from its two sides (any pair unless it is
    ``crossed``) whose first common band is ``band`` and whose similarity reaches
    the threshold. Returns (cid, links, least cid of the block component). A
    crossed block with members on one side only has none: they meet in their own."""
    n = len(cids)
    same = bands[:, None, 0] == bands[None, :, 0] if band == 0 else None
    if band:  # no earlier band may be common
        same = bands[:, None, band] == bands[None, :, band]
        for earlier in range(band):
            same &= bands[:, None, earlier] != bands[None, :, earlier]
    if crossed:
        same &= side[:, None] != side[None, :]
    np.fill_diagonal(same, False)
    if not same.any():
        return []
    common = common_counts(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    link = same & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
    degree = link.sum(axis=1)
    root = np.arange(n)
    rank = np.argsort(np.array(cids, dtype=object), kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[rank] = np.arange(n)
    label = place.copy()
    while True:  # least label among the neighbours, until nothing changes
        least = np.where(link, label[None, :], n).min(axis=1) if n else label
        new = np.minimum(label, least)
        new = np.minimum(new, new[rank[new]])
        if (new == label).all():
            break
        label = new
    root = rank[label]
    return [(cids[i], int(degree[i]), cids[root[i]]) for i in np.where(degree)[0].tolist()]


def _verify_groups(threshold: float):
    """mapInArrow function over rows sorted by block."""
    def run(batches):
        key, rows = None, []

        def flush():
            if len(rows) < 2:
                return []
            return verify([r[0] for r in rows], np.stack([np.frombuffer(r[1], np.int64) for r in rows]),
                          [np.frombuffer(r[2], np.uint64) for r in rows],
                          np.array([r[3] for r in rows]), key[0], key[3] != key[4], threshold)

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.binary()))],
                names=LINKED.names)

        found = []
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for band, s1, s2, low, high, side, cid, bands, shingles in zip(
                    *(c[n].to_pylist() for n in ("band", "s1", "s2", "low", "high", "side", "cid", "bands"))
                    , c["shingles"]):
                here = (band, s1, s2, low, high)
                if here != key:
                    found += flush()
                    key, rows = here, []
                    if len(found) > 4096:
                        yield batch_of(found)
                        found = []
                rows.append((cid, bands, shingles.as_py(), side))
        found += flush()
        if found:
            yield batch_of(found)

    return run


# -- the join ------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(cid, root): the least node of each node's component, for edges (cid,
    root). Rounds of least neighbour label and pointer jumping; each is written,
    and one count per round goes to the driver."""
    both = written(edges.select("cid", "root").union(edges.select(F.col("root").alias("cid"),
                                                                  F.col("cid").alias("root"))), "edges")
    labels = written(both.groupBy("cid").agg(F.least(F.min("root"), F.first("cid")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("cid").alias("root"), "label"), "root") \
            .groupBy("cid").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "cid").select("cid", F.col("label").alias("old"),
                                                  F.least("label", "near").alias("label"))
        up = labels.select(F.col("cid").alias("label"), F.col("label").alias("up"))
        jumped = written(stepped.join(up, "label").select("cid", "old", F.least("label", "up").alias("label")),
                         "labels")
        labels = jumped.select("cid", "label")
        if not jumped.where("label != old").limit(1).count():
            return labels.withColumnRenamed("label", "root")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         recall: float = TARGET_RECALL, rows: int = ROWS, block_rows: int = BLOCK_ROWS,
         block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, cid (class key; NULL for a NULL text),
    class_id (least doc_id of the class), n_copies (its rows), n_links (other
    classes it is linked to) and group_id (least doc_id of all classes it is
    connected to by links, itself included)."""
    bands, rows = choose_bands(threshold, recall, rows)
    body = F.col(quoted(text)).cast("string")
    base = docs.select(F.col(quoted(doc_id)).alias("doc_id"), body.alias("text"),
                       F.unhex(F.md5(body.cast("binary"))).alias("cid"))
    signed = written(map_text(base, "text", KEYED, _signatures(bands, rows, False), ["doc_id", "cid"]), "signatures")
    classes = signed.where("cid is not null").groupBy("cid").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"),
        F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes, "classes")
    entries = classes.select("cid", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    buckets = entries.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("weight"),
        F.expr("bit_xor(xxhash64(cid))").alias("s1"),
        F.expr("sum(pmod(xxhash64(cid, 1), 2147483648L))").alias("s2")).where("m > 1")
    members = entries.select("cid", "band", "bucket").join(written(buckets, "buckets"), ["band", "bucket"]) \
        .groupBy("cid", "m", "weight", "s1", "s2").agg(F.min("band").alias("band"))
    members = written(members, "members")
    wanted = members.select("cid").distinct().join(classes.select("cid", "class_id"), "cid")
    texts = base.where("cid is not null").join(maybe_broadcast(wanted), "cid") \
        .where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("cid", "text")
    sets = map_text(texts, "text", SETS, _signatures(bands, rows, True), ["cid"]) \
        .groupBy("cid").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("weight") / block_shingles)).cast("int")
    dealt = members.withColumn("blocks", blocks) \
        .withColumn("mine", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("cid", "s1", "s2", "band", F.least("mine", "other").alias("low"),
                F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    key = ["band", "s1", "s2", "low", "high"]
    met = dealt.join(sets, "cid").repartition(*key).sortWithinPartitions(*key)
    linked = written(met.mapInArrow(_verify_groups(threshold), LINKED), "links")
    links = linked.groupBy("cid").agg(F.sum("n").alias("n_links"))
    group = components(linked.where("cid != root").select("cid", "root").distinct())
    ids = classes.select("cid", "class_id", "n_copies")
    least = written(group.join(ids, "cid").groupBy("root").agg(F.min("class_id").alias("group_id")), "groups")
    facts = ids.join(links, "cid", "left").join(group.join(maybe_broadcast(least), "root").select("cid", "group_id"), "cid", "left")
    return signed.select("doc_id", "cid").join(maybe_broadcast(written(facts, "facts")), "cid", "left").select(
        "doc_id", "cid", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.coalesce("group_id", "class_id")).alias("group_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` (all columns, unchanged) with one row of each group: the one of
    least doc_id (NULLs last; of rows repeated with that doc_id, the one of least
    row hash). Rows with a NULL text all stay."""
    found = join(docs, doc_id, text, **options)
    # a group is named by its least doc_id; classes without any doc_id by their key
    name = F.coalesce(F.col("group_id").cast("string"), F.hex("cid"))
    best = found.where("cid is not null").groupBy(name.alias("g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("cid"))).alias("best")) \
        .select(F.col("best.doc_id").alias("__id"), F.col("best.cid").alias("__cid"))
    cols = [F.col(quoted(c)) for c in docs.columns]
    plain = [F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(F.struct(*cols).alias("__row"), F.xxhash64(*plain).alias("__h"),
                       F.unhex(F.md5(F.col(quoted(text)).cast("binary"))).alias("__cid"),
                       F.col(quoted(doc_id)).alias("__id"))
    alone = rows.where("__cid is null").select("__row")
    one = rows.where("__cid is not null").groupBy("__cid", "__id").agg(F.min_by("__row", "__h").alias("__row"))
    kept = one.alias("a").join(best.alias("b"), (F.col("a.__cid") == F.col("b.__cid"))
                               & F.col("a.__id").eqNullSafe(F.col("b.__id")), "left_semi").select("__row")
    return kept.union(alone).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
