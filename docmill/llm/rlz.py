"""Substring dedup by relative Lempel-Ziv parsing against an indexed reference.

The reference is the whole corpus, cut into *blocks* by content: every window of
``WINDOW`` words picks its least-hashed ``SEED`` words as anchor, and a block is a
longest stretch of consecutive windows with one anchor. Equal windows pick equal
anchors wherever they stand, so a factor of a window or more that matches a
reference block lies in a block of the document with the same seed, at the same
place from the anchor:

1. One pass hashes each document's blocks: (seed hash of the anchor, hash of the
   block's words, place). A block found twice inside a document is known to repeat
   at once and counted once.
2. The index groups blocks by seed with map-side combining. A seed found once has
   nothing to match. If all blocks of a seed are equal, or a block is found
   elsewhere as it is, the longest match from any of its windows runs to its end.
3. The other blocks are where factors begin or end. Each *distinct* one meets every
   block of its seed: first window by window (seed and window hash), then, for
   windows that repeat side by side, by pairs of first and last window. Both windows
   hold the anchor's words, so blocks that share the pair share all words from the
   one to the other. That gives, for each window, the longest match in one reference
   block, for all places of the block at once.
4. Each document is then parsed from its first word on: at each place the longest
   match with a reference block is taken as a factor, or, where no window repeats,
   the word stays literal. Factors name their block and place, so a document is
   its literals and copies from the reference.
5. Windows across the border of a factor are checked, too (a shorter match with
   another block may reach over it). Every word that a factor or such a window
   covers is a duplicate and removed.

Factors shorter than a window are literals and stay. Equality is by 128 bits
(seed and block or window hash). Only hashes travel, except for the texts'
exchange by row key. Frequent seeds, blocks and windows are combined before they
are shuffled; what they are joined to is written first, so both sides of each
join are plain exchanges that AQE's skew join can split. Nothing gathers a
seed's places in one task; a block has at most ``WINDOW - SEED + 1`` windows.

Defined cases: NULL and empty texts have no words; texts under ``WINDOW`` words
lose nothing; rows repeated with an equal key are occurrences each; overlapping
occurrences inside one text count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import Rolling, carried, map_text, plain_words, quoted, slices, word_hashes, written

WINDOW, SEED = 35, 8

_BLOCK = T.StructType([T.StructField("seed", T.LongType()), T.StructField("block", T.LongType()),
                       T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()),
                       T.StructField("ap", T.IntegerType()), T.StructField("times", T.IntegerType())])
PARSED = [T.StructField("blocks", T.ArrayType(_BLOCK)), T.StructField("own", T.BooleanType())]
#: A factor's first word, its words, and its source: the reference block (seed,
#: block) and the place of its first word there, counted from the block's anchor.
FACTOR = T.StructType([T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
                       T.StructField("seed", T.LongType()), T.StructField("block", T.LongType()),
                       T.StructField("shift", T.LongType())])


def anchors(seeds: np.ndarray, span: int) -> np.ndarray:
    """Place of the least seed hash among ``span`` consecutive ones, for each
    start; the leftmost of equal ones."""
    least = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _listed(values: dict[str, np.ndarray], struct: T.StructType, doc: np.ndarray, docs: int) -> pa.Array:
    """Arrow list-of-struct array from columns sorted by document."""
    from pyspark.sql.pandas.types import to_arrow_type
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in struct.fields]
    rows = pa.StructArray.from_arrays([pa.array(values[f.name], f.type) for f in fields], fields=fields)
    offsets = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def cut_blocks(words: list[list[bytes]], window: int, seed: int) -> dict[str, np.ndarray]:
    """All blocks of the documents, sorted by document, block and place: document,
    ``at`` (first word), ``n`` (windows), ``ap`` (the anchor from ``at``), seed and
    block hash, ``first`` (whether the block's first one in its document) and
    ``times`` (how often the document has it)."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    n, docs = int(counts.sum()), len(words)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return {c: none for c in ("doc", "at", "n", "ap", "seed", "block", "times")} | {"first": none > 0}
    rolled = Rolling(word_hashes(w for ws in words for w in ws))
    seeds = rolled.windows(seed)
    anchor = anchors(seeds, window - seed + 1)
    doc = np.repeat(np.arange(docs), counts)
    base = np.cumsum(counts) - counts
    starts = np.where(doc[:n - window + 1] == doc[window - 1:])[0]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) > 1) | (anchor[starts[1:]] != anchor[starts[:-1]])
    at = starts[new]
    size = np.diff(np.append(np.where(new)[0], len(starts)))
    block = rolled(at, size + window - 1)
    order = np.lexsort((at, block, doc[at]))
    at, size, block = at[order], size[order], block[order]
    owner = doc[at]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
    group = np.cumsum(first) - 1
    times = np.bincount(group)[group] if len(group) else none
    return {"doc": owner, "at": at - base[owner], "n": size, "ap": anchor[at] - at, "times": times,
            "seed": seeds[anchor[at]].view(np.int64), "block": block.view(np.int64), "first": first}


def parse(words: list[list[bytes]], window: int, seed: int):
    """Blocks of each document (distinct ones; ``times`` is 2 for one found more
    than once), and whether one of them repeats inside it."""
    docs, found = len(words), cut_blocks(words, window, seed)
    one = {c: v[found["first"]] for c, v in found.items()}
    own = np.zeros(docs, dtype=bool)
    own[one["doc"][one["times"] > 1]] = True
    return (_listed({f.name: np.minimum(one[f.name], 2) if f.name == "times" else one[f.name]
                     for f in _BLOCK.fields}, _BLOCK, one["doc"], docs), pa.array(own))


def _window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """(seed, block, times, windows) for rows (text, todo: seed, block, at, n,
    times): the hash of each window of each block to check."""
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("block", T.LongType()),
                           T.StructField("times", T.LongType()), T.StructField("windows", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for text, todo in zip(batch.column(0), batch.column(1)):
                h, out = word_hashes(plain_words(text.as_py())), []
                for t in todo.as_py():
                    part = Rolling(h[t["at"]:t["at"] + t["n"] + window - 1])
                    out.append((t["seed"], t["block"], t["times"], part.windows(window).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], f.type) for i, f in enumerate(
                        [pa.field("", pa.int64())] * 3)] + [pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                    names=schema.names)

    return rows.select(F.col("text").cast("binary"), "todo").mapInArrow(run, schema)


class Places:
    """Where one document's repeating windows are: its blocks that match, sorted by
    place, each with its windows' ``reach``: (window, last window of the longest
    match, source block), or None where every window matches to the block's end."""

    def __init__(self, hits: list[dict], words: list[bytes], window: int, seed: int):
        self.window = window
        rows = {h["at"]: (h["n"], h["ap"], h["seed"], h["block"], h["reach"]) for h in hits if h["at"] >= 0}
        if any(h["at"] < 0 for h in hits):
            found = cut_blocks([words], window, seed)
            again = found["times"] > 1
            rows.update((at, (n, ap, s, b, None)) for at, n, ap, s, b in zip(
                *[found[c][again].tolist() for c in ("at", "n", "ap", "seed", "block")]))
        self.at = np.array(sorted(rows), dtype=np.int64)
        self.rows = [rows[a] for a in self.at.tolist()]

    def factors(self) -> list[tuple]:
        """The greedy parse: from the first word on, the longest match with a
        reference block that starts there, else a literal word. A block is shorter
        than two windows, so at most one factor starts in it."""
        out, p, k = [], 0, 0
        while k < len(self.rows):
            at, (n, ap, seed, block, reach) = int(self.at[k]), self.rows[k]
            i, hit = max(p - at, 0), None
            if reach is None:
                hit = (i, n - 1, block) if i < n else None
            else:
                hit = next(((r["i"], r["j"], r["src"]) for r in reach if r["i"] >= i), None)
            k += 1
            if hit:
                i, j, source = hit
                out.append((at + i, j - i + self.window, seed, source, i - ap))
                p = at + j + self.window
                k = max(k, int(np.searchsorted(self.at, p, side="right")) - 1)
        return out

    def covered(self, n: int, factors: list[tuple]) -> np.ndarray:
        """Which of ``n`` words a factor covers, or a repeating window across the
        border of one."""
        edge = np.zeros(n + 1, dtype=np.int64)
        for at, size, *_ in factors:
            edge[at] += 1
            edge[at + size] -= 1
        for at, (size, _, _, _, reach) in zip(self.at.tolist(), self.rows):
            if reach is None:
                edge[at] += 1
                edge[at + size + self.window - 1] -= 1
            else:
                for r in reach:
                    edge[at + r["i"]] += 1
                    edge[at + r["i"] + self.window] -= 1
        return np.cumsum(edge[:-1]) > 0


def _cut(rows: DataFrame, keep: list[str], window: int, seed: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    listed = T.ArrayType(FACTOR)
    schema = T.StructType([rows.schema[c] for c in keep] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("factors", listed),
        T.StructField("kept", T.StringType())])

    def run(batches):
        for batch in batches:
            texts, places = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                total, gone, spans, copies, kept = [], [], [], [], []
                for text, hits in zip(texts.slice(a, b - a).to_pylist(), places.slice(a, b - a)):
                    words = plain_words(text)
                    total.append(len(words))
                    hits = hits.as_py()
                    if not hits:
                        gone.append(0)
                        spans.append([])
                        copies.append([])
                        kept.append(b" ".join(words).decode("utf-8"))
                        continue
                    found = Places(hits, words, window, seed)
                    parsed = found.factors()
                    out = found.covered(len(words), parsed)
                    steps = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
                    gone.append(int(out.sum()))
                    spans.append(np.stack([np.where(steps == 1)[0], np.where(steps == -1)[0]], axis=1).tolist())
                    copies.append([dict(zip(FACTOR.names, f)) for f in parsed])
                    kept.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o]).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                    + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                       pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(copies, to_arrow_type(listed)),
                       pa.array(kept, pa.string())],
                    names=schema.names)

    return rows.select(*[F.col(quoted(c)) for c in keep], F.col("text").cast("binary"), "places") \
        .mapInArrow(run, schema)


def reference(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The reference that factors copy from: (seed, block, doc_id, anchor), one
    place of each distinct block; a factor's words stand in that document from word
    anchor + shift on. ``doc_id`` must tell texts apart."""
    def make():
        return lambda texts: parse([plain_words(t) for t in texts], window, seed)

    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    blocks = map_text(rows, "text", PARSED, make, ["doc_id"]).select("doc_id", F.explode("blocks").alias("b"))
    return blocks.groupBy("b.seed", "b.block").agg(
        F.min(F.struct("doc_id", (F.col("b.at") + F.col("b.ap")).alias("anchor"))).alias("p")) \
        .select("seed", "block", "p.doc_id", "p.anchor")


#: Of windows ``ws`` (i, w, low, high) of a block: another block that both x and y name.
_COMMON = """case when x.low <> block and x.low in (y.low, y.high) then x.low
                  when x.high <> block and x.high in (y.low, y.high) then x.high end"""
#: For each window the last one of a match that the named blocks prove, its block,
#: and the last window up to which all windows repeat.
_NAMED = f"""transform(ws, (x, k) -> struct(x.i as i,
    array_max(transform(filter(ws, y -> y.i >= x.i and ({_COMMON}) is not null),
                        y -> struct(y.i as j, {_COMMON} as src))) as best,
    array_max(transform(filter(ws, (y, m) -> m >= k and y.i - x.i = m - k), y -> y.i)) as last))"""
#: Pairs of windows i < j between which every window repeats.
_PAIRS = """flatten(transform(ws, (x, k) -> transform(
    filter(ws, (y, m) -> m > k and y.i - x.i = m - k), y -> struct(x.i as i, y.i as j, xxhash64(x.w, y.w) as w))))"""


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (seed, block, times, w, ...) whose w is found elsewhere, with the least
    and the greatest hash of a block that has it."""
    found = rows.groupBy("seed", "w").agg(F.sum("times").alias("all"), F.min("block").alias("low"),
                                          F.max("block").alias("high")).where("all > 1").drop("all")
    return rows.join(written(found, "shared"), ["seed", "w"])


def _reaches(checks: DataFrame) -> DataFrame:
    """(seed, block, reach) of blocks (seed, block, times, windows: a hash each) that
    match: for each window that another block of the seed has, too, the last window
    of the longest match with one such block, and that block. NULL for blocks that
    are found elsewhere as they are.

    The least and the greatest block that have a window are known from the first
    join. If two windows of a block name one other block, it has all between them;
    where that reaches as far as windows repeat at all, nothing can be longer. Only
    seeds with a block where it doesn't are joined on pairs of windows."""
    one = checks.select("seed", "block", "times", F.posexplode("windows").alias("i", "w"))
    known = written(_shared(one).groupBy("seed", "block").agg(
        F.first("times").alias("times"), F.sort_array(F.collect_list(F.struct("i", "w", "low", "high"))).alias("ws"))
        .withColumn("named", F.expr(_NAMED))
        .withColumn("open", F.expr("times = 1 and exists(named, x -> x.best.j < x.last)")), "known")
    listed = F.expr("transform(named, x -> struct(x.i as i, x.best.j as j, x.best.src as src))")
    done = known.where("not open").select("seed", "block", F.when(F.col("times") == 1, listed).alias("reach"))
    seeds = written(known.where("open").select("seed").distinct(), "open")
    pairs = known.join(seeds, "seed", "left_semi").select("seed", "block", "times", "open", F.explode(F.expr(_PAIRS)).alias("p")) \
        .select("seed", "block", "times", "open", "p.*")
    other = F.when(F.col("low") != F.col("block"), F.col("low")).otherwise(F.col("high"))
    best = known.where("open").select("seed", "block", F.explode(listed).alias("r")).select("seed", "block", "r.*") \
        .unionByName(_shared(pairs).where("open").select("seed", "block", "i", "j", other.alias("src"))) \
        .groupBy("seed", "block", "i").agg(F.max("j").alias("j"), F.max_by("src", "j").alias("src"))
    return done.unionByName(best.groupBy("seed", "block").agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "src"))).alias("reach")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``keep`` columns (default: all but those named like an output) plus
    n_words, n_removed, removed (word ranges [start, end)), factors (the greedy
    parse, see ``FACTOR``; words between factors are literals) and kept (the words
    left, joined by one space)."""
    if not (seed < window <= seed + 30 and seed > 0):
        raise ValueError("a block's windows must fit a 31-bit mask")
    keep = carried(docs, ["n_words", "n_removed", "removed", "factors", "kept"]) if keep is None else keep
    body = F.col(quoted(text)).cast("string")
    key = [F.xxhash64(F.col(quoted(doc_id)), body).alias("k1"),
           F.hash(F.lit(7), body, F.col(quoted(doc_id))).alias("k2")]  # 96 bits together
    rows = docs.select(*key, F.struct(F.lit(0), *[F.col(quoted(c)) for c in keep]).alias("doc"), body.alias("text"))

    def make():
        return lambda texts: parse([plain_words(t) for t in texts], window, seed)

    parsed = written(map_text(docs.select(*key, body.alias("text")), "text", PARSED, make, ["k1", "k2"]), "blocks")
    blocks = parsed.select("k1", "k2", F.explode("blocks").alias("b")).select("k1", "k2", "b.*")
    index = blocks.groupBy("seed").agg(F.sum("times").alias("times"), F.min("block").alias("low"),
                                       F.max("block").alias("high")).where("times > 1") \
        .select("seed", (F.col("low") != F.col("high")).alias("differ"))
    met = written(blocks.join(written(index, "index"), "seed"), "met")
    # one place of each distinct block at a factor's border, and all its occurrences
    border = met.where("differ").groupBy("seed", "block").agg(
        F.sum("times").alias("times"), F.min(F.struct("k1", "k2", "at", "n")).alias("p"))
    todo = border.groupBy("p.k1", "p.k2").agg(F.collect_list(
        F.struct("seed", "block", "p.at", "p.n", "times")).alias("todo"))
    one_text = rows.join(maybe_broadcast(written(todo, "todo")), ["k1", "k2"]).select("k1", "k2", "text", "todo")
    checks = written(_window_hashes(one_text, window).groupBy("seed", "block").agg(
        F.first("times").alias("times"), F.first("windows").alias("windows")), "checks")
    reach = written(_reaches(checks), "reach")
    place = ["k1", "k2", "at", "n", "ap", "seed", "block"]
    whole = F.lit(None).cast(reach.schema["reach"].dataType).alias("reach")
    inside = met.where("not differ").select(*place, whole)
    at_border = met.where("differ").join(reach, ["seed", "block"]).select(*place, "reach")
    # documents that repeat a block inside are cut into blocks again
    own = parsed.where("own").select("k1", "k2", F.lit(-1).alias("at"), *[F.lit(0).alias(c) for c in ("n", "ap")],
                                     *[F.lit(0).cast("long").alias(c) for c in ("seed", "block")], whole)
    places = inside.unionByName(at_border).unionByName(own).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("at", "n", "ap", "seed", "block", "reach")).alias("places"))
    found = rows.join(places, ["k1", "k2"], "left")
    cut = _cut(found.select("doc", "text", "places"), ["doc"], window, seed)
    return cut.select(*[F.col("doc").getField(c).alias(c) for c in keep],
                      "n_words", "n_removed", "removed", "factors", "kept")
