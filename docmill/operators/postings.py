"""Lexical cosine top-k from a block-max inverted index; queries and chunks are
both tables, and nothing passes through the driver.

:func:`lexical_index` writes two tables:

* *vectors*: every chunk with letters under a running number, with its keys,
  carried columns, distinct terms, their counts and the squared norm;
* *blocks*: the postings of each term, cut by impact (count / norm, in steps of
  1 / ``LEVELS``) and by runs of ``ZONE`` chunk numbers, each block with its largest
  impact. A block has ``ZONE`` postings at most, however frequent the term. Blocks are
  cut where the vectors are, without a shuffle.

:func:`search` answers a query table in two rounds. First each distinct bag of
query terms is scored against a few postings of its rarest and its heaviest terms,
those of largest impact; the k-th best of them bounds the final k-th from below.
With that threshold the most frequent terms drop out as long as their norm is small
against it (Cauchy-Schwarz), of the other terms only blocks are read whose largest
impact allows the threshold, and the sums of what was read plus a bound of the rest
drop most candidates. The blocks are dealt out by zone, so a chunk's sums are complete
in one task and (query, chunk) pairs are not shuffled before the bound has dropped
most. What is left, a small part of chunks x queries, is scored exactly from the vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.functions.text import is_blank, tokens
from docmill.functions.vectors import count_tokens
from docmill.sources.scratch import written

LEVELS, ZONE = 16, 4096
#: First round: rarest and heaviest terms per query, blocks per term, postings per block.
SEED_TERMS, SEED_HEAVY, SEED_BLOCKS, SEED_POSTINGS = 8, 4, 8, 8
#: Room for distances rounded to six decimals and for sums of doubles.
SLACK = 1e-6


#: Share of the threshold that the unread terms' norm may take.
UNREAD = 0.25


def bags(df: DataFrame, tokens_col: str = "_t") -> DataFrame:
    """``df`` with its token lists counted: terms (distinct), tfs and norm2."""
    others = [c for c in df.columns if c != tokens_col]
    schema = T.StructType([df.schema[c] for c in others] + [
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType())),
        T.StructField("norm2", T.LongType())])

    def run(batches):
        for batch in batches:
            yield count_tokens(batch, tokens_col, others)

    return df.select(*others, tokens_col).mapInArrow(run, schema)


class LexicalIndex:
    """The written tables of :func:`lexical_index`, the chunk keys and carried columns."""

    def __init__(self, vectors: DataFrame, blocks: DataFrame, keys: list[str], carry: list[str]):
        self.vectors, self.blocks, self.keys, self.carry = vectors, blocks, keys, carry


def lexical_index(chunks: DataFrame, c_keys: Sequence[str] = ("doc_id", "chunk_index"), c_text: str = "text",
                  carry: Sequence[str] = ()) -> LexicalIndex:
    """Index ``chunks`` by the lower-cased letter runs of ``c_text``."""
    keys = list(c_keys)
    extra = [c for c in carry if c not in keys]
    cut = chunks.select(*[F.col(c).alias(f"k_{c}") for c in keys], *[F.col(c).alias(f"x_{c}") for c in extra],
                        tokens(c_text).alias("_t")).where(F.size("_t") > 0)
    vectors = written(bags(cut).select(F.monotonically_increasing_id().alias("cid"), "*"), "vectors")
    blocks = vectors.select("cid", "terms", "tfs", "norm2").mapInArrow(_cut(LEVELS, ZONE), BLOCK_SCHEMA)
    return LexicalIndex(vectors, written(blocks, "blocks"), keys, extra)


#: Postings are three lists of equal length.
BLOCK_SCHEMA = ("zone long, term string, level long, n long, top double, "
                "postings array<long>, tfs array<long>, norms array<long>")


def _cut(levels: int, zone: int):
    """mapInArrow function: the blocks of each batch of vectors. Chunk numbers run on in a
    batch, so a zone's blocks are cut once (a zone at a batch's end in two)."""
    def run(batches):
        for batch in batches:
            terms = batch.column("terms")
            row = pc.list_parent_indices(terms).to_numpy().astype(np.int64)
            if not len(row):
                continue
            enc = pc.dictionary_encode(terms.flatten())
            cid, norm2 = (batch.column(c).to_numpy()[row] for c in ("cid", "norm2"))
            tf = batch.column("tfs").flatten().to_numpy()
            impact = tf / np.sqrt(norm2.astype(np.float64))
            keys = [cid // zone, enc.indices.to_numpy().astype(np.int64), np.floor(impact * levels).astype(np.int64)]
            order = np.lexsort([cid, *reversed(keys)])
            at, code, level = (k[order] for k in keys)
            new = (np.diff(at) != 0) | (np.diff(code) != 0) | (np.diff(level) != 0)
            starts = np.r_[0, np.flatnonzero(new) + 1]
            ends = np.r_[starts, len(order)]
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[starts]), enc.dictionary.take(pa.array(code[starts])), pa.array(level[starts]),
                 pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(impact[order], starts)),
                 *[pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (cid, tf, norm2)]],
                names=["zone", "term", "level", "n", "top", "postings", "tfs", "norms"])

    return run


def asked_bags(queries: DataFrame, q_keys: Sequence[str], q_text: str) -> tuple[DataFrame, DataFrame]:
    """(q_keys..., qid) and (qid, terms, tfs, norm2): each distinct bag of query
    terms once. Rows with one key are one query; blank ones are none."""
    named, asked = distinct_bags(queries, q_keys, q_text)
    return named, written(bags(asked), "bags")


def distinct_bags(queries: DataFrame, q_keys: Sequence[str], q_text: str) -> tuple[DataFrame, DataFrame]:
    """(q_keys..., qid) and (qid, _t): each distinct list of sorted query tokens once."""
    keys = list(q_keys)
    cut = queries.where(~is_blank(q_text)).select(*[F.col(c).alias(f"q_{c}") for c in keys], tokens(q_text).alias("_t")) \
        .where(F.size("_t") > 0)
    # tokens in order, so that equal bags are equal rows
    whole = cut.groupBy(*[f"q_{c}" for c in keys]).agg(F.array_sort(F.flatten(F.collect_list("_t"))).alias("_t"))
    whole = written(whole, "queries")
    asked = written(whole.select("_t").distinct().select(F.monotonically_increasing_id().alias("qid"), "_t"), "asked")
    return whole.join(asked, "_t").drop("_t"), asked


def scored(pairs: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, cid, k_..., distance) of written (qid, cid) pairs: exact, rounded to six
    decimals."""
    q = asked.select("qid", F.col("terms").alias("_qt"), F.col("tfs").alias("_qf"), F.col("norm2").alias("_qn"))
    c = vectors.select("cid", *[c for c in vectors.columns if c.startswith("k_")], "terms", "tfs", "norm2")
    both = c.join(maybe_broadcast(pairs), "cid").join(maybe_broadcast(q), "qid")
    dot = F.aggregate(F.array_intersect("_qt", "terms"), F.lit(0).cast("long"), lambda acc, t: acc
                      + F.get("_qf", F.array_position("_qt", t) - 1) * F.get("tfs", F.array_position("terms", t) - 1))
    distance = F.lit(1.0) - dot / (F.sqrt(F.col("_qn").cast("double")) * F.sqrt(F.col("norm2").cast("double")))
    return both.select("qid", "cid", *[c for c in vectors.columns if c.startswith("k_")],
                       F.round(distance, 6).alias("distance"))


def _nearest(rows: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", *[f"k_{c}" for c in index.keys])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_terms(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """(qid, q_norm2, term, q_tf, w, df): the query terms that the chunks hold, with
    their share of the query's norm and the number of chunks."""
    terms = asked.select("qid", F.col("norm2").alias("q_norm2"), F.inline(F.arrays_zip("terms", "tfs")).alias("term", "q_tf")) \
        .withColumn("w", F.col("q_tf") / F.sqrt(F.col("q_norm2").cast("double")))
    df = index.blocks.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi") \
        .groupBy("term").agg(F.sum("n").alias("df"))
    return written(terms.join(df, "term"), "terms")


def thresholds(weighted: DataFrame, asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """(qid, least): a similarity that the k-th best chunk of the query reaches;
    queries with fewer than k seeds have none."""
    rare, heavy = (Window.partitionBy("qid").orderBy(*o) for o in (("df", "term"), (F.col("w").desc(), "term")))
    seeds_of = weighted.withColumn("_r", F.row_number().over(rare)).withColumn("_h", F.row_number().over(heavy)) \
        .where((F.col("_r") <= SEED_TERMS) | (F.col("_h") <= SEED_HEAVY)).select("qid", "term")
    best = Window.partitionBy("term").orderBy(F.col("top").desc(), "zone")
    first = index.blocks.select("term", "top", "zone", F.slice("postings", 1, SEED_POSTINGS).alias("cids"))
    seeds = first.join(maybe_broadcast(weighted.select("term").distinct()), "term", "left_semi") \
        .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= SEED_BLOCKS) \
        .select("term", F.explode("cids").alias("cid"))
    pairs = written(seeds_of.join(seeds, "term").select("qid", "cid").distinct(), "seeds")
    reached = _nearest(scored(pairs, asked, index.vectors), index, k).where(F.col("rank") == k)
    return written(reached.select("qid", (1 - F.col("distance") - SLACK).alias("least")), "least")


def wanted_terms(weighted: DataFrame, least: DataFrame) -> DataFrame:
    """``weighted`` less the most frequent terms of each query as long as their norm
    is below ``UNREAD`` of its threshold, plus least and rest (that norm)."""
    frequent = Window.partitionBy("qid").orderBy(F.col("df").desc(), "term")
    known = weighted.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    upto = F.sqrt(F.sum(F.col("w") * F.col("w")).over(frequent.rowsBetween(Window.unboundedPreceding, 0)))
    cut = known.withColumn("_upto", upto).withColumn("_unread", F.col("_upto") < UNREAD * F.col("least"))
    rest = F.max(F.when(F.col("_unread"), F.col("_upto")).otherwise(0.0)).over(Window.partitionBy("qid"))
    return cut.withColumn("rest", rest).where(~F.col("_unread")).drop("_upto", "_unread")


def read_postings(wanted: DataFrame, index: LexicalIndex) -> DataFrame:
    """(qid, cid, norm2, dot, used) of the wanted terms' blocks: exact sums over those
    terms, made where the blocks of a zone are. ``wanted`` is a written table."""
    # x of a term caps the cosine at cos(angle(w) - angle(x)), which rises until x = w
    cap = F.col("w") * F.col("top") + F.sqrt(1 - F.col("w") * F.col("w")) * F.sqrt(1 - F.col("top") * F.col("top"))
    asked = index.blocks.select("zone", "term", "top", "postings", "tfs", "norms") \
        .join(maybe_broadcast(wanted.select("term").distinct()), "term", "left_semi").repartition("zone")
    read = asked.join(maybe_broadcast(wanted.select("qid", "term", "q_tf", "w", "least")), "term") \
        .where((F.col("top") >= F.col("w")) | F.isnan(cap) | (cap >= F.col("least") - SLACK))
    hits = read.select("zone", "qid", "q_tf", F.inline(F.arrays_zip("postings", "tfs", "norms")).alias("cid", "tf", "norm2"))
    return hits.groupBy("zone", "qid", "cid").agg(
        F.max("norm2").alias("norm2"), F.sum(F.col("q_tf") * F.col("tf")).alias("dot"),
        F.sum(F.col("tf") * F.col("tf")).alias("used"))


def candidate_pairs(wanted: DataFrame, index: LexicalIndex) -> DataFrame:
    """(qid, cid) that may reach their query's threshold: their sums plus a bound of the
    unread terms, which is the product of the norms left on either side."""
    wanted = written(wanted, "wanted")
    limits = wanted.select("qid", "q_norm2", "least", "rest").distinct()
    part = read_postings(wanted, index).join(maybe_broadcast(limits), "qid")
    bound = F.col("dot") / (F.sqrt(F.col("q_norm2").cast("double")) * F.sqrt(F.col("norm2").cast("double"))) \
        + F.col("rest") * F.sqrt(1 - F.col("used") / F.col("norm2") + SLACK)
    return part.where(bound >= F.col("least") - SLACK).select("qid", "cid")


def search(queries: DataFrame, index: LexicalIndex, k: int, q_keys: Sequence[str], q_text: str = "text") -> DataFrame:
    """q_keys..., c_keys..., carried columns, distance, rank of each query's k
    nearest chunks, ties by (rounded distance, chunk keys). Queries without terms in
    the index have no rows; NULL keys are keys."""
    named, asked = asked_bags(queries, q_keys, q_text)
    weighted = weighted_terms(asked, index)
    wanted = wanted_terms(weighted, thresholds(weighted, asked, index, k))
    pairs = written(candidate_pairs(wanted, index), "pairs")
    found = _nearest(scored(pairs, asked, index.vectors), index, k)
    if index.carry:
        found = index.vectors.select("cid", *[f"x_{c}" for c in index.carry]) \
            .join(maybe_broadcast(written(found, "found")), "cid")
    return named.join(found, "qid").select(
        *[F.col(f"q_{c}").alias(c) for c in q_keys], *[F.col(f"k_{c}").alias(c) for c in index.keys],
        *[F.col(f"x_{c}").alias(c) for c in index.carry], "distance", "rank")
