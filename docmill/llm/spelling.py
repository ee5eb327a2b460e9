"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. Bigrams are ordered by the number of words that hold them, rare first.
A word's *prefix* is its three rarest bigrams (and all others as rare as the last
of them); dynamic programming over their places chooses the word's *pivots*: two
disjoint bigrams of the prefix with the least summed frequency. One edit can't
touch both pivots, so of a near pair the word whose prefix ends at the rarer bigram
shares an untouched pivot with the other word's prefix. Position limits: an
untouched bigram stands at the same place in words of equal length, and at the same
place or one further in the longer word. Pivots are joined with prefixes on bigram,
place and length; pairs whose letters' parities allow one edit are verified by edit
distance.

Word counts are combined per task and again map-side. The bigrams of the alphabet
``[a-z\\u00C0-\\u00FF]`` are 8,100 at most, so their order is broadcast. Joins are
between written tables, so that AQE splits a frequent key. A form occurs at least
twice as often as its word, so chains to the root have at most 63 steps and
``ROUNDS`` doublings of the pointers reach every root.

Defined cases: NULL and empty texts have no words; repeated rows count each; a
document without doc_id is hashed with an empty id; words without a near word have
n_near 0, no form and themselves as root; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import quoted, slices, small_batches, written

MIN_LENGTH, MIN_COUNT, RATIO, ROUNDS = 5, 3, 2, 6
#: Code points up to which a word travels with its bigrams, so that its pairs are
#: verified inside the join; pairs with a longer word are verified after it.
CARRIED = 32
#: Distinct words that a task counts before it emits them.
HELD_WORDS = 200_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Lower-cases A-Z; other ASCII that isn't a letter becomes a space.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
#: Bytes of ASCII and of U+00C0 to U+00FF in UTF-8.
_PLAIN = bytes(range(0x80)) + b"\xc3" + bytes(range(0x80, 0xC0))


def runs(text: bytes | None) -> list[bytes]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF] with A-Z lower-cased, as UTF-8."""
    if not text:
        return []
    low = text.translate(_LETTERS)
    # without other characters the runs are what stands between spaces
    return low.split() if not low.translate(None, _PLAIN) and b"\xc2" not in low else _RUN.findall(low)


def slipped(run: bytes, doc_hash: int, every: int) -> bytes:
    """``run``, without one code point where ``every`` divides its hash in the document."""
    h = zlib.crc32(run, doc_hash)
    if h % every:
        return run
    s = run.decode("utf-8")
    at = h % len(s)
    return (s[:at] + s[at + 1:]).encode("utf-8")


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip_every: int | None = None,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``min_length`` code points and ``min_count``
    occurrences or more. With ``slip_every``, runs whose hash in their document it
    divides lose one code point first."""
    small_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("")).alias("d"),
                      F.col(quoted(text)).cast("binary").alias("t"))
    names = ["word", "n"]

    def emit(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                          names=names)

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            ids, body = batch.column(0), batch.column(1)
            for a, b in slices(body):
                for d, t in zip(ids.slice(a, b - a).to_pylist(), body.slice(a, b - a).to_pylist()):
                    own = Counter(runs(t))
                    seed = zlib.crc32(f"{d}:".encode())
                    for run, n in own.items():
                        if len(run) >= min_length:  # bytes; code points are counted below
                            counts[slipped(run, seed, slip_every) if slip_every else run] += n
                if len(counts) > HELD_WORDS:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    counted = src.mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count) \
        .select(F.col("word").cast("string").alias("word"), "n").where(F.length("word") >= min_length)


def gram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram's place in the order of (words that hold it, bigram)."""
    # at most 8,100 rows for words of the alphabet
    grams = words.select(F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))).alias("g"))
    rows = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    return {g: i for i, (_, g) in enumerate(sorted((r["n"], r["g"]) for r in rows))}


def pivots(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two disjoint bigrams of least summed cost of ``prefix`` = (place, cost).

    Over the places in order: the cheapest choice of one bigram so far, and the
    cheapest of two whose second ends the choice."""
    rows = sorted(prefix)
    one: list[int] = []  # the cheapest row up to each row
    best = None
    for j, (place, cost) in enumerate(rows):
        i = j - 1
        while i >= 0 and rows[i][0] > place - 2:
            i -= 1
        if i >= 0:
            first = rows[one[i]]
            if best is None or first[1] + cost < best[0]:
                best = first[1] + cost, first, rows[j]
        one.append(j if not one or cost < rows[one[-1]][1] else one[-1])
    return [best[1], best[2]]


def signature(word: str, order: dict[str, int]) -> tuple[list, list, int]:
    """(pivots, prefix, last) of a word: lists of (place, bigram number), and the
    number of the prefix' last bigram."""
    grams = [(order[word[i:i + 2]], i) for i in range(len(word) - 1)]
    last = sorted(grams)[2][0]
    prefix = [(i, g) for g, i in grams if g <= last]
    return pivots(prefix), prefix, last


_MASK = (1 << 24) - 1


def _key(gram: int, place: int, length: int) -> int:
    return gram << 48 | (place & _MASK) << 24 | length & _MASK


def probes(place: int, gram: int, length: int) -> list[int]:
    """Keys of the pivots that a prefix bigram may be, in words of its length, one
    code point shorter, and one longer."""
    return [_key(gram, place, length), _key(gram, place, length - 1), _key(gram, place - 1, length - 1),
            _key(gram, place, length + 1), _key(gram, place + 1, length + 1)]


def parity(word: str) -> int:
    """A bit per letter, set if it occurs an odd number of times (letters share 64
    bits by code point): near words differ in two bits at most."""
    mask = 0
    for c in word:
        mask ^= 1 << (ord(c) & 63)
    return mask - (1 << 64) if mask >> 63 else mask


def signatures(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(id, word, n, last, parity, pivot keys, prefix keys) per word, written."""
    known = words.sparkSession.sparkContext.broadcast(order)
    schema = T.StructType([words.schema["word"], words.schema["n"], T.StructField("last", T.IntegerType()),
                           T.StructField("parity", T.LongType()),
                           T.StructField("pivots", T.ArrayType(T.LongType())),
                           T.StructField("probes", T.ArrayType(T.LongType()))])

    def sign(batches):
        own = known.value
        for batch in batches:
            lasts, masks, pivot_keys, probe_keys = [], [], [], []
            for word in batch.column(0).to_pylist():
                chosen, prefix, last = signature(word, own)
                lasts.append(last)
                masks.append(parity(word))
                pivot_keys.append(sorted({_key(g, i, len(word)) for i, g in chosen}))
                probe_keys.append(sorted({k for i, g in prefix for k in probes(i, g, len(word))}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lasts, pa.int32()), pa.array(masks, pa.int64()),
                 pa.array(pivot_keys, pa.list_(pa.int64())), pa.array(probe_keys, pa.list_(pa.int64()))],
                names=schema.names)

    signed = words.select("word", "n").mapInArrow(sign, schema)
    return written(signed.select(F.monotonically_increasing_id().alias("id"), "*"), "grams")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all near pairs of the words(word, n), each once."""
    table = signatures(words, gram_order(words))

    def side(keys: str, end: str) -> DataFrame:
        # long words have many bigrams, so they stay behind
        return table.select(F.explode(keys).alias(f"key_{end}"), F.col("id").alias(f"id_{end}"),
                            F.col("last").alias(f"last_{end}"), F.col("parity").alias(f"parity_{end}"),
                            F.when(F.length("word") <= CARRIED, F.col("word")).alias(f"word_{end}"))

    alike = (F.bit_count(F.col("parity_u").bitwiseXOR(F.col("parity_v"))) <= 2) \
        & F.coalesce(F.levenshtein("word_u", "word_v", 1) == 1, F.lit(True))
    found = side("pivots", "u").join(side("probes", "v"), (F.col("key_u") == F.col("key_v"))
                                     & (F.col("last_u") <= F.col("last_v")) & (F.col("id_u") != F.col("id_v")) & alike)
    pairs = written(found.select(F.least("id_u", "id_v").alias("id_a"), F.greatest("id_u", "id_v").alias("id_b")).distinct(),
                    "candidates")

    def named(end: str) -> DataFrame:
        return table.select(F.col("id").alias(f"id_{end}"), F.col("word").alias(end), F.col("n").alias(f"n_{end}"))

    return pairs.join(named("a"), "id_a").join(named("b"), "id_b").where(F.levenshtein("a", "b", 1) == 1) \
        .select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): pointers doubled until none moves."""
    pointers = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        onward = pointers.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = written(pointers.join(onward, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        pointers = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            break
    return pointers


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the words(word, n).

    ``form`` is the near word of largest n (the first by code points among equals)
    if that n is ``ratio`` times the word's or more; ``root`` ends the chain of forms."""
    words = written(words, "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("w"), F.col("n_a").alias("n"), F.col("b").alias("o"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("w"), F.col("n_b").alias("n"), F.col("a").alias("o"), F.col("n_a").alias("m"))
    )).alias("l")).select("l.*")
    near = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"),
                                 F.min(F.struct((-F.col("m")).alias("m"), F.col("o"))).alias("best"))
    near = written(near.select("w", "n_near", F.col("best.o").alias("form"), (-F.col("best.m")).alias("form_n")), "near")
    joined = words.join(near, F.col("word") == F.col("w"), "left")
    able = F.col("form_n") >= ratio * F.col("n")
    linked = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                   F.when(able, F.col("form")).alias("form"), F.when(able, F.col("form_n")).alias("form_n")),
                     "linked")
    roots = _roots(linked.where("form is not null")).select(F.col("word").alias("r"), "root")
    return linked.join(roots, F.col("word") == F.col("r"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
