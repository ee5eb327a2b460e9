"""Token-id files with directly addressable codes.

File format. A store is a folder of uncompressed Parquet files, one per range of
the document order, whose rows are *segments*: part (range), seg (segment in the
range), n_tokens, doc_ids, doc_ends (exclusive end of each document, counted
from the segment's first token) and block. A block holds the segment's ids,
little-endian:

    "DAC1", levels u32, n_tokens u64, then per level: entries u64,
    the level's 8-bit chunk of every entry,
    and for all but the last level: continuation bitmap (bit i of the level at
    bit i % 8 of byte i // 8) and rank directory (u32 per 512 bits: set bits
    before them)

Level 0 has the low 8 bits of every id; entries with a set continuation bit go
on in the next level at the place that rank(bit) gives. So token i is read by
one step per level, without decoding anything else; 16-bit vocabularies need two
levels. The container is written and read by Spark, so any store Spark reaches
works, and a lost executor's files are written again by its task.

Documents stand in ascending doc_id order (NULL first; equal doc_ids in scan
order). NULL and empty texts have only the end id. A
document is never split over segments. Repeated rows are kept as they are.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import Memory, per_worker, quoted, slices, small_batches

SEGMENT_TOKENS, SEGMENT_DOCS = 1 << 20, 4096
DIRECTORY_BITS = 512
#: Remembered words per worker (up to twice as many).
REMEMBER = 700_000

SEGMENT = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("seg", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_ends", T.ArrayType(T.LongType())),
    T.StructField("block", T.BinaryType())])


# -- the code ----------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """A block of unsigned 32-bit ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = 1
    while levels < 4 and len(rest) and int(rest.max()) >> (8 * levels):
        levels += 1
    out = [b"DAC1", np.uint32(levels).tobytes(), np.uint64(len(rest)).tobytes()]
    for level in range(levels):
        out += [np.uint64(len(rest)).tobytes(), (rest & 255).astype(np.uint8).tobytes()]
        if level < levels - 1:
            rest = rest >> np.uint32(8)
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            before = np.zeros(len(rest) // DIRECTORY_BITS + 1, dtype=np.uint32)
            counts = np.add.reduceat(more, np.arange(0, len(rest), DIRECTORY_BITS)) if len(rest) else []
            before[1:] = np.cumsum(counts)[:len(before) - 1]
            out += [bits.tobytes(), before.tobytes()]
            rest = rest[more]
    return b"".join(out)


class Block:
    """Read access to a block."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a block of token ids")
        levels, self.n = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0])
        at, self.levels = 16, []
        for level in range(levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            if level < levels - 1:
                bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                before = np.frombuffer(data, "<u4", n // DIRECTORY_BITS + 1, at)
                at += before.nbytes
                self.levels.append((chunk, bits, before))
            else:
                self.levels.append((chunk, None, None))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Token i by one chunk, one bit and one rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunk, bits, before) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            first = i // DIRECTORY_BITS
            inside = bits[first * (DIRECTORY_BITS // 8):i >> 3]
            i = int(before[first]) + int(np.bitwise_count(inside).sum()) \
                + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, vectorised over each level."""
        value = None
        for level in range(len(self.levels) - 1, -1, -1):
            chunk, bits, _ = self.levels[level]
            here = chunk.astype(np.uint32)
            if bits is not None:
                more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
                here[more] |= value << np.uint32(8)
            value = here
        return value


# -- encoding ----------------------------------------------------------------

class WordEncoder:
    """Ids of a text by the tokenizers library, for tokenizers that lower-case,
    drop white space and never join characters across it: stretches between
    ASCII white space are encoded by themselves, lower-cased, and remembered. A
    mark after a letter is a piece of its own, so it is looked up by itself."""

    def __init__(self, tokenizer_json: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = re.compile(b"|".join(
            re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.known = Memory(self.stretch, REMEMBER)

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def stretch(self, word: bytes) -> bytes:
        if word[-1] in b".,;:!?" and word[-2:-1].isalpha():
            return self.known[word[:-1]] + self.known[word[-1:]]
        return self.whole(word)

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        look, special = self.known.__getitem__, self.special.search
        return [b"" if not t else self.whole(t) if b"<" in t and special(t.lower())
                else b"".join(map(look, t.lower().split())) for t in texts]


def write(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, doc_id: str = "doc_id",
          text: str = "text") -> None:
    """Write the ids of ``docs`` as a store at ``path``. One range shuffle by
    (doc_id, scan order), so a hot doc_id is split; each range is encoded and
    packed by one task. Extra columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.col(quoted(text)).cast("binary")
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), body.alias("text"),
                       F.monotonically_increasing_id().alias("o"))
    order = ["doc_id", "o"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    model = spark.sparkContext.broadcast(tokenizer_json)
    end = np.uint32(end_id).tobytes()
    digest = zlib.crc32(tokenizer_json.encode()), "token_store"

    def run(batches):
        encoder, part, seg = per_worker(digest, lambda: WordEncoder(model.value)), 0, 0
        ids, ends, body, total = [], [], [], 0

        def segment():
            block = pack(np.frombuffer(b"".join(body), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seg], pa.int64()), pa.array([total], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                 pa.array([block], pa.binary())], names=SEGMENT.names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for a, b in slices(batch.column(1)):
                for d, code in zip(batch.column(0).slice(a, b - a).to_pylist(),
                                   encoder(batch.column(1).slice(a, b - a).to_pylist())):
                    if ids and (total + len(code) // 4 >= SEGMENT_TOKENS or len(ids) >= SEGMENT_DOCS):
                        yield segment()
                        ids, ends, body, total, seg = [], [], [], 0, seg + 1
                    total += len(code) // 4 + 1
                    ids.append(d)
                    ends.append(total)
                    body += [code, end]
        if ids:
            yield segment()

    rows.mapInArrow(run, SEGMENT).write.option("compression", "uncompressed").parquet(path)


# -- reading -----------------------------------------------------------------

def segments(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments with first_token, the ids of all segments before.
    Sums are taken per range first, so the one ordered pass is over ranges. The
    directory is broadcast within the checked row bound, so blocks stay in place."""
    segs = spark.read.schema(SEGMENT).parquet(path)
    sizes = segs.select("part", "seg", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = sizes.select("part", "seg", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg"))
                                          - F.col("n_tokens")).alias("offset"))
    first = inside.join(before, "part").select("part", "seg", (F.col("base") + F.col("offset")).alias("first_token"))
    return segs.join(maybe_broadcast(first), ["part", "seg"])


def documents_of(segs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit
    integers) of every document, decoded from the blocks."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for doc_ids, ends, block, first in zip(*(batch.column(i) for i in range(4))):
                doc_ids, ends = doc_ids.as_py(), np.array(ends.as_py(), dtype=np.int64)
                code = memoryview(Block(block.as_py()).ids().astype("<u4").tobytes())
                starts = np.concatenate([[0], ends[:-1]])
                for a in range(0, len(ends), 256):
                    part = slice(a, a + 256)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[part], pa.int64()), pa.array(starts[part] + first.as_py()),
                         pa.array(ends[part] - starts[part]),
                         pa.array([bytes(code[4 * s:4 * e]) for s, e in
                                   zip(starts[part].tolist(), ends[part].tolist())], pa.binary())],
                        names=schema.names)

    return segs.select("doc_ids", "doc_ends", "block", "first_token").mapInArrow(run, schema)


def tokens_at(segs: DataFrame, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """``positions`` with the token at each global position (NULL outside the
    store), read through the rank directories; no block is decoded. Positions and
    segments meet in an equi-join on strides of SEGMENT_TOKENS."""
    stride = F.lit(SEGMENT_TOKENS)
    here = segs.select("first_token", "n_tokens", "block", F.explode(F.sequence(
        F.floor(F.col("first_token") / stride),
        F.floor((F.col("first_token") + F.col("n_tokens") - 1) / stride))).alias("__stride"))
    asked = positions.select(F.col(quoted(pos)).cast("long").alias("pos")).distinct() \
        .withColumn("__stride", F.floor(F.col("pos") / stride))
    met = asked.join(here, "__stride").where(F.col("pos").between(
        F.col("first_token"), F.col("first_token") + F.col("n_tokens") - 1))
    grouped = met.groupBy("first_token", F.floor(F.col("pos") / 65536).alias("run")).agg(
        F.collect_list("pos").alias("at"), F.first("block").alias("block"))
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("token", T.LongType())])

    def run(batches):
        for batch in batches:
            for first, at, block in zip(*(batch.column(i) for i in range(3))):
                reader, at, first = Block(block.as_py()), at.as_py(), first.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array([reader[p - first] for p in at], pa.int64())],
                    names=schema.names)

    found = grouped.select("first_token", "at", "block").mapInArrow(run, schema)
    return positions.join(found.withColumnRenamed("pos", "__pos"),
                          F.col(quoted(pos)).cast("long") == F.col("__pos"), "left").drop("__pos")

