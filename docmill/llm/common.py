"""Shared pieces of the llm operators: text kernels over Arrow slices, written
intermediate tables, and word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.session import scratch_path

#: Bytes of text a kernel sees at once (one longer text is seen alone). A kernel's
#: words and arrays take some thirty times as much, and a worker keeps that memory.
SLICE_BYTES = 512 << 10
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the cluster's shared folder: it is computed once,
    cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row or more of the driver's, as Arrow: a list would be an RDD of Python
    objects, for which every executor starts workers of another kind, beside its own."""
    table = pa.table([list(c) for c in zip(*rows)], names=[c.split()[0] for c in schema.split(",")])
    return spark.createDataFrame(table, schema)


def filtered(df: DataFrame, text: str, fields: list[T.StructField], make_kernel, condition) -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose kernel ``fields`` meet
    ``condition`` (a Column; ``__row`` is the struct of the other columns)."""
    others = [c for c in df.columns if c != text]
    inner = df.select(F.struct(F.lit(0), *[F.col(quoted(c)) for c in others]).alias("__row"),
                      F.col(quoted(text)).alias("__text"))
    good = map_text(inner, "__text", fields, make_kernel, ["__row"], "__body").where(condition)
    kind = df.schema[text].dataType
    return good.select(*[F.col("__body").cast(kind).alias(c) if c == text else F.col("__row").getField(c).alias(c)
                         for c in df.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, outputs, drop=()) -> list[str]:
    """Input columns an operator carries: all but ``drop`` and those whose
    name (case-insensitively, as Spark resolves names) an output takes."""
    taken = {o.lower() for o in outputs} | {d.lower() for d in drop}
    return [c for c in df.columns if c.lower() not in taken]


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) ranges of rows with about ``limit`` bytes of text."""
    ends = np.cumsum(np.asarray([0 if v is None else v for v in
                                 pc.binary_length(texts).to_pylist()], dtype=np.int64))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold ``BATCH_BYTES`` at most, so that long texts
    don't add up in a worker: lowered for the session where it has Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(df: DataFrame, text: str, fields: list[T.StructField], make_kernel,
             keep: list[str], body_as: str | None = None) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields``, which a kernel computes from
    the text column. ``make_kernel()`` runs once per task and returns a function
    from a list of UTF-8 texts (None for NULL) to one value list (or Arrow
    array) per field. ``body_as`` names a column that gives the text's bytes back,
    so that it travels once. Rows stay in their partition; no shuffle."""
    small_batches(df.sparkSession)
    back = [T.StructField(body_as, T.BinaryType())] if body_as else []
    schema = T.StructType([df.schema[c] for c in keep] + fields + back)
    src = df.select(*[F.col(quoted(c)) for c in keep],
                    F.col(quoted(text)).cast("binary").alias("__docmill_text"))
    names = [f.name for f in schema]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kinds = [to_arrow_type(f.dataType) for f in fields]
        kernel = make_kernel()
        forget_others(kernel)
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            for a, b in slices(body):
                made = kernel(body.slice(a, b - a).to_pylist())
                made = [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, type=k)
                        for m, k in zip(made, kinds)]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                same = [body.slice(a, b - a)] if body_as else []
                yield pa.RecordBatch.from_arrays(kept + made + same, names=names)

    return src.mapInArrow(run, schema)


#: Length of a text that a worker remembers something of: longer ones hardly come
#: again, and a memory bounded by its entries is bounded in bytes.
LONGEST = 64


class Memory(dict):
    """``make(key)``, remembered for the last ``limit`` new keys at least and
    twice as many at most, but not of keys longer than ``LONGEST``. Looking up is
    ``memory[key]``; values are not None."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_WORKER: dict = {}


def per_worker(key, make):
    """``make()``, once per key and Python worker: workers are reused by later
    tasks, so what a kernel remembers stays warm. Holds the last key only, so
    that the memories of several operators never add up."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def forget_others(kernel) -> None:
    """Drop what an earlier operator left in this worker, unless ``kernel`` is
    one that remembers (it has replaced it already)."""
    if not getattr(kernel, "remembers", False):
        _WORKER.clear()


# -- words and their hashes -------------------------------------------------

#: Lower-cases A-Z and turns every ASCII byte but 0-9 and a-z into a space;
#: bytes of non-ASCII characters stay. On UTF-8 the words left are the matches
#: of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in the lower-cased text.
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A
               else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ : bytes.split() cuts at just these bytes."""
    return text.split() if text else []


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POW[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the constants of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hash of any stretch of a word-hash sequence from prefix sums modulo
    2**64: equal stretches hash equally wherever they stand."""

    def __init__(self, word_hash: np.ndarray):
        n = len(word_hash)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(word_hash * _powers(_MULT, n), out=self.sums[1:])
        self.back = _powers(_INV, n + 1)

    def __call__(self, starts: np.ndarray, lengths) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts]
                       + np.uint64(1) * np.asarray(lengths, dtype=np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hash of the stretch of ``length`` words at every start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.back[:n] + np.uint64(length))


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of words, equal in every process. (A look-up in a large
    memory of known words takes longer than the hash itself.)"""
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64)
