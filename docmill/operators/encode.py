"""Encoder contract: (keys, text) -> (keys, embedding) in Arrow batches.

:func:`encode_with` takes a function that loads a model (a tokenizer + ONNX
session, weights from a shared path, ...) and returns its predict function. It runs
through ``predict_batch_udf``: the model is loaded once per Python worker, kept for
later tasks, and never pickled; predict calls are bounded in texts and in characters.
:func:`encode` is the short form for a function that needs no loading. Spark
partitions the work and the vectors feed :func:`docmill.operators.retrieve.dense_topk`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(df: DataFrame, keys: Sequence[str], text_col: str, fn: Callable[[list], np.ndarray],
           dim: int, batch_rows: int = 256) -> DataFrame:
    keys = list(keys)
    src = df.select(*keys, F.col(text_col).alias("_text"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                vecs = np.asarray(fn(texts), dtype=np.float32).reshape(len(texts), dim)
                emb = pa.FixedSizeListArray.from_arrays(pa.array(vecs.ravel(), pa.float32()), dim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in keys] + [emb.cast(pa.list_(pa.float32()))],
                    names=keys + ["embedding"])

    return src.mapInArrow(run, f"{key_schema}, embedding array<float>")


def char_batches(texts: list[str], limit: int):
    """Consecutive slices of ``texts`` of at most ``limit`` characters together;
    a longer text is a slice of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield texts[start:]


def encode_with(df: DataFrame, keys: Sequence[str], text_col: str, load: Callable[[], Callable[[list], np.ndarray]],
                dim: int, batch_rows: int = 256, batch_chars: int = 1 << 20) -> DataFrame:
    """``keys`` plus ``embedding`` (array<float> of ``dim``) of each text (NULL: the
    empty text). ``load()`` runs in the worker and returns ``predict(list[str]) ->
    [n, dim]``, which sees at most ``batch_rows`` texts and ``batch_chars`` characters
    at once (a longer text alone)."""
    def make():
        predict = load()

        def run(texts: np.ndarray) -> np.ndarray:
            texts = [t or "" for t in np.asarray(texts, dtype=object).ravel().tolist()]
            made = [np.asarray(predict(part), dtype=np.float32).reshape(len(part), dim)
                    for part in char_batches(texts, batch_chars)]
            return np.concatenate(made)

        return run

    model = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_rows)
    return df.select(*keys, model(F.coalesce(F.col(text_col), F.lit(""))).alias("embedding"))
