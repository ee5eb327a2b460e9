"""The training-data pipeline over ``documents``.

``STAGES`` in order; each takes (spark, docs, sf_dir) and returns a DataFrame,
which a caller writes as Parquet and rereads as the next stage's ``docs``. All
but the last return the columns of ``documents``. ``run`` chains them, each
stage's rows written in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, decontaminate, jaccard, line_templates, quality
from docmill.llm.common import table, written
from docmill.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fertility bands of their language, fitted on labelled
    good ones; the others go."""
    ship_package(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return quality.keep_good(docs, model, bands=quality.fit_bands(docs, table(spark, sf_dir, "labels"), model))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines of templates that recur across documents;
    n_chars follows the text."""
    ship_package(spark)
    left = line_templates.drop_templates(docs, keep=docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids (little-endian unsigned 32-bit integers) of each text,
    and the hash of the bytes they decode to."""
    ship_package(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("byte-level BPE", encoding)]

#: The quality and encoding stages need tokenizers, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
