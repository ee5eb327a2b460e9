"""Shared plan pieces over the driver tables (documents, benchmark, pages...).

These are the building blocks of the registered queries: loading, the
documents-as-files view, the chunk table and the lexical retrieval of the
benchmark items. Nothing here triggers a job except the broadcast size
checks inside the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import chunking
from docmill.operators.generate import assemble_context
from docmill.operators.retrieve import lexical_topk
from docmill.sources.files import document_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that arrives in fewer partitions than the cluster has
    cores. Spark plans a split of 128 MB or less per core, so this only concerns
    tables under 128 MB a core; a larger table isn't shuffled. Planned splits don't
    tell how many hold rows: all but one of a one-group file's are empty."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, content_type, chunk_index, start_char, end_char, text)."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    docs = docs.withColumn("filename", document_name(F.col("doc_id"))) \
               .withColumn("content_type", F.lit("text/plain"))
    return chunking.chunk(docs)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))


def case_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as requests; every tenth is blank, every tenth has
    no letters (neither retrieves anything)."""
    r = F.col("item_id") % 10
    return benchmark_queries(spark, sf_dir).select("item_id", F.when(r == 3, F.lit(" \t "))
                                                   .when(r == 4, F.col("item_id").cast("string"))
                                                   .otherwise(F.col("query")).alias("query"))


def retrieved(spark: SparkSession, sf_dir: str, k: int, chunks: DataFrame | None = None,
              carry=("filename", "text"), queries: DataFrame | None = None) -> DataFrame:
    """Lexical top-k chunks per benchmark item (optionally with source name
    and text carried from the winning chunks)."""
    chunks = chunks if chunks is not None else chunk_table(spark, sf_dir)
    q = queries if queries is not None else benchmark_queries(spark, sf_dir)
    return lexical_topk(q, chunks, k=k, q_keys=["item_id"], q_text="query", carry=list(carry))


def contexts(spark: SparkSession, sf_dir: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    top = retrieved(spark, sf_dir, k, queries=queries)
    return assemble_context(top, ["item_id"], source_col="filename")
