"""Document sources and ingestion: file tables, filters, format dispatch,
decoding (fail-fast or quarantine), JSON/HTML normalisation, multi-part
assembly and the per-document record.

A "file table" has columns ``filename STRING, content_type STRING,
content BINARY`` plus any key columns. Sources:

* :func:`read_files` -- ``binaryFile`` over a directory (glob filter and
  partition discovery come from Spark),
* :func:`documents_as_files` -- the ``documents`` parquet table seen as files.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import rules
from docmill.functions.text import file_ext, preview
from docmill.operators import chunking
from docmill.operators.pages import html_to_text

def read_files(spark: SparkSession, path: str, glob: str | None = None,
               recursive: bool = True) -> DataFrame:
    """(filename, content_type, content, length, path) from a directory.

    ``content_type`` is unknown for plain files (NULL), so dispatch falls
    back to the extension. Only the rows' bytes are read; Spark splits the
    listing across tasks.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("filename"),
                     F.lit(None).cast("string").alias("content_type"),
                     "content", "length", "path")


def document_name(doc_id: Column) -> Column:
    return F.concat(F.lit("doc-"), doc_id.cast("string"), F.lit(".txt"))


def documents_as_files(documents: DataFrame) -> DataFrame:
    """The ``documents`` table as uploaded text files (name doc-<id>.txt)."""
    return documents.select(
        "doc_id", "source", "lang",
        document_name(F.col("doc_id")).alias("filename"),
        F.lit("text/plain").alias("content_type"),
        F.encode(F.col("text"), "UTF-8").alias("content"))


# ---------------------------------------------------------------------------
# A3 / A4

def ingest_filter(files: DataFrame, extensions: Sequence[str] = rules.DOCUMENT_EXTENSIONS) -> DataFrame:
    """Accept files whose extension is allowed (``rules.DOCUMENT_EXTENSIONS``
    for documents, ``rules.PAGE_EXTENSIONS`` for target pages). The advisory
    size bound never drops a file here; see ``extract_text``."""
    return files.where(file_ext(F.col("filename")).isin(list(extensions)))


def format_kind(content_type: Column, filename: Column,
                by_type=rules.CONTENT_TYPE_KIND, by_ext=rules.EXTENSION_KIND,
                default: str = rules.DEFAULT_KIND) -> Column:
    """Exact content-type match first, then extension, then the default."""
    ext = file_ext(filename)
    expr = None
    for ctype, kind in by_type:
        cond = content_type == F.lit(ctype)
        expr = F.when(cond, F.lit(kind)) if expr is None else expr.when(cond, F.lit(kind))
    for e, kind in by_ext:
        expr = expr.when(ext == F.lit(e), F.lit(kind))
    return expr.otherwise(F.lit(default))


# ---------------------------------------------------------------------------
# A5 / A6 / A9

def json_pretty(text: str | None) -> str | None:
    """Parse then re-serialise with indent=2 (key order kept, duplicate key:
    last value wins, non-ASCII escaped); invalid JSON comes back unchanged."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), indent=2)
    except ValueError:
        return text


@F.pandas_udf(T.StringType())
def json_normalize(texts: pd.Series) -> pd.Series:
    return texts.map(json_pretty)


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, ok): UTF-8 decode without failing; text is NULL when invalid."""
    as_str = content.cast("string")
    ok = F.is_valid_utf8(as_str)
    return F.when(ok, as_str), ok


def extract_text(files: DataFrame, mode: str = "fail_fast", max_bytes: int | None = None) -> DataFrame:
    """Add ``kind``, ``text``, ``ok`` and ``error_code``.

    The kind is settled before any decoding: PDF bytes have no codec here
    (``unsupported_pdf``), files over ``max_bytes`` (if given) are
    ``too_large``, other bytes that are not UTF-8 are ``invalid_utf8``.
    ``quarantine`` keeps such files as rows with ``ok = false``; ``fail_fast``
    stops the job at the first invalid or too large file with ``Error processing
    <file>: <code>`` (a PDF is no broken file, and stays a row in either mode).
    Each parser only gets the texts of its own kind.
    """
    if mode not in ("fail_fast", "quarantine"):
        raise ValueError("mode must be fail_fast or quarantine")
    raw, valid = decoded(F.col("content"))
    df = files.withColumn("kind", format_kind(F.col("content_type"), F.col("filename")))
    large = F.octet_length("content") > max_bytes if max_bytes is not None else F.lit(False)
    df = df.withColumn("error_code", F.when(F.col("kind") == "pdf", F.lit("unsupported_pdf"))
                       .when(large, F.lit("too_large"))
                       .when(~valid, F.lit("invalid_utf8")))
    usable = F.col("error_code").isNull()

    def of(kind: str) -> Column:
        return F.when(usable & (F.col("kind") == kind), raw)

    text = (F.when(F.col("kind") == "json", json_normalize(of("json")))
             .when(F.col("kind") == "html", html_to_text(of("html")))
             .otherwise(F.when(usable, raw)))
    if mode == "fail_fast":
        # a filter, so the check runs whatever columns are read later
        df = df.where(F.when(F.col("error_code").isin("invalid_utf8", "too_large"), F.raise_error(
            F.concat(F.lit("Error processing "), F.col("filename"), F.lit(": "), F.col("error_code"))).cast("boolean"))
            .otherwise(F.lit(True)))
    return df.withColumn("text", text).withColumn("ok", usable)


def write_extracted(files: DataFrame, path: str, mode: str = "quarantine", max_bytes: int | None = None) -> dict[str, int]:
    """Extract ``files`` into a Parquet table at ``path`` (their columns without
    the bytes, plus those of :func:`extract_text`) and return what the same pass
    counted: files, ok, each error code, chars and bytes.

    The counts are observed in the stage that writes, so a task that runs again
    after a lost executor counts once, as its files do."""
    from pyspark.sql import Observation
    seen = Observation()
    out = extract_text(files, mode, max_bytes)
    codes = [F.count_if(F.coalesce(F.col("error_code") == c, F.lit(False))).alias(c) for c in ERROR_CODES]
    out.observe(seen, F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("ok"), *codes,
                F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"),
                F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes")) \
        .drop("content").write.parquet(path)
    return dict(seen.get)


ERROR_CODES = ("unsupported_pdf", "too_large", "invalid_utf8")


# ---------------------------------------------------------------------------
# A8 multi-part assembly

def assemble_parts(parts: DataFrame, key: str, order_col: str, text_col: str = "text") -> DataFrame:
    """Parts of one document joined in order with no separator.

    One output row per document, so the group is bounded by the document
    itself (the per-document size bound applies, not the corpus size).
    """
    return (parts.groupBy(key)
                 .agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                           F.col(text_col).alias("t")))).alias("_p"))
                 .select(key, F.array_join(F.transform("_p", lambda p: p["t"]), "").alias("text")))


# ---------------------------------------------------------------------------
# A10 - A12

def document_record(docs: DataFrame, text_col: str = "text", size: int = chunking.DEFAULT_SIZE,
                    overlap: int = chunking.DEFAULT_OVERLAP) -> DataFrame:
    """Per document: its columns + n_chars + chunk_count (no explode needed:
    the chunk count has a closed form)."""
    out = chunking.chunk_count(docs, text_col, size, overlap)
    return out.withColumn("n_chars", F.length(text_col))


def document_summary(records: DataFrame, group_col: str = "source") -> DataFrame:
    return records.groupBy(group_col).agg(F.count(F.lit(1)).alias("docs"),
                                          F.sum("chunk_count").alias("chunks"))


def document_preview(docs: DataFrame, keys: Sequence[str], text_col: str = "text", n: int = 500) -> DataFrame:
    return docs.select(*keys, preview(text_col, n).alias("preview"))


def write_cases_json(cases: DataFrame, path: str) -> None:
    """Test-case rows as JSON lines (one object per case, steps as a list)."""
    cases.write.mode("overwrite").json(path)


def export_names(cases: DataFrame) -> DataFrame:
    """Script class and file names for each test case."""
    tid = F.col("test_id")
    return cases.withColumn("class_name", F.concat(F.lit("Test"), F.replace(tid, F.lit("-"), F.lit("_")))) \
                .withColumn("file_name", F.concat(F.lit("test_"), F.replace(F.lower(tid), F.lit("-"), F.lit("_")),
                                                  F.lit(".py")))
