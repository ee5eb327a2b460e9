"""Knowledge-base table: chunk rows with deterministic ids, kept as a partitioned
Parquet table.

The table is laid out by ``bucket``, a hash of the source, so all rows of a source
stand in one bucket (below ``partition_by``, if given). That makes each change an
ordinary Spark overwrite:

* :func:`build` replaces the whole table (static overwrite),
* :func:`append` replaces the sources it is given: it reads the buckets that they
  fall into, takes out their old rows and overwrites just those buckets (dynamic
  partition overwrite),
* :func:`clear` overwrites with nothing, :func:`open_kb` reads the table.

:func:`build` over a table with rows, and what :func:`append` is given, is complete in
the shared folder before the table is touched; a first build and the overwrite of
buckets go straight to the table, whose files change when the job commits. So rows may
come from the table itself, and a job that fails leaves the table as it was. Sending
rows again gives the same table, so a replayed batch needs no bookkeeping. One writer
at a time; a reader opens the table between changes. The number of buckets and the
outer partition column are kept in the schema of the files (column metadata).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import maybe_broadcast
from docmill.session import remove_path, scratch_path

KB_SCHEMA = ("chunk_id string, source string, content_type string, chunk_index int, "
             "start_char int, end_char int, text string")
KB_COLUMNS = [c.split(" ")[0] for c in KB_SCHEMA.split(", ")]
#: Buckets of a new table. An append rewrites the buckets it touches, so a large
#: table that changes often takes more of them.
BUCKETS = 64
#: Names of sources that are broadcast (within the bytes that ``sizing`` allows), so that
#: neither the table nor new rows are shuffled to find those of a source.
BROADCAST_SOURCES = 2_000_000


def chunk_id(source, chunk_index):
    """Deterministic, retry-stable id (a random uuid would change on retry)."""
    return F.sha2(F.concat_ws("\u0001", source, chunk_index.cast("string")), 256)


def kb_rows(chunks: DataFrame, source_col: str = "filename", type_col: str = "content_type", carry=()) -> DataFrame:
    """Chunk rows -> KB rows (chunk_id, source, content_type, chunk_index, ...) and
    the ``carry`` columns."""
    src = F.col(source_col)
    return chunks.select(
        chunk_id(src, F.col("chunk_index")).alias("chunk_id"),
        src.alias("source"), F.col(type_col).alias("content_type"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("start_char").cast("int").alias("start_char"),
        F.col("end_char").cast("int").alias("end_char"), "text", *carry)


def bucket_of(source: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a source (NULL has one, too)."""
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def build(rows: DataFrame, root: str, partition_by: str | None = None, buckets: int = BUCKETS) -> int:
    """Make ``rows`` the whole KB; returns how many there are.

    ``rows`` must have the KB_SCHEMA columns; extra columns (an ``embedding``
    from :func:`docmill.operators.encode.encode`, a language or collection
    column) are kept. ``partition_by`` names a coarse string column to lay the
    table out by, so filters on it prune files before any scoring; a source
    then belongs to its value of that column."""
    laid_out = _laid_out(rows, buckets, partition_by)
    if _table(rows.sparkSession, root) is None:
        return _written(laid_out, root, "static", partition_by)
    return _through_scratch(laid_out, root, partition_by)


def append(rows: DataFrame, root: str, buckets: int = BUCKETS, version: str | None = None) -> int:
    """Add ``rows``; the sources in them replace what the KB had of them (with
    ``partition_by``: within their value of that column). Returns the number of
    rows added. Columns that the table doesn't have raise; those that ``rows``
    don't have become NULL. ``buckets`` counts for a KB without rows only.

    ``version`` names a column: a source of which the KB holds a greater version
    is left as it is (late files), an equal one replaces it (a replay). A NULL is
    the least version. ``rows`` hold one version of a source."""
    spark = rows.sparkSession
    old = _table(spark, root)
    if old is None:
        return build(rows, root, buckets=buckets)
    layout = _layout(old)
    by = layout.get("by")
    foreign = set(rows.columns) - set(old.columns)
    if foreign:
        raise ValueError(f"the KB has no column {sorted(foreign)}")
    unit = ["source"] + ([by] if by else [])
    paths = [scratch_path(spark, "kb-rows")]
    _laid_out(rows, layout["buckets"], by).write.parquet(paths[0])
    new = spark.read.parquet(paths[0])
    if version:
        # decided on sources and versions alone; rows that stay aren't written again
        sent = new.groupBy(*unit).agg(F.max(version).alias("sent"))
        held = old.where(F.col("bucket").isin(_buckets_of(new))).groupBy(*[F.col(c).alias(f"held_{c}") for c in unit]) \
            .agg(F.max(version).alias("held"))
        same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in unit]
        paths.append(scratch_path(spark, "kb-late"))
        sent.join(held, [*same, F.col("held").isNotNull() & (F.col("sent").isNull() | (F.col("sent") < F.col("held")))]) \
            .select(*[f"held_{c}" for c in unit]).write.parquet(paths[1])
        late = spark.read.parquet(paths[1])
        new = new.join(maybe_broadcast(late, BROADCAST_SOURCES), same, "left_anti")
    touched, n = _buckets_of(new), new.count()
    if touched:
        sources = new.select(*[F.col(c).alias(f"new_{c}") for c in unit]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in unit]
        kept = old.where(F.col("bucket").isin(touched)).join(maybe_broadcast(sources, BROADCAST_SOURCES), same, "left_anti")
        if by:
            leaf = new.select(F.col("bucket").alias("_b"), F.col(by).alias("_by")).distinct()
            kept = kept.join(leaf, F.col(by).eqNullSafe(F.col("_by")) & (F.col("bucket") == F.col("_b")), "left_semi")
        _written(_stamped(kept.unionByName(new, allowMissingColumns=True), layout), root, "dynamic", by)
    for path in paths:
        remove_path(spark, path)
    return n


def _buckets_of(rows: DataFrame) -> list[int]:
    """The buckets that rows fall into: partitions to read and to write again, one
    number for each at most."""
    return [r[0] for r in rows.select("bucket").distinct().collect()]


def _stamped(rows: DataFrame, layout: dict) -> DataFrame:
    return rows.withMetadata("source", layout)


def _laid_out(rows: DataFrame, buckets: int, by: str | None) -> DataFrame:
    extra = [c for c in rows.columns if c not in KB_COLUMNS and c != "bucket"]
    layout = {"buckets": buckets} | ({"by": by} if by else {})
    return _stamped(rows.select(*KB_COLUMNS, *extra).withColumn("bucket", bucket_of(F.col("source"), buckets)), layout)


def _through_scratch(rows: DataFrame, root: str, by: str | None) -> int:
    """Compute ``rows`` in the shared folder, then overwrite all of ``root`` with them."""
    spark = rows.sparkSession
    path = scratch_path(spark, "kb-table")
    rows.write.parquet(path)
    n = _written(spark.read.schema(rows.schema).parquet(path), root, "static", by)
    remove_path(spark, path)
    return n


def _written(rows: DataFrame, root: str, mode: str, by: str | None) -> int:
    """Overwrite ``root`` (``dynamic``: its buckets in ``rows``); returns the table's rows.
    ``rebalance`` brings a bucket's rows together, so that a task writes few files, and
    lets AQE split a bucket that holds a hot source."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode) \
        .partitionBy(*([by] if by else []), "bucket").parquet(root)
    return rows.sparkSession.read.schema(rows.schema).parquet(root).count()


def _layout(table: DataFrame) -> dict:
    return table.schema["source"].metadata


def _table(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored table with its ``bucket`` column; None without any rows."""
    try:
        schema = spark.read.parquet(root).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    by = schema["source"].metadata.get("by")  # folder names that look like numbers stay strings
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == by else f for f in schema])
    return spark.read.schema(schema).parquet(root)


def open_kb(spark: SparkSession, root: str) -> DataFrame:
    """The KB, or an empty table of the KB schema when none exists."""
    rows = _table(spark, root)
    return spark.createDataFrame([], KB_SCHEMA) if rows is None else rows.drop("bucket")


def of_sources(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The rows of a stated list of sources; reads only their buckets."""
    rows = _table(spark, root)
    if rows is None:
        return spark.createDataFrame([], KB_SCHEMA)
    n = _layout(rows)["buckets"]
    held = spark.range(1).select(*[bucket_of(F.lit(s), n).alias(str(i)) for i, s in enumerate(names)]).first() or []
    return rows.where(F.col("bucket").isin(sorted(set(held))) & F.col("source").isin(list(names))).drop("bucket")


def clear(spark: SparkSession, root: str) -> int:
    """Replace the KB with an empty one."""
    return build(spark.createDataFrame([], KB_SCHEMA), root)


def sources(kb: DataFrame) -> DataFrame:
    """Distinct sources; reads only the ``source`` column."""
    return kb.select("source").distinct()


def summary(kb: DataFrame) -> DataFrame:
    """Chunks per source (the build's returned count is the sum)."""
    return kb.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
