"""Incremental ingest through Structured Streaming equals the batch build."""

from docmill.plans.corpus import chunk_table
from docmill.sources import kb
from docmill.streaming.ingest import run_incremental_ingest

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    streamed = run_incremental_ingest(spark, SF)
    batch = kb.kb_rows(chunk_table(spark, SF))
    cols = ["chunk_id", "source", "chunk_index", "start_char", "end_char", "text"]
    assert sorted(tuple(r) for r in streamed.select(*cols).collect()) == \
        sorted(tuple(r) for r in batch.select(*cols).collect())


def test_multiple_micro_batches_and_replay(spark):
    import tempfile

    from pyspark.sql import functions as F

    from docmill.operators.chunking import chunk
    from docmill.sources.files import document_name
    from docmill.streaming.ingest import document_stream, start_incremental_ingest

    src = tempfile.mkdtemp(prefix="docmill-stream-src-")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    import pyarrow.parquet as pq
    whole = pq.read_table(f"{SF}/documents.parquet")
    step = -(-whole.num_rows // 3)
    for i in range(3):  # three files -> three micro-batches (maxFilesPerTrigger=1)
        pq.write_table(whole.slice(i * step, step), f"{src}/documents-{i}.parquet")
    root = tempfile.mkdtemp(prefix="docmill-stream-out-")
    q = start_incremental_ingest(document_stream(spark, src, glob="*.parquet"), f"{root}/kb", f"{root}/ck")
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    first = kb.open_kb(spark, f"{root}/kb").count()
    # replay on the same checkpoint: nothing new, nothing duplicated
    q2 = start_incremental_ingest(document_stream(spark, src, glob="*.parquet"), f"{root}/kb", f"{root}/ck")
    q2.awaitTermination()
    assert kb.open_kb(spark, f"{root}/kb").count() == first
    # a source that is sent again, shorter, replaces its rows
    again = whole.slice(0, 1).to_pylist()[0] | {"text": "Short now.", "n_chars": 10}
    import pyarrow as pa
    pq.write_table(pa.Table.from_pylist([again], schema=whole.schema), f"{src}/documents-9.parquet")
    start_incremental_ingest(document_stream(spark, src, glob="*.parquet"), f"{root}/kb", f"{root}/ck").awaitTermination()
    rows = kb.open_kb(spark, f"{root}/kb").where(F.col("source") == f"doc-{again['doc_id']}.txt").collect()
    assert [(r.chunk_index, r.text) for r in rows] == [(0, "Short now.")]
    had = chunk(docs.where(F.col("doc_id") == again["doc_id"]).select("doc_id", "text")).count()
    assert kb.open_kb(spark, f"{root}/kb").count() == first - had + 1
    n = kb.build(kb.open_kb(spark, f"{root}/kb"), f"{root}/kb")  # from its own rows
    assert n == first - had + 1 == kb.open_kb(spark, f"{root}/kb").count()
    named = docs.select("doc_id", "text", document_name(F.col("doc_id")).alias("filename"))
    assert first == chunk(named).count()


def _ingested(spark, batches):
    """(source, version, text) of the KB after each upload; the query starts anew
    for each, on one checkpoint."""
    import tempfile

    from docmill.streaming.ingest import start_versioned_ingest
    schema = "doc_id long, version long, text string"
    root = tempfile.mkdtemp(prefix="docmill-versions-")
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        start_versioned_ingest(stream, f"{root}/kb", f"{root}/ck").awaitTermination()
        seen.append({r.source: (r.version, r.text) for r in kb.open_kb(spark, f"{root}/kb").collect()})
    return seen


def test_late_and_repeated_versions(spark):
    first, late, newer = _ingested(spark, [
        [(1, 1, "x"), (1, 3, "z"), (2, 2, "q"), (2, 2, "longer"), (3, None, "none")],
        [(1, 2, "late"), (2, 1, "old"), (4, 1, "new"), (3, None, "again")],  # only 3 and 4 change
        [(1, 3, "z"), (2, 4, "four"), (3, 1, "one"), (4, None, "least")]])
    assert first == {"doc-1.txt": (3, "z"), "doc-2.txt": (2, "longer"), "doc-3.txt": (None, "none")}
    assert late == first | {"doc-3.txt": (None, "again"), "doc-4.txt": (1, "new")}
    assert newer == late | {"doc-2.txt": (4, "four"), "doc-3.txt": (1, "one")}
