"""Ingestion: dispatch, decoding modes, JSON normalisation, KB lifecycle."""

from conftest import plan_text
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docmill.sources import files as FS
from docmill.sources import kb as KB


def _files(spark, rows):
    return spark.createDataFrame(rows, "filename string, content_type string, content binary")


def test_format_dispatch(spark):
    rows = [("a.TXT", None, b""), ("b.md", "application/octet-stream", b""), ("c.json", None, b""),
            ("d.html", "text/html; charset=utf-8", b""), ("e.pdf", None, b""), ("README", None, b""),
            ("x.weird", "application/json", b""), ("y.csv", None, b""), ("z.json", "text/plain", b"")]
    got = {r.filename: r.k for r in _files(spark, rows).select(
        "filename", FS.format_kind(F.col("content_type"), F.col("filename")).alias("k")).collect()}
    assert got == {"a.TXT": "text", "b.md": "text", "c.json": "json", "d.html": "html", "e.pdf": "pdf",
                   "README": "text", "x.weird": "json", "y.csv": "text", "z.json": "text"}


def test_ingest_filter(spark):
    rows = [("a.md", None, b"x"), ("b.html", None, b"x"), ("c.pdf", None, b"x" * 20), ("noext", None, b"x")]
    got = sorted(r.filename for r in FS.ingest_filter(_files(spark, rows)).collect())
    assert got == ["a.md", "c.pdf"]
    big = FS.extract_text(_files(spark, rows + [("d.md", None, b"y" * 20)]), mode="quarantine", max_bytes=10)
    assert {r.filename: r.error_code for r in big.collect()} == {
        "a.md": None, "b.html": None, "c.pdf": "unsupported_pdf", "noext": None, "d.md": "too_large"}


def test_quarantine_and_fail_fast(spark):
    rows = [("good.txt", "text/plain", "héllo".encode()), ("bad.txt", "text/plain", b"\xff\xfe bad"),
            ("doc.json", None, b'{"b": 1, "a": "\xc3\xa9", "b": 2}'), ("broken.json", None, b"{nope"),
            ("p.html", None, b"<p>x &amp; y</p><script>z</script>"), ("s.pdf", None, b"%PDF")]
    out = {r.filename: (r.ok, r.error_code, r.text)
           for r in FS.extract_text(_files(spark, rows), mode="quarantine").collect()}
    assert out["good.txt"] == (True, None, "héllo")
    assert out["bad.txt"] == (False, "invalid_utf8", None)
    assert out["doc.json"][2] == json.dumps({"b": 2, "a": "é"}, indent=2)
    assert out["doc.json"][2] == '{\n  "b": 2,\n  "a": "\\u00e9"\n}'
    assert out["broken.json"][2] == "{nope"
    assert out["p.html"][2] == "x & y"
    assert out["s.pdf"][:2] == (False, "unsupported_pdf")
    with pytest.raises(Exception, match="Error processing bad.txt"):
        FS.extract_text(_files(spark, rows[:2]), mode="fail_fast").collect()


def test_fail_fast_with_a_constant_type_and_binary_pdf(spark):
    bad = _files(spark, [("bad.txt", "x", b"\xff\xfe")]).withColumn("content_type", F.lit("text/plain"))
    for columns in (["text"], ["filename"], ["ok"]):
        with pytest.raises(Exception, match="Error processing bad.txt"):
            FS.extract_text(bad).select(*columns).collect()
    with pytest.raises(Exception, match="Error processing bad.txt"):
        FS.extract_text(bad).count()
    with pytest.raises(Exception, match="Error processing bad.txt: too_large"):
        FS.extract_text(bad, max_bytes=1).count()
    pdf = _files(spark, [("s.pdf", None, b"%PDF-1.7\xe2\xe3\xcf\xd3"), ("a.txt", None, b"ok")])
    for mode in ("fail_fast", "quarantine"):
        got = {r.filename: (r.ok, r.error_code, r.text) for r in FS.extract_text(pdf, mode).collect()}
        assert got == {"s.pdf": (False, "unsupported_pdf", None), "a.txt": (True, None, "ok")}


def test_text_only_input_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Python" not in plan_text(FS.extract_text(FS.documents_as_files(docs)).select("doc_id", "text"))


def test_binary_file_source(spark):
    d = tempfile.mkdtemp(prefix="docmill-src-")
    for name, body in [("a.md", b"# title"), ("b.txt", b"plain"), ("skip.bin", b"\x00")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(body)
    df = FS.read_files(spark, d)
    kept = FS.extract_text(FS.ingest_filter(df)).select("filename", "text").orderBy("filename").collect()
    assert [tuple(r) for r in kept] == [("a.md", "# title"), ("b.txt", "plain")]


def test_assemble_parts_and_preview(spark):
    parts = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "d long, p long, text string")
    assert sorted(tuple(r) for r in FS.assemble_parts(parts, "d", "p").collect()) == [(1, "abc"), (2, "z")]
    docs = spark.createDataFrame([(1, "x" * 500), (2, "y" * 501)], "id long, text string")
    prev = {r.id: r.preview for r in FS.document_preview(docs, ["id"]).collect()}
    assert prev[1] == "x" * 500 and prev[2] == "y" * 500 + "..."


def test_kb_build_open_clear(spark):
    root = tempfile.mkdtemp(prefix="docmill-kb-")
    assert KB.open_kb(spark, root).count() == 0
    docs = spark.createDataFrame([(1, "a. " * 600), (2, "")], "doc_id long, text string")
    named = docs.select("doc_id", "text", FS.document_name(F.col("doc_id")).alias("filename"),
                        F.lit("text/plain").alias("content_type"))
    from docmill.operators.chunking import chunk
    rows = KB.kb_rows(chunk(named))
    n = KB.build(rows, root)
    kb = KB.open_kb(spark, root)
    assert n == kb.count() == 3
    assert [r.source for r in KB.sources(kb).collect()] == ["doc-1.txt"]
    ids = {r.chunk_id for r in kb.collect()}
    assert len(ids) == 3 and ids == {r.chunk_id for r in KB.kb_rows(chunk(named)).collect()}  # deterministic
    KB.clear(spark, root)
    assert KB.open_kb(spark, root).count() == 0


def test_kb_sources_reads_only_source(spark):
    root = tempfile.mkdtemp(prefix="docmill-kb-")
    rows = spark.createDataFrame([("i", "s", "t", 0, 0, 1, "x")], KB.KB_SCHEMA)
    KB.build(rows, root)
    plan = plan_text(KB.sources(KB.open_kb(spark, root)))
    assert "ReadSchema: struct<source:string>" in plan


def test_write_cases_json(spark):
    cases = spark.createDataFrame([(1, "TC-001", ["a", "b"]), (1, "TC-002", None)],
                                  "item_id long, test_id string, steps array<string>")
    out = tempfile.mkdtemp(prefix="docmill-json-")
    FS.write_cases_json(cases, out)
    back = sorted(spark.read.json(out).collect(), key=lambda r: r.test_id)
    assert back[0].steps == ["a", "b"] and back[1].test_id == "TC-002"
    names = {r.test_id: (r.class_name, r.file_name) for r in FS.export_names(cases).collect()}
    assert names["TC-001"] == ("TestTC_001", "test_tc_001.py")


def test_kb_partitioned_by_collection_prunes(spark):
    root = tempfile.mkdtemp(prefix="docmill-kb-")
    rows = spark.createDataFrame([("i1", "a.md", "t", 0, 0, 1, "x", "en"), ("i2", "b.md", "t", 0, 0, 1, "y", "de")],
                                 KB.KB_SCHEMA + ", lang string")
    KB.build(rows, root, partition_by="lang")
    kb = KB.open_kb(spark, root)
    assert sorted(kb.columns) == sorted([c.split(" ")[0] for c in KB.KB_SCHEMA.split(", ")] + ["lang"])
    en = kb.where(F.col("lang") == "en")
    assert [r.source for r in en.collect()] == ["a.md"]
    assert "PartitionFilters: [isnotnull(lang" in plan_text(en)


def test_kb_failed_build_or_append_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="docmill-kb-")
    KB.build(spark.createDataFrame([("i1", "a.md", "t", 0, 0, 1, "x")], KB.KB_SCHEMA), root)
    broken = spark.createDataFrame([("i2", "b.md", "t", 0, 0, 1, "y")], KB.KB_SCHEMA) \
        .withColumn("text", F.when(F.col("source") == "b.md", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    for change in (KB.build, KB.append):
        with pytest.raises(Exception, match="lost"):
            change(broken, root)
        assert [r.source for r in KB.open_kb(spark, root).collect()] == ["a.md"]


def _row(source, i, text):
    return (f"{source}-{i}", source, "t", i, 0, 1, text)


def test_kb_append_replaces_sources_and_only_their_buckets(spark):
    root = tempfile.mkdtemp(prefix="docmill-kb-")
    names = [f"s{i}.md" for i in range(40)] + [None]
    rows = [_row(s, i, "old") for s in names for i in range(3)]
    assert KB.build(spark.createDataFrame(rows, KB.KB_SCHEMA), root, buckets=8) == 123
    held = {p: os.path.getmtime(os.path.join(root, p)) for p in os.listdir(root) if p.startswith("bucket=")}
    assert len(held) == 8
    again = spark.createDataFrame([_row("s3.md", 0, "new"), _row("s3.md", 1, "new"), _row(None, 0, "new")], KB.KB_SCHEMA)
    for _ in range(2):  # a replay changes nothing
        assert KB.append(again, root, buckets=99) == 3  # the table's own number of buckets counts
        got = sorted((r.source or "", r.chunk_index, r.text) for r in KB.open_kb(spark, root).collect())
        want = sorted([(s or "", i, "old") for s in names for i in range(3) if s not in ("s3.md", None)]
                      + [("s3.md", 0, "new"), ("s3.md", 1, "new"), ("", 0, "new")])
        assert got == want
    now = {p: os.path.getmtime(os.path.join(root, p)) for p in os.listdir(root) if p.startswith("bucket=")}
    assert 1 <= sum(now[p] != held[p] for p in held) <= 2
    few = KB.of_sources(spark, root, ["s3.md", "none.md"])
    assert sorted(r.text for r in few.collect()) == ["new", "new"]
    assert "PartitionFilters: [bucket" in plan_text(few).replace("isnotnull(bucket", "bucket")
    assert KB.append(again.where("false"), root) == 0 and KB.open_kb(spark, root).count() == len(want)
    with pytest.raises(ValueError, match="no column"):
        KB.append(again.withColumn("lang", F.lit("en")), root)
    assert KB.build(KB.open_kb(spark, root).where("source = 's3.md'"), root) == 2  # from its own rows
    assert {r.text for r in KB.open_kb(spark, root).collect()} == {"new"}
    KB.clear(spark, root)
    assert KB.append(again, root) == 3 == KB.open_kb(spark, root).count()


def test_kb_append_below_collections(spark):
    root = tempfile.mkdtemp(prefix="docmill-kb-")
    schema = KB.KB_SCHEMA + ", year string, embedding array<float>"
    rows = [_row(f"s{i}.md", 0, "old") + (y, [1.0]) for i in range(20) for y in ("2024", "2025")]
    KB.build(spark.createDataFrame(rows, schema), root, partition_by="year", buckets=2)
    KB.append(spark.createDataFrame([_row("s1.md", 0, "new") + ("2025",)], KB.KB_SCHEMA + ", year string"), root)
    got = {(r.source, r.year): (r.text, r.embedding) for r in KB.open_kb(spark, root).collect()}
    assert len(got) == 40 and got["s1.md", "2025"] == ("new", None) and got["s1.md", "2024"] == ("old", [1.0])
    assert sum(v[0] == "old" for v in got.values()) == 39


def test_counts_are_observed_while_the_table_is_written(spark):
    rows = [("a.md", None, "é x".encode()), ("b.txt", None, b"\xff"), ("c.pdf", None, b"%PDF"), ("d.txt", None, b"y" * 20),
            ("e.json", None, b"{}")]
    from docmill.session import scratch_path
    path = scratch_path(spark, "extracted")
    counts = FS.write_extracted(_files(spark, rows).repartition(3), path, max_bytes=10)
    table = spark.read.parquet(path)
    assert "content" not in table.columns
    assert counts == {"files": 5, "ok": 2, "unsupported_pdf": 1, "too_large": 1, "invalid_utf8": 1, "chars": 5, "bytes": 31}
    assert counts["files"] == table.count() and counts["ok"] == table.where("ok").count()
    none = FS.write_extracted(_files(spark, rows).where("false"), scratch_path(spark, "extracted"))
    assert set(none.values()) == {0}


def test_appends_write_a_table_once_and_leave_it_when_they_fail(spark, tmp_path, monkeypatch):
    import pytest
    from docmill.sources import kb
    root = str(tmp_path / "kb")
    rows = lambda names, text, version=1: kb.kb_rows(spark.createDataFrame(
        [(n, "text/plain", i, 0, 1, text, version) for n in names for i in range(2)],
        "filename string, content_type string, chunk_index int, start_char int, end_char int, text string, version long"),
        carry=["version"])
    monkeypatch.setattr(kb, "_through_scratch", lambda *a: 1 / 0)  # no second copy of the table
    assert kb.build(rows("abcdef", "old"), root, buckets=3) == 12
    assert kb.append(rows(["b", None], "new", 2), root, version="version") == 4
    assert kb.append(rows("ab", "late", 1), root, version="version") == 2  # a is as old, b newer
    want = sorted([(n, "old") for n in "cdef"] * 2 + [("a", "late")] * 2 + [("b", "new")] * 2) + [(None, "new")] * 2
    read = lambda: sorted(map(tuple, kb.open_kb(spark, root).select("source", "text").collect()),
                          key=lambda r: (r[0] is None, r))
    assert read() == want
    # fails while the buckets are written
    broken = kb.open_kb(spark, root).where("source = 'c'").withColumn("start_char", F.expr("cast(text as int)"))
    with pytest.raises(Exception):
        kb.append(broken, root)
    assert read() == want
    assert kb.append(kb.open_kb(spark, root).where("source = 'c'"), root) == 2 and read() == want  # from the table itself
