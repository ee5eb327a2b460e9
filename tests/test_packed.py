"""Tar archives as a batch and stream source."""

import tempfile

from pyspark.sql import functions as F

from docmill.sources import packed


def _rows(df):
    return sorted((r.filename, bytes(r.content), r.length) for r in df.collect())


def test_archives_read_back_whole_at_any_split(spark):
    folder = tempfile.mkdtemp(prefix="docmill-tar-")
    want = [(f"f{i}.txt", bytes([i % 256]) * (i * 37 % 3000), i * 37 % 3000) for i in range(300)] + \
        [("x" * 180 + ".txt", b"long name", 9), ("é.txt", "ß".encode(), 2), ("f1.txt", b"a second one", 12)]
    files = spark.createDataFrame([w[:2] for w in want] + [("none.txt", None)], "filename string, content binary")
    assert packed.write_packed(files, folder, 3) == len(want) + 1
    want = sorted(want + [("none.txt", b"", 0)])
    for size in (1000, 100_000, packed.SPLIT_BYTES):
        assert _rows(packed.read_packed(spark, folder, splitbytes=size)) == want
    assert packed.read_packed(spark, folder, glob="*-000001.tar").select("archive").distinct().count() == 1
    assert packed.read_packed(spark, tempfile.mkdtemp(prefix="docmill-tar-")).count() == 0


def test_stream_takes_each_new_archive_once(spark):
    folder, out = (tempfile.mkdtemp(prefix="docmill-tar-") for _ in range(2))

    def put(prefix, names):
        files = spark.createDataFrame([(n, n.encode()) for n in names], "filename string, content binary")
        packed.write_packed(files, folder, 1, prefix)

    def run():
        stream = packed.stream_packed(spark, folder).select("filename", F.col("archive"))
        q = stream.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c") \
            .trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted(r.filename for r in spark.read.parquet(f"{out}/t").collect())

    put("a", ["1.txt", "2.txt"])
    assert run() == ["1.txt", "2.txt"]
    put("b", ["3.txt"])
    assert run() == ["1.txt", "2.txt", "3.txt"]
    assert run() == ["1.txt", "2.txt", "3.txt"]
