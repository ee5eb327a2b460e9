"""Upload batches packed in tar archives, so that millions of small files are a
few listings: a batch and stream source on Spark's Python Data Source API.

``tar_files`` gives the columns of ``files.read_files`` plus ``archive``. An
archive is split by byte ranges: a task walks the headers with seeks and reads
the members whose header starts in its range, one at a time, so one archive may
hold most files. Directories and links aren't rows; a damaged archive fails the
query. The folder must be mounted on every node (Python opens the archives), and
archives are uncompressed. As a stream, archives are taken in the order of their
names: a batch that comes later must have a greater name.
"""

from __future__ import annotations

import os
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "filename string, content_type string, content binary, length long, path string, archive string"
SPLIT_BYTES = 128 << 20


class Split(InputPartition):
    """Members of ``archive`` whose header starts in [start, stop)."""

    def __init__(self, archive: str, start: int, stop: int):
        super().__init__((archive, start, stop))
        self.archive, self.start, self.stop = archive, start, stop


def _local(path: str) -> str:
    """A mounted folder's path from a ``file:`` URI or a plain path."""
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path


def _archives(options) -> list[str]:
    return sorted(glob(os.path.join(_local(options["path"]), options.get("glob", "*.tar"))))


def _splits(archives: list[str], options) -> list[Split]:
    step = int(options.get("splitbytes", SPLIT_BYTES))
    return [Split(a, at, at + step) for a in archives for at in range(0, max(1, os.path.getsize(a)), step)]


def _members(split: Split):
    import tarfile
    with tarfile.open(split.archive, "r:") as tar:
        while (member := tar.next()) is not None and member.offset < split.stop:
            if member.offset >= split.start and member.isreg():
                yield (os.path.basename(member.name), None, tar.extractfile(member).read(), member.size,
                       member.name, os.path.basename(split.archive))
            tar.members = []  # tarfile remembers every member otherwise


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return _splits(_archives(self.options), self.options)

    def read(self, partition):
        return _members(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        names = _archives(self.options)
        return {"last": os.path.basename(names[-1]) if names else ""}

    def partitions(self, start, end):
        new = [a for a in _archives(self.options) if start["last"] < os.path.basename(a) <= end["last"]]
        return _splits(new, self.options)

    def read(self, partition):
        return _members(partition)


class TarFiles(DataSource):
    @classmethod
    def name(cls):
        return "tar_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def read_packed(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files in the archives of a folder (options: ``glob``, ``splitbytes``)."""
    spark.dataSource.register(TarFiles)
    return spark.read.format("tar_files").options(**options).load(path)


def stream_packed(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream of new archives."""
    spark.dataSource.register(TarFiles)
    return spark.readStream.format("tar_files").options(**options).load(path)


def write_packed(files: DataFrame, path: str, archives: int, prefix: str = "batch") -> int:
    """Pack ``filename``, ``content`` (NULL: empty) into that many archives, dealt by
    hash of name and content; returns the number of files. A task writes beside its
    archive and renames at its end, so a task that runs again leaves one whole archive."""
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)

    def pack(batches):
        import io
        import tarfile

        import pyarrow as pa
        from pyspark import TaskContext
        task, count = TaskContext.get(), 0
        target = os.path.join(folder, f"{prefix}-{task.partitionId():06d}.tar")
        part = f"{target}.{task.taskAttemptId()}.part"
        with tarfile.open(part, "w") as tar:
            for batch in batches:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    body = body.as_py() or b""
                    info = tarfile.TarInfo(name)
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body))
                    tar.members = []
                    count += 1
        os.replace(part, target)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])

    dealt = files.select("filename", "content").repartition(archives, F.xxhash64("filename", "content"))
    return dealt.mapInArrow(pack, "files long").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]
