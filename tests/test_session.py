"""The shared folder: where derived tables go, and that they go away."""

import os

import pytest

from docmill.session import checkpoint_dir, remove_scratch, scratch_path
from docmill.sources.scratch import written


def test_written_tables_are_removed(spark):
    remove_scratch(spark)
    df = written(spark.range(5), "test")
    assert df.count() == 5
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and path.startswith(checkpoint_dir(spark).removeprefix("file:").replace("//", "/"))
    assert remove_scratch(spark) == 1 and not os.path.exists(path) and remove_scratch(spark) == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
