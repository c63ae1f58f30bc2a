"""Tables in the shared folder."""

import os

import pytest

from alertloom.session import drop_tables, materialize, shared_dir


def test_tables_are_written_to_the_shared_folder_and_dropped(spark):
    df = materialize(spark.range(5).selectExpr("id", "id % 2 AS part"), "t")
    assert df.count() == 5 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    assert materialize(spark.range(0), "empty").count() == 0
    folder = f"{shared_dir(spark).removeprefix('file://')}/alertloom/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    drop_tables(spark)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
