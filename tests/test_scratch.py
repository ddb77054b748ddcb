import pytest
from plumbline.sources import scratch


class Unset:
    """A session in which spark.checkpoint.dir is not set and cannot be."""

    class conf:
        @staticmethod
        def get(key, default=None):
            assert key == "spark.checkpoint.dir"
            return default

    class sparkContext:
        master, applicationId = "local[4]", "app-without-a-folder"


def test_folder_where_none_is_named():
    first = scratch.folder(Unset)
    assert first.startswith("file:///") and scratch.folder(Unset) == first


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master, monkeypatch):
    monkeypatch.setattr(Unset.sparkContext, "master", master)
    with pytest.raises(RuntimeError, match="share"):
        scratch.folder(Unset)


def test_settled_tables_are_tables(spark):
    df = scratch.settled(spark.range(5), "test")
    assert df.count() == 5 and df.inputFiles()
    scratch.drop(df)
