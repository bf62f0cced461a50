"""The shared folder: whose it is, and what is deleted."""

from types import SimpleNamespace

import pytest

from quern import checkpoints


class Session:
    """As much of a session as the folder needs."""

    def __init__(self, master, named=None):
        self.values = {}
        conf = {checkpoints.KEY: named} if named else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: conf)
        self.conf = SimpleNamespace(get=self.values.get, set=self.values.__setitem__)


def test_the_cluster_names_the_folder():
    assert checkpoints.shared_folder(Session("spark://host:7077", "hdfs://names/shared/")) == "hdfs://names/shared/quern-app-1"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_a_cluster_without_a_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        checkpoints.shared_folder(Session(master))


def test_one_process_makes_its_own_folder():
    session = Session("local[4]")
    assert checkpoints.shared_folder(session) == checkpoints.shared_folder(session)


def test_release_leaves_other_applications_alone(spark, tmp_path, monkeypatch):
    (tmp_path / "theirs").mkdir()
    monkeypatch.setattr(checkpoints, "shared_folder", lambda s: f"file://{tmp_path}/quern-mine")
    assert checkpoints.written(spark.range(3), "rows").count() == 3
    checkpoints.release(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["theirs"]
