from types import SimpleNamespace

import pytest

from ledgerloom import session


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_the_named_folder_is_used():
    assert session.shared_folder(fake("spark://host", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert session.scratch_path(fake("yarn", "/shared"), "t").startswith("/shared/t-")


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError):
        session.shared_folder(fake("yarn"))


def test_local_falls_back_to_one_folder():
    assert session.shared_folder(fake("local[2]")) == session.shared_folder(fake("local[2]"))
