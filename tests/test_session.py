from types import SimpleNamespace

import pytest

from tierlabel.session import scratch_path, shared_folder


def session(master, **conf):
    context = SimpleNamespace(master=master, applicationId="app-of-test")
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=context)


def test_the_named_folder_is_used():
    named = session("spark://host", **{"spark.checkpoint.dir": "/shared/"})
    assert shared_folder(named) == "/shared/"
    assert scratch_path(named, "a").startswith("/shared/a-")


def test_a_local_session_without_a_folder_keeps_one():
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError):
        shared_folder(session("spark://host"))
