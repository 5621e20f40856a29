"""The shared folder for checkpoints."""

from types import SimpleNamespace

import pytest

from pairwell.session import checkpoint_root


def session(master, named):
    found = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: found[-1] if found else None, setCheckpointDir=found.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_a_cluster_has_to_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session("spark://host:7077", None))
    assert checkpoint_root(session("spark://host:7077", "/shared")) == "/shared"


def test_a_local_session_may_use_a_temporary_folder():
    assert checkpoint_root(session("local[2]", None)).startswith("/tmp/spark-")
