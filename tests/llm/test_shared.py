from types import SimpleNamespace

import pytest

from llm.shared import shared_folder


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_folder(session("spark://a:7077", "hdfs://a/b/")) == "hdfs://a/b"
    own = session("local[2]")
    assert shared_folder(own).startswith("file:///") and shared_folder(own) == shared_folder(own)
    with pytest.raises(ValueError):
        shared_folder(session("spark://a:7077"))
