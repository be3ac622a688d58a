from __future__ import annotations

import pytest
from spanloom.operators import staging


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, told=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": told} if told else {}


def test_checkpoints_go_to_the_shared_folder():
    s = Session("spark://host:7077", told="/shared/x")
    staging.ensure_checkpoint_dir(s)
    assert s.sparkContext.folder == "/shared/x"
    s = Session("spark://host:7077", folder="/already")
    staging.ensure_checkpoint_dir(s)
    assert s.sparkContext.folder == "/already"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.ensure_checkpoint_dir(Session("yarn"))
    s = Session("local[4]")
    staging.ensure_checkpoint_dir(s)
    assert s.sparkContext.folder.endswith("spanloom-checkpoints")


def test_spread_without_a_plan():
    class Remote:
        pass

    df = Remote()
    assert staging.spread(df) is df
