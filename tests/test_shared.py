"""The shared folder and what is left in it."""

import os
from types import SimpleNamespace

import pytest

from netloom import shared


def folders(spark):
    return set(os.listdir(shared.shared_folder(spark).removeprefix("file://")))


def test_scratch_leaves_the_last_table(spark):
    before = folders(spark) if spark.conf.get("spark.checkpoint.dir", None) else set()
    with shared.scratch(spark):
        with shared.scratch(spark):
            shared.cut(spark.range(3), "one")
            two = shared.cut(spark.range(4), "two")
        three = shared.cut(two, "three")
    assert {x.split("-")[0] for x in folders(spark) - before} == {"three"} and three.count() == 4
    with shared.scratch(spark, keep=0):
        shared.cut(spark.range(3), "gone")
    assert not any(x.startswith("gone") for x in folders(spark))


def test_a_cluster_has_to_name_its_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="not set"):
            shared.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf)))
