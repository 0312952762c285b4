import os

import pytest

from readloom import session


def test_materialised_tables_are_removed(spark):
    df = session.materialise(spark.range(5), "test")
    path = session._made[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.clean(spark) >= 1 and not os.path.exists(path) and session.clean(spark) == 0


class Conf(dict):
    def set(self, k, v):
        self[k] = v


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        session.shared_dir(Session(spark_master="yarn"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session(spark_master="local-cluster[2,1,1024]"))
    assert session.shared_dir(Session(spark_master="local[2]")).startswith("file:///")
    assert session.shared_dir(Session(**{"spark_master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
