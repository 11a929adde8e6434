import pytest

from gaugeworks import storage
from gaugeworks.operators import grids


class _Conf(dict):
    def set(self, k, v):
        self[k] = v


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf({k.replace("__", "."): v for k, v in conf.items()})


def test_shared_folder():
    assert storage.shared_folder(_Session(spark__checkpoint__dir="hdfs://x/y/")) == "hdfs://x/y"
    one = _Session(spark__master="local[4]")
    assert storage.shared_folder(one).startswith("file://") and storage.shared_folder(one) == storage.shared_folder(one)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", ""):
        with pytest.raises(RuntimeError):
            storage.shared_folder(_Session(spark__master=master))


def test_saved_tables_are_cleared(spark):
    a, b = storage.save(spark.range(3), "a"), storage.save(spark.range(4), "b")
    assert (a.count(), b.count()) == (3, 4)
    storage.discard(a)
    assert a._saved_at not in storage._WRITTEN and storage.clear(spark) >= 1 and not storage._WRITTEN


def test_pairs_must_match(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, label int, score double")
    got = grids.paired(rows(("a", 1, 0.9), ("b", None, 0.1)), rows(("b", None, 0.2), ("a", 1, 0.8))).orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0.9, 0.8), ("b", None, 0.1, 0.2)]
    for other in (rows(("a", 1, 0.8)), rows(("a", 0, 0.8), ("b", None, 0.1)), rows(("a", 1, 0.8), ("b", None, 0.1), ("b", None, 0.1))):
        with pytest.raises(ValueError):
            grids.paired(rows(("a", 1, 0.9), ("b", None, 0.1)), other)
