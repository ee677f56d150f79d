from types import SimpleNamespace

import pytest

from vacantia import session


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: folder), sparkContext=SimpleNamespace(master=master))


def test_checkpoint_root():
    assert session.checkpoint_root(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert session.checkpoint_root(fake("local[2]")) == session.checkpoint_root(fake("local[2]"))
    with pytest.raises(RuntimeError):
        session.checkpoint_root(fake("yarn"))
    assert session.scratch_path(fake("yarn", "/s/"), "x").startswith("/s/vacantia-x-")


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    df = session.cut_lineage(spark.range(5).selectExpr("id * 2 AS id"))
    assert sorted(r["id"] for r in df.collect()) == [0, 2, 4, 6, 8]
    assert "Project" not in df._jdf.queryExecution().optimizedPlan().toString()
