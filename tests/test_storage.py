"""Scratch tables that go with their scope, and tables that several results share."""

import os

import pytest

from ripplenet import storage
from ripplenet.operators import traversal


def tables(root):
    return sorted(os.listdir(f"{root}/ripplenet-tables")) if os.path.isdir(f"{root}/ripplenet-tables") else []


def test_scope_removes_what_was_written_in_it(spark, tmp_path):
    root = storage.scratch_root(spark)
    kept = storage.materialize(spark.range(3), "kept")
    before, names = tables(root), {t.name for t in spark.catalog.listTables()}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0, 1)], "run_id bigint, v bigint")
    with storage.scratch(spark):
        adj = traversal.build_adjacency(edges)
        with storage.scratch(spark):
            inner = storage.materialize(spark.range(5), "inner")
            assert inner.count() == 5
        found = traversal.wave_distance(adj, seeds, 3)
        found.write.parquet(str(tmp_path / "found"))
        assert len(tables(root)) == len(before) + 1 and {t.name for t in spark.catalog.listTables()} != names
    assert tables(root) == before and {t.name for t in spark.catalog.listTables()} == names
    assert kept.count() == 3
    assert {(r.v, r.d) for r in spark.read.parquet(str(tmp_path / "found")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_scope_ends_after_an_error(spark):
    before = tables(storage.scratch_root(spark))
    with pytest.raises(ValueError), storage.scratch(spark):
        storage.materialize(spark.range(5))
        raise ValueError
    assert tables(storage.scratch_root(spark)) == before and not storage._scopes


def test_shared_tables_follow_their_inputs(spark, tmp_path):
    path, built = str(tmp_path / "input"), []
    spark.range(4).write.parquet(path)

    def build():
        built.append(1)
        return spark.read.parquet(path).selectExpr("sum(id) AS s")

    assert [storage.shared(spark, "sum", [path], build).first()["s"] for _ in range(2)] == [6, 6] and len(built) == 1
    spark.range(7).write.mode("append").parquet(path)
    assert storage.shared(spark, "sum", [path], build).first()["s"] == 27 and len(built) == 2
    with storage.scratch(spark):
        assert storage.shared(spark, "other", [path], build).first()["s"] == 27 and len(built) == 3
    assert storage.shared(spark, "other", [path], build).first()["s"] == 27 and len(built) == 4


def test_settled_tables_remove_what_they_were_made_of(spark):
    root = storage.scratch_root(spark)
    before = tables(root)
    found = storage.settled(spark, "kept", lambda: storage.materialize(spark.range(7), "inner").selectExpr("id + 1 AS x"))
    assert found.agg({"x": "sum"}).first()[0] == 28
    (new,) = set(tables(root)) - set(before)
    assert new.startswith("kept-") and spark.conf.get(storage.FREED_SHUFFLES) == "false"


def test_shuffle_files_go_with_their_write(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.endswith(".data")}

    before = files()
    written = storage.materialize(spark.range(5000).repartition(7, "id"))
    assert not files() - before
    assert written.count() == 5000


def test_shared_tables_remove_what_they_were_made_of(spark, tmp_path):
    path, root = str(tmp_path / "input"), storage.scratch_root(spark)
    spark.range(4).write.parquet(path)
    before = tables(root)
    storage.shared(spark, "lasting", [path], lambda: storage.materialize(spark.read.parquet(path), "inner"))
    (new,) = set(tables(root)) - set(before)
    assert new.startswith("lasting-")
