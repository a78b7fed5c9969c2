"""Sources, sinks, validated tables and the streaming addition."""

from __future__ import annotations

import pytest

from sparkway.operators import tables
from sparkway.sources import files
from sparkway.streaming import receipts


def test_edge_list_round_trip(spark, tmp_path):
    rows = [("a", "b", "e1", "3", "7"), ("b", "a", "e2", "1/3", "123456789012345678901234567890123456789012345/2")]
    edges = spark.createDataFrame(rows, files.EDGE_SCHEMA)
    files.write_edge_list(edges, f"{tmp_path}/edges")
    assert sorted(map(tuple, files.read_edge_list(spark, f"{tmp_path}/edges").collect())) == rows
    with pytest.raises(Exception, match="already exists"):
        files.write_edge_list(edges, f"{tmp_path}/edges")


@pytest.mark.parametrize("line, what", [("a\tb\te1\t0\t5", "positive"), ("a\tb\te1\t1\t-5", "positive"), ("a\tb\te1\t1\t5\nb\ta\te1\t1\t5", "repeated")])
def test_edge_list_refuses(spark, tmp_path, line, what):
    (tmp_path / "edges.tsv").write_text(line + "\n")
    with pytest.raises(ValueError, match=what):
        files.read_edge_list(spark, f"{tmp_path}/edges.tsv")


def test_strict_json(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"role": "graph", "bytes": 3}\n{"role": "catalog", "bytes": 4}\n')
    (tmp_path / "more.json").write_text('{"role": "graph", "bytes": 3, "other": 1}\n')
    read = files.read_strict_json(spark, f"{tmp_path}/good.json", "role string, bytes long")
    assert read.count() == 2
    with pytest.raises(ValueError, match="outside"):
        files.read_strict_json(spark, f"{tmp_path}/more.json", "role string, bytes long")
    need = spark.createDataFrame([("graph",), ("bindings",)], "role string")
    assert [r["role"] for r in files.missing_roles(read, need).collect()] == ["bindings"]


def test_boundary(spark, tmp_path):
    (tmp_path / "area.poly").write_text("area\nouter\n  0.0 0.0\n  1.0E+01 0.0\n  10 10\nEND\n!hole\n 1 1\n 2 1\n 2 2\nEND\nEND\n")
    rows = files.read_boundary(spark, f"{tmp_path}/area.poly").orderBy("seq").collect()
    assert [(r["hole"], r["lon"], r["lat"]) for r in rows] == [(False, 0, 0), (False, 10, 0), (False, 10, 10), (True, 1, 1), (True, 2, 1), (True, 2, 2)]


def test_validated_tables(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    assert tables.one_to_one(left, left.withColumnRenamed("x", "y"), "k").count() == 2
    with pytest.raises(ValueError, match="on the right"):
        tables.one_to_one(left, left.union(left).withColumnRenamed("x", "y"), "k")


def test_stream_gives_what_the_batch_gives(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    receipts.drained(receipts.windowed_counts(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/state")
    want = receipts.windowed_counts(batch)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/out").collect())) == sorted(map(tuple, want.collect()))
