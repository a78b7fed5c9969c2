"""The edge source with pushed filters, road networks in XML, durable receipts, seeded draws."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkway.operators import sampling
from sparkway.sources import edge_source, files, incumbents, road_xml, views


@pytest.fixture(scope="module")
def edge_file(tmp_path_factory):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(40)}", f"é{rng.randrange(40)}", f"e{k}", str(rng.randrange(1, 90)), f"{rng.randrange(1, 90)}/7") for k in range(700)]
    folder = tmp_path_factory.mktemp("edges")
    (folder / "a.tsv").write_text("".join("\t".join(r) + "\n" for r in rows[:400]))
    (folder / "b.tsv").write_text("\n".join("\t".join(r) for r in rows[400:]))
    (folder / "_SUCCESS").write_text("")
    return str(folder), rows


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_edge_source_gives_each_line_once(spark, edge_file, size):
    folder, rows = edge_file
    path = f"{folder}/b.tsv" if size == 1 else folder  # a range for every byte
    got = edge_source.edge_list(spark, path, max(size, 20 if size == 1 else 1)).collect()
    assert sorted(map(tuple, got)) == sorted(rows[400:] if size == 1 else rows)
    assert sorted(map(tuple, files.read_edge_list(spark, f"{folder}/*.tsv").collect())) == sorted(rows)


def test_edge_source_takes_filters(spark, edge_file):
    folder, rows = edge_file
    edges = edge_source.edge_list(spark, f"file://{folder}", 4000)
    asked = {
        "source = 'n7'": lambda r: r[0] == "n7",
        "source IN ('n7', 'n8') AND target >= 'é3'": lambda r: r[0] in ("n7", "n8") and r[1] >= "é3",
        "edge_id < 'e2' AND source LIKE 'n1%' AND length(time_s) = 1": lambda r: r[2] < "e2" and r[0].startswith("n1") and len(r[3]) == 1,
        "time_s = '5'": lambda r: r[3] == "5",
    }
    for condition, holds in asked.items():
        assert sorted(map(tuple, edges.where(condition).collect())) == sorted(r for r in rows if holds(r))


def test_plans_show_what_is_pushed(spark, data, edge_file):
    """A filter that the reader takes is gone from above the scan, one that it can't take stays; Parquet names filters and columns in its scan."""
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    above, _ = plan(edge_source.edge_list(spark, edge_file[0]).where("source = 'n7' AND time_s = '5'")).split("BatchScan", 1)
    assert "= 5" in above and "n7" not in above
    orders = plan(views.table(spark, data, "orders").where("o_custkey = 5").select("o_orderkey"))
    assert "EqualTo(o_custkey,5)" in orders and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in orders


@pytest.mark.parametrize("line", ["a\tb\te\t0\t1", "a\tb\te\t1", "a\tb\te\t1\t-2", "a\tb\te\t1\tx"])
def test_edge_source_refuses(spark, tmp_path, line):
    (tmp_path / "x.tsv").write_text(f"a\tb\te0\t1\t1\n{line}\n")
    with pytest.raises(Exception, match="positive weights"):
        edge_source.edge_list(spark, f"{tmp_path}/x.tsv").collect()


ROADS = """<?xml version="1.0"?>
<osm>
 <node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.1" lon="2.0"/><node id="3" lat="1.2" lon="2.0"><tag k="amenity" v="charging_station"/><tag k="exact:capabilities" v="S,C,S"/></node>
 <node id="4" lat="1.3" lon="2.0"><tag k="amenity" v="charging_station"/></node>
 <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="exact:time_s" v="5,6"/><tag k="exact:length_m" v="70,80"/></way>
 <way id="11"><nd ref="3"/><nd ref="4"/><tag k="highway" v="primary"/><tag k="oneway" v="yes"/><tag k="exact:time_s" v="9"/><tag k="exact:length_m" v="90"/></way>
 <way id="12"><nd ref="3"/><nd ref="9"/><tag k="highway" v="primary"/><tag k="access" v="private"/></way>
 <way id="13"><nd ref="1"/><nd ref="4"/><tag k="building" v="yes"/></way>
</osm>
"""


def test_road_xml(spark, tmp_path):
    (tmp_path / "r.osm").write_text(ROADS)
    nodes, sites, edges = road_xml.read_road_xml(spark, f"{tmp_path}/r.osm")
    assert sorted(map(tuple, nodes.collect())) == [("1", "1.0", "2.0"), ("2", "1.1", "2.0"), ("3", "1.2", "2.0"), ("4", "1.3", "2.0")]
    assert sorted((r["site"], r["offers"]) for r in sites.collect()) == [("3", ["C", "S"]), ("4", ["C"])]
    assert sorted(map(tuple, edges.collect())) == [
        ("1", "2", "way:10:1>2", "5", "70"), ("2", "1", "way:10:2>1", "5", "70"), ("2", "3", "way:10:2>3", "6", "80"),
        ("3", "2", "way:10:3>2", "6", "80"), ("3", "4", "way:11:3>4", "9", "90"),
    ]


@pytest.mark.parametrize(("old", "new", "what"), [('v="5,6"', 'v="5"', "another number"), ('v="70,80"', 'v="70,0"', "positive"), ('ref="4"/><tag k="highway"', 'ref="8"/><tag k="highway"', "don't exist"), ('v="S,C,S"', 'v="S,X"', "capabilities"), ('id="2"', 'id="1"', "repeated"), ('<tag k="exact:time_s" v="9"/>', "", "without exact")])
def test_road_xml_refuses(spark, tmp_path, old, new, what):
    assert old in ROADS
    (tmp_path / "r.osm").write_text(ROADS.replace(old, new, 1))
    with pytest.raises(ValueError, match=what):
        road_xml.read_road_xml(spark, f"{tmp_path}/r.osm")


def test_receipts_survive_a_batch_played_twice(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "problem string, turn long, payload string")
    save, path = incumbents.save_batch(f"{tmp_path}/receipts"), f"{tmp_path}/receipts"
    save(rows(("p", 1, "a"), ("p", 2, "b"), ("q", 1, "x")), 0)
    save(rows(("p", 3, "c")), 1)
    before = sorted(map(tuple, incumbents.load(spark, path).collect()))
    assert before == [("p", 3, "c"), ("q", 1, "x")]
    save(rows(("p", 3, "c")), 1)
    save(rows(("p", 1, "a"), ("p", 2, "b"), ("q", 1, "x")), 0)
    assert sorted(map(tuple, incumbents.load(spark, path).collect())) == before
    assert incumbents.load(spark, path, rows(("p", 0, ""), ("q", 0, ""))).count() == 2
    with pytest.raises(ValueError, match="other problems"):
        incumbents.load(spark, path, rows(("p", 0, "")))
    with pytest.raises(ValueError, match="take a problem"):
        save(rows((None, 1, "a")), 2)


@pytest.mark.parametrize(("column", "value", "what"), [("payload", "tampered", "checksum"), ("turn", 9, "checksum"), ("problem", "z", "checksum"), ("form", "old", "another form")])
def test_receipts_refuse_changes(spark, tmp_path, column, value, what):
    good = incumbents.sealed(spark.createDataFrame([("p", 1, "a")], "problem string, turn long, payload string"))
    good.withColumn(column, F.lit(value).cast(good.schema[column].dataType)).write.parquet(f"{tmp_path}/r/batch=0")
    with pytest.raises(ValueError, match=what):
        incumbents.load(spark, f"{tmp_path}/r")


def test_receipts_of_a_stream(spark, tmp_path):
    source = spark.createDataFrame([("p", k, f"v{k}") for k in range(9)] + [("q", 1, "w")], "problem string, turn long, payload string")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incumbents.sink(stream, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, incumbents.load(spark, f"{tmp_path}/out").collect())) == [("p", 8, "v8"), ("q", 1, "w")]


def test_draws_and_instances_by_any_partitioning(spark):
    places = spark.createDataFrame([(k, k * 1000, 0) for k in range(4)], "place long, x long, y long")
    tries = [sampling.draws(spark.range(200).repartition(n).withColumnRenamed("id", "attempt"), places, 300.0, seed) for n, seed in ((1, 5), (7, 5), (3, 6))]
    first, again, other = (sorted(map(tuple, t.collect())) for t in tries)
    assert first == again != other and len(first) == 200
    nearest = lambda v: min(range(4), key=lambda k: abs(v - 1000 * k))
    for _, ax, ay, bx, by in first:
        assert nearest(ax) != nearest(bx) and all((x - 1000 * nearest(x)) ** 2 + y**2 <= 302**2 for x, y in ((ax, ay), (bx, by)))
    nodes = spark.createDataFrame([(k, k * 100, 0) for k in range(31)], "id long, x long, y long")
    arcs = [(a, b, 2, 100) for k in range(30) for a, b in ((k, k + 1), (k + 1, k))]
    edges = spark.createDataFrame(arcs, "source long, target long, time_s long, length_m long")
    found = [sorted(map(tuple, sampling.instances(t.repartition(n), nodes, edges, nodes, [(500, 1200), (1200, 2600)], 4, 310).collect())) for n, t in ((1, tries[0]), (5, tries[1]))]
    assert found[0] == found[1] and len(found[0]) == 8
    for band, place, _, origin, end, length, time in found[0]:
        low, high = ((500, 1200), (1200, 2600))[band]
        assert 1 <= place <= 4 and length == 100 * abs(origin - end) and time == 2 * abs(origin - end) and low <= length < high
    with pytest.raises(ValueError, match="too few"):
        sampling.instances(tries[0], nodes, edges, nodes, [(5000, 9000)], 1, 310)


def test_chains(spark):
    trees = spark.createDataFrame([(1, k + 1, k) for k in range(50)] + [(1, 0, None), (2, 0, 5), (2, 5, None)], "root long, node long, parent long")
    ends = spark.createDataFrame([(1, 50), (1, 13), (2, 0), (2, 9)], "root long, node long")
    got = sorted(map(tuple, sampling.chains(trees, ends).collect()))
    assert got == sorted([(1, 50, s, 50 - s) for s in range(51)] + [(1, 13, s, 13 - s) for s in range(14)] + [(2, 0, 0, 0), (2, 0, 1, 5), (2, 9, 0, 9)])
