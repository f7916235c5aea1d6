"""Copies of boxes and places cost rows, not pairs; sides of a join are sent by their number of rows."""

import pytest

from netloom import catalog
from netloom.operators import geometry, graph

SF = "/root/testdata/sf0.001"


@pytest.fixture
def met(monkeypatch):
    """Rows of every meeting of points and boxes, and of every list of touching pairs."""
    rows = []
    for name in ("points_in_boxes", "touching"):
        monkeypatch.setattr(geometry, name, lambda *a, f=getattr(geometry, name): (rows.append((out := f(*a)).count()), out)[1])
    return rows


def tables(spark, path, parts, suppliers):
    spark.range(parts).selectExpr("id AS p_partkey", "CAST(1 + id % 2 * 20 AS int) AS p_size", "CAST(950 + id % 3 AS double) AS p_retailprice").write.parquet(f"{path}/part.parquet")
    spark.range(suppliers).selectExpr("id * 1980 AS s_suppkey", "CAST(id % 4 AS int) AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_copies_of_boxes_and_points_meet_once(spark, tmp_path, met):
    sf = tables(spark, tmp_path, 60, 500)
    found = catalog.queries()["boxes_of_every_size"](spark, sf)
    assert {(r.n, r.box) for r in found.collect()} == {(0, None)}
    points = spark.range(40).selectExpr("id AS point", "CAST(id % 2 AS double) AS x", "1.0D AS y")
    boxes = spark.range(300).selectExpr("id + 7 AS box", "0.5D AS x0", "0.0D AS y0", "2.0D AS x1", "IF(id < 100, 2.0D, 3.0D) AS y1")
    assert {tuple(r) for r in geometry.counted(points, boxes, 1.0).select("point", "n", "box").collect()} == {(i, 300 if i % 2 else 0, 7 if i % 2 else None) for i in range(40)}
    assert {r.point for r in geometry.stitched(points, boxes.where("box < 20"), boxes.where("box > 200"), 1.0).collect()} == set(range(1, 40, 2))
    assert met and max(met) <= 2


def test_copies_are_tied_to_the_first(spark, met):
    rows = [(k, k % 2, 0.0, 0.0, 2.0, 2.0) for k in range(200)] + [(k, 0, 2.0, 1.0, 3.0, 1.0) for k in range(200, 300)] + [(k, 1, 9.0, 9.0, 9.0, 9.0) for k in range(300, 310)] + [(310, 1, 2.0, 2.0, 5.0, 5.0), (311, 0, None, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "box long, layer int, x0 double, y0 double, x1 double, y1 double")
    got = {r.node: r.root for r in graph.connected_components(geometry.linked(boxes, 1.0)).collect()}
    # lines are tied to equal lines, points (300 to 309) are not; a corner (310) and a null tie nothing
    assert got == {k: k % 2 if k < 200 else 200 for k in range(300)}
    assert met == [0]


def test_rings_meet_each_place_once(spark, met):
    points = spark.range(400).selectExpr("id AS point", "0.25D AS x", "0.5D AS y")
    square = "array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 1.0D, 'y', 0.0D), named_struct('x', 1.0D, 'y', 1.0D), named_struct('x', 0.0D, 'y', 1.0D))"
    assert geometry.rings_at(points, spark.range(3).selectExpr("id", f"{square} AS ring"), 1.0).count() == 1200
    assert max(met) <= 3


def test_the_way_of_a_join_changes_no_row(spark, monkeypatch):
    seen = {}
    for few in (0, 1 << 14):
        monkeypatch.setattr(geometry, "FEW", few)
        for name in ("point_in_region", "points_in_rings"):
            frame = catalog.queries()[name](spark, SF)
            assert ("BroadcastExchange" in frame._jdf.queryExecution().executedPlan().toString()) == (few > 0)
            rows = sorted(map(tuple, frame.collect()), key=str)
            assert seen.setdefault(name, rows) == rows
