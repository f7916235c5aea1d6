import json
import struct

import pytest
from pyspark.sql import functions as F

from netloom.functions.cells import BASIC_CELLS, cell_frame, collect_cells
from netloom.operators import geometry, graph
from netloom.sources import catalogue, gds, netlist_json, vcd

DUMP = """$date now $end
$var reg 1 ! clk $end
$var reg 1 # enable $end
$var reg 1 $ I $end
$var wire 8 % O [7:0] $end
$enddefinitions $end
#0
x$
0!
#5
1!
1#
#10
0!
1$
b101 %
#15
1!
#20
0!
0#
#25
1!
#30
0!
1#
#35
1!
"""


def test_waveform(spark, tmp_path):
    path = tmp_path / "a.vcd"
    path.write_text(DUMP)
    lines = vcd.read_lines(spark, str(path))
    assert {r.name for r in vcd.signals(lines).collect()} == {"clk", "enable", "I"}
    edges = vcd.at_rising_edges(vcd.changes(lines), ["clk", "enable", "I"])
    assert [(r.time, r.enable, r.I) for r in edges.orderBy("line_no").collect()] == [(5, 0, 0), (15, 1, 1), (25, 0, 1), (35, 1, 1)]
    assert [(r.attempt, r.pos) for r in vcd.attempts(edges).orderBy("line_no").collect()] == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        vcd.at_rising_edges(vcd.changes(lines), ["I"], "clk")
    runs = spark.createDataFrame([("d", 0, i, int(b)) for i, b in enumerate("00010101000" + "11000101000")], "dump string, attempt int, pos int, bit int")
    assert vcd.words(runs, "bit").first().text == chr(int("00010101000"[::-1], 2)) + chr(int("11000101000"[::-1], 2))


def test_dumps_of_one_folder_stay_apart(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.vcd").write_text(DUMP)
    lines = vcd.read_lines(spark, str(tmp_path))
    edges = vcd.at_rising_edges(vcd.changes(lines), ["clk", "enable", "I"])
    for _, own in edges.toPandas().groupby("dump"):
        assert own.sort_values("line_no")[["time", "enable", "I"]].values.tolist() == [[5, 0, 0], [15, 1, 1], [25, 0, 1], [35, 1, 1]]
    assert vcd.attempts(edges).count() == 4


def record(kind, body=b""):
    return struct.pack(">HBB", len(body) + 4, kind, 0) + body


def real8(x):
    exponent = 64
    while x >= 1:
        x, exponent = x / 16, exponent + 1
    while x and x < 1 / 16:
        x, exponent = x * 16, exponent - 1
    return bytes([exponent]) + int(x * 2**56).to_bytes(7, "big")


def xy(*points):
    return record(gds.XY, b"".join(struct.pack(">ii", *p) for p in points))


def name(s):
    return s.encode() + b"\0" * (len(s) % 2)


def stream():
    box = record(gds.BOUNDARY) + record(gds.LAYER, struct.pack(">h", 68)) + record(gds.DATATYPE, struct.pack(">h", 20)) + xy((0, 0), (2000, 0), (2000, 1000), (0, 1000), (0, 0)) + record(gds.ENDEL)
    label = record(gds.TEXT) + record(gds.LAYER, struct.pack(">h", 67)) + record(gds.TEXTTYPE, struct.pack(">h", 5)) + xy((500, 250)) + record(gds.STRING, name("A")) + record(gds.ENDEL)
    turned = record(gds.SREF) + record(gds.SNAME, name("leaf")) + record(gds.STRANS, b"\x80\x00") + record(gds.ANGLE, real8(90.0)) + xy((10_000, 0)) + record(gds.ENDEL)
    grid = record(gds.AREF) + record(gds.SNAME, name("leaf")) + record(gds.COLROW, struct.pack(">hh", 2, 1)) + xy((0, 5000), (8000, 5000), (0, 6000)) + record(gds.ENDEL)
    return record(gds.UNITS, real8(0.001) + real8(1e-9)) + record(gds.STRNAME, name("leaf")) + box + label + record(gds.ENDSTR) + record(gds.STRNAME, name("top1")) + turned + grid + record(gds.ENDSTR)


def test_layout(spark, tmp_path):
    (tmp_path / "a.gds").write_bytes(stream())
    rows = gds.read_elements(spark, str(tmp_path / "a.gds"))
    assert [r.cell for r in gds.top_cells(rows).collect()] == ["top1"]
    flat = gds.flatten(rows)
    labels = sorted((round(r.x, 6), round(r.y, 6)) for r in flat.where("kind = 'label'").collect())
    assert labels == [(0.5, 5.25), (4.5, 5.25), (10.25, 0.5)]
    rings = [sorted((round(p.x, 6), round(p.y, 6)) for p in r.ring) for r in flat.where("kind = 'boundary' AND size(path) = 1").orderBy("path").collect()]
    assert rings[0] == [(10.0, 0.0), (10.0, 2.0), (11.0, 0.0), (11.0, 2.0)]


def test_extraction_by_tiles(spark):
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 4.0, 1.0), (1, 1, 4.0, 0.0, 9.0, 1.0), (2, 1, 9.0, 1.0, 12.0, 2.0), (3, 2, 8.0, 0.0, 9.0, 5.0), (4, 1, 50.0, 50.0, 51.0, 51.0)], "box int, layer int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.u, r.v) for r in geometry.touching(boxes, 3.0).collect()} == {(0, 1)}  # box 2 meets box 1 at a corner only
    cuts = spark.createDataFrame([(0, 8.5, 0.5), (1, 3.0, 0.5), (2, 4.0, 1.0)], "point int, x double, y double")
    low, high = boxes.where("layer = 1").drop("layer"), boxes.where("layer = 2").drop("layer")
    assert [tuple(r) for r in geometry.stitched(cuts, low, high, 3.0).collect()] == [(0, 1, 3)]
    assert {r.point: r.box for r in geometry.first_region(cuts, low, 3.0).collect()} == {0: 1, 1: 0, 2: 0}
    regions = graph.connected_components(geometry.touching(boxes, 3.0).unionByName(geometry.stitched(cuts, low, high, 3.0).selectExpr("low_box AS u", "high_box AS v")))
    assert {r.node: r.root for r in regions.collect()} == {0: 0, 1: 0, 3: 0}
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0))])
    got = spark.createDataFrame([(3.5, 3.0), (2.0, 3.0), (3.0, 1.0), (9.0, 1.0)], "x double, y double").select(geometry.in_ring(F.col("x"), F.col("y"), ring)).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_catalogue(spark, tmp_path):
    cells = {c.cell_type: {"description": "", "inputs": list(c.inputs), "outputs": c.outputs, "clock_pins": list(c.clock_pins), "reset_pins": list(c.reset_pins), "set_pins": list(c.set_pins), "sequential": c.sequential, "clocked_on": c.clocked_on, "next_state": c.next_state, "clear": c.clear, "preset": c.preset} for c in BASIC_CELLS.values()}
    path = tmp_path / "cells.json"
    path.write_text(json.dumps({"schema_version": 1, "source": "s", "source_revision": "0" * 40, "liberty_corner": "tt", "cells": cells}))
    read = catalogue.read_cells(spark, str(path))
    assert collect_cells(read) == BASIC_CELLS
    assert catalogue.differences(cell_frame(spark), read).isEmpty()
    other = read.where("cell_type <> 'inv'").withColumn("inputs", F.when(F.col("cell_type") == "buf", F.array(F.lit("B"))).otherwise(F.col("inputs")))
    assert {tuple(r) for r in catalogue.differences(cell_frame(spark), other).collect()} == {("inv", "not in the snapshot"), ("buf", "pins differ")}


def test_library_import(spark, tmp_path):
    flop = {"pin,D": {"direction": "input"}, "pin,CLK": {"direction": "input"}, "pin,RESET_B": {"direction": "input"}, "pin,Q": {"direction": "output", "function": "IQ"}, "ff,IQ,IQ_N": {"clocked_on": "CLK", "next_state": "D", "clear": "!RESET_B"}, "area": 3}
    gate = {"pin,A": {"direction": "input"}, "pin,B": {"direction": "input"}, "pin,X": {"direction": "output", "function": "(A&B)"}}
    (tmp_path / "lib__dfrtp_1__tt.json").write_text(json.dumps(flop))
    (tmp_path / "lib__and2_0__tt.json").write_text(json.dumps(gate))
    rows = {r.cell_type: r for r in catalogue.import_cells(spark, f"{tmp_path}/*.json").drop("output_functions").collect()}
    assert rows["dfrtp"].inputs == ["D"] and rows["dfrtp"].clock_pins == ["CLK"] and rows["dfrtp"].reset_pins == ["RESET_B"] and rows["dfrtp"].sequential
    assert rows["and2"].inputs == ["A", "B"] and not rows["and2"].sequential


def test_netlist_round_trip(spark, tmp_path):
    nets = spark.createDataFrame([("n0", [], ["a_inv.Y", "b_inv.A"]), ("n1", ["in"], ["a_inv.A"])], "net string, aliases array<string>, terminals array<string>")
    netlist_json.write_nets(nets, str(tmp_path / "out"))
    back = netlist_json.read_nets(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nets.collect()))
