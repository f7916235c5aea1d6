"""A stream to a netlist, its inventory, library import, the one-document export and the player."""

import json
import struct
from pathlib import Path

import pytest

from netloom import cli, report
from netloom.functions.cells import LIBRARY, cell_frame
from netloom.operators import graph, simulate
from netloom.operators.design import Design
from netloom.operators.layout import Layout
from netloom.operators.play import Player
from netloom.operators.simulate import Circuit
from netloom.plans import designs
from netloom.sources import catalogue, gds, netlist_json
from tests.test_sources import name, real8, record, xy


def short(kind, value):
    return record(kind, struct.pack(">h", value))


def box(layer, datatype, x0, y0, x1, y1):
    return record(gds.BOUNDARY) + short(gds.LAYER, layer) + short(gds.DATATYPE, datatype) + xy((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)) + record(gds.ENDEL)


def label(text, layer, x, y):
    return record(gds.TEXT) + short(gds.LAYER, layer) + short(gds.TEXTTYPE, 5) + xy((x, y)) + record(gds.STRING, name(text)) + record(gds.ENDEL)


def ref(cell, x, y):
    return record(gds.SREF) + record(gds.SNAME, name(cell)) + xy((x, y)) + record(gds.ENDEL)


def cell(title, *body):
    return record(gds.STRNAME, name(title)) + b"".join(body) + record(gds.ENDSTR)


def two_inverters(extra=b""):
    """in -> U0 -> U1 -> out, the outer wires one sheet up; a filler with a label, a pin and a port in no region."""
    inv = cell(LIBRARY + "inv_1", box(67, 20, 0, 0, 1000, 1000), box(67, 20, 2000, 0, 3000, 1000), label("A", 67, 500, 500), label("Y", 67, 2500, 500), label("LOST", 67, 1500, 500))
    fill = cell(LIBRARY + "fill_1", label("A", 67, 500, 500))
    via = cell("VIA_M1", box(67, 44, 0, 0, 200, 200))
    top = cell(
        "chip", ref(LIBRARY + "inv_1", 0, 0), ref(LIBRARY + "fill_1", 0, 0), ref(LIBRARY + "inv_1", 10000, 0), ref("VIA_M1", 400, 400), box(67, 20, 3000, 0, 10000, 1000),
        box(68, 20, -5000, 0, 1000, 1000), label("in", 68, -4000, 500), label("out", 67, 12500, 500), label("nowhere", 69, 50, 50),
    )
    return record(gds.UNITS, real8(0.001) + real8(1e-9)) + inv + fill + via + top + extra


def run(spark, *args):
    return cli.run(spark, cli.parser().parse_args([*args]))


def text_of(path):
    return "\n".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_layout_to_netlist(spark, tmp_path):
    path = tmp_path / "chip.gds"
    path.write_bytes(two_inverters())
    out = run(spark, "layout", str(path), "--json", str(tmp_path / "inventory"))
    assert {"cells: 4", "top cell: chip", "instances: 4", "labels: in, out, nowhere", "logic: 2", "filler: 1", "via: 1"} <= set(out)
    parts = json.loads(text_of(tmp_path / "inventory"))["components"]
    assert [(p["instance"], p["reference_index"], p["origin_um"]) for p in parts] == [("U0", 0, [0.0, 0.0]), ("U1", 2, [10.0, 0.0])]
    assert parts[1]["pins"] == {"A": [[10.5, 0.5]], "LOST": [[11.5, 0.5]], "Y": [[12.5, 0.5]]}

    assert run(spark, "extract", str(path), "--json", str(tmp_path / "nets"))[0] == "3 nets"
    made = json.loads(text_of(tmp_path / "nets"))
    assert made["schema_version"] == 1 and made["top_cell"] == "chip" and made["source_gds"] == str(path)
    assert {k: (v["aliases"], v["terminals"]) for k, v in made["nets"].items()} == {
        "in": (["in"], ["U0_inv_1.A"]), "out": (["out"], ["U1_inv_1.Y"]), "n0000": ([], ["U0_inv_1.Y", "U1_inv_1.A"]),
        "unresolved_0000": ([], ["U0_inv_1.LOST"]), "unresolved_0001": ([], ["U1_inv_1.LOST"]),
    }
    stitched = made["diagnostics"]["via_cuts"]
    assert made["diagnostics"]["unresolved_ports"] == ["nowhere"] and len(stitched) == 5
    assert stitched["li1->met1"] == {"total": 1, "stitched": 1} and stitched["met4->met5"] == {"total": 0, "stitched": 0}
    assert netlist_json.read_nets(spark, str(tmp_path / "nets")).count() == 5
    assert {"net in (1 terminals)", "unresolved port nowhere"} <= set(run(spark, "extract", str(path)))


def test_top_cells(spark, tmp_path):
    path = tmp_path / "two.gds"
    path.write_bytes(two_inverters(cell("other", box(67, 20, 0, 0, 1, 1))))
    with pytest.raises(ValueError, match="chip, other"):
        Layout.load(spark, str(path))
    with pytest.raises(ValueError, match="no single top cell none"):
        Layout.load(spark, str(path), "none")
    assert Layout.load(spark, str(path), "other").components().count() == 0


def test_library_command(spark, tmp_path):
    def put(kind, timing):
        folder = tmp_path / "lib" / "cells" / kind
        folder.mkdir(parents=True)
        (folder / "definition.json").write_text(json.dumps({"description": f"the {kind}", "name": kind}))
        (folder / f"{LIBRARY}{kind}_1__tt_025C_1v80.lib.json").write_text(json.dumps(timing))
        (folder / f"{LIBRARY}{kind}_2__tt_025C_1v80.lib.json").write_text("{}")

    put("inv", {"pin,A": {"direction": "input"}, "pin,Y": {"direction": "output", "function": "(!A)"}})
    put("and2", {"pin,A": {"direction": "input"}, "pin,B": {"direction": "input"}, "pin,X": {"direction": "output", "function": "(A&B)"}})
    put("dfxtp", {"pin,CLK": {"direction": "input"}, "pin,D": {"direction": "input"}, "pin,Q": {"direction": "output", "function": "IQ"}, "ff,IQ,IQ_N": {"clocked_on": "CLK", "next_state": "D"}})
    nets = tmp_path / "n.json"
    nets.write_text(json.dumps({"a": ["U0_inv_1.A", "x.y_inv_2.A"], "b": ["U0_inv_1.Y", "U1_dfxtp_4.D", "odd.A"]}))
    args = ["models", str(tmp_path / "lib"), str(nets), "--out", str(tmp_path / "cells"), "--revision", "r1"]
    assert run(spark, *args) == [f"2 cells written to {tmp_path / 'cells'}"]
    made = json.loads(text_of(tmp_path / "cells"))
    assert sorted(made["cells"]) == ["dfxtp", "inv"] and made["source_revision"] == "r1" and made["liberty_corner"] == "tt_025C_1v80"
    assert made["cells"]["inv"]["description"] == "the inv" and made["cells"]["inv"]["outputs"] == {"Y": "(!A)"} and made["cells"]["inv"]["clear"] is None
    assert made["cells"]["dfxtp"]["inputs"] == ["D"] and made["cells"]["dfxtp"]["clock_pins"] == ["CLK"]
    assert {r.cell_type for r in catalogue.read_cells(spark, str(tmp_path / "cells")).collect()} == {"dfxtp", "inv"}
    assert run(spark, *args, "--check") == [f"2 cells as in {tmp_path / 'cells'}"]
    with pytest.raises(ValueError, match="header"):
        run(spark, *args[:-1], "r2", "--check")
    nets.write_text(json.dumps({"a": ["U0_inv_1.A", "U3_and2_1.X"]}))
    with pytest.raises(ValueError, match="and2 not in the snapshot, dfxtp no longer used"):
        run(spark, *args, "--check")
    nets.write_text(json.dumps({"a": ["U0_nor9_1.A"]}))
    with pytest.raises(ValueError, match="nor9"):
        run(spark, *args)


def toy_file(tmp_path):
    ports, nets = {"din", "en", "clk", "rst_n", "success"}, {}
    for instance, _, pin, net in designs.toy():
        nets.setdefault(net if net in ports else f"('x', '{net}')", []).append(f"{instance}.{pin}")
    path = tmp_path / "toy.json"
    path.write_text(json.dumps(nets))
    return str(path)


def test_one_document(spark, tmp_path):
    path = toy_file(tmp_path)
    run(spark, "export", path, "--out", str(tmp_path / "doc"), "--document")
    made = json.loads(text_of(tmp_path / "doc"))
    assert list(made) == ["source", "ports", "instances", "nets", "abstractions", "validation_issues"]
    assert made["ports"]["success"] == {"net": "success", "direction": "output"} and made["ports"]["din"]["direction"] == "input"
    assert list(made["instances"]) == sorted(made["instances"]) and made["instances"]["AND0_and2"]["pins"]["X"] == {"net": "success", "direction": "output", "role": "data"}
    assert made["instances"]["INV0_inv"]["function"] == "Y = !A" and made["nets"]["en"]["loads"] == ["M0_mux2.S", "M1_mux2.S"]
    (register,) = made["abstractions"]["shift_registers"]
    assert register["name"] == "shift_din" and register["stages"] == ["FF0_dfrtp", "FF1_dfrtp"] and made["validation_issues"] == []


def test_document_quotes_names(spark):
    rows = spark.createDataFrame([('a"b', "1"), ("c\\d\n", "[2]")], "key string, value string")
    empty = spark.createDataFrame([], "place long, value string")
    text = "\n".join(r.line for r in report.document(spark, {"rows": rows, "none": empty, "in": {"x": None}}).collect())
    assert json.loads(text) == {"rows": {'a"b': 1, "c\\d\n": [2]}, "none": [], "in": {"x": None}}


def test_player(spark, tmp_path):
    play = Player(Circuit.of(designs.toy()), data="din", enable="en", held={"clk": True})
    assert play.reset_state(spark) == {"FF0_dfrtp": False, "FF1_dfrtp": False}
    runs = spark.createDataFrame([(1, [True, False]), (2, []), (3, None), (4, [True]), (5, [False, True, True])], "run long, bits array<boolean>")
    assert {r.run: (r.FF0_dfrtp, r.FF1_dfrtp) for r in play.scan(runs).collect()} == {1: (False, True), 2: (False, False), 3: (False, False), 4: (True, False), 5: (True, True)}
    assert {r.run: (r.FF0_dfrtp, r.FF1_dfrtp) for r in play.scan(runs, 2).collect()} == {1: (False, True), 2: (False, False), 3: (False, False), 4: (False, True), 5: (True, False)}
    got = play.replay(runs, "success", ["success", "en"], trailing=3).orderBy("run", "edge").collect()
    assert len(got) == 15 and {(r.run, r.byte, r.success) for r in got} == {(1, 1, True), (2, 0, False), (3, 0, False), (4, 0, False), (5, 0, False)}
    groups = spark.createDataFrame([("first", "FF0_dfrtp"), ("second", "FF1_dfrtp")], "group string, flop string")
    assert sorted(map(tuple, play.data_hits(spark, groups, 3).collect())) == [("first", 0), ("first", 1), ("first", 2)]


def test_state_classes(spark):
    def flop(n, d, q):
        return [(f"{n}_dfxtp_1", "D", d), (f"{n}_dfxtp_1", "Q", q), (f"{n}_dfxtp_1", "CLK", "clk")]

    pins = [*flop("A", "an", "a"), *flop("B", "bn", "b"), ("I_inv_1", "A", "b"), ("I_inv_1", "Y", "an"), ("X_and2_1", "A", "a"), ("X_and2_1", "B", "s"), ("X_and2_1", "X", "bn")]
    pins += [*flop("S", "en", "s"), *flop("H", "s", "h")]
    pins += [*flop("M", "mn", "m"), *flop("N", "m", "n"), ("U_mux2_1", "A0", "n"), ("U_mux2_1", "A1", "m"), ("U_mux2_1", "S", "en"), ("U_mux2_1", "X", "mn")]
    rows = spark.createDataFrame([(net, i, p, k) for k, (i, p, net) in enumerate(pins)], "net string, instance string, pin string, ordinal int")
    nets = spark.createDataFrame([(n, [], False, False) for n in sorted({p[2] for p in pins})], "net string, aliases array<string>, is_port boolean, is_power boolean")
    design = Design.of(nets, rows, cell_frame(spark))
    hide = spark.createDataFrame([("H_dfxtp_1",)], "instance string")
    got = {tuple(r.members): (r.kind, r.n_cells, r.extra_state) for r in design.state_classes(hide).collect()}
    assert got == {("A_dfxtp_1", "B_dfxtp_1"): ("thin", 2, ["S_dfxtp_1"]), ("M_dfxtp_1", "N_dfxtp_1"): ("reused", 1, []), ("S_dfxtp_1",): ("single", None, None)}
    assert {r.kind for r in design.state_classes(hide, thin_limit=2).collect()} == {"fat", "reused", "single"}


def test_rounds(spark):
    """Walks, levels and gate values over a chain longer than a stride and than a compaction, with a cycle aside."""
    n = 40
    arcs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, 3), (100, 101), (101, 100), (101, 102)], "src long, dst long")
    start = spark.createDataFrame([("r", 0), ("s", 38)], "root string, node long")
    found = {(r.root, r.node): r.hop for r in graph.reach(arcs, start).collect()}
    assert found == {("r", 0): 0, ("r", 1): 1, ("r", 2): 2, **{("r", i): i - 2 for i in range(3, n + 1)}, ("s", 38): 0, ("s", 39): 1, ("s", 40): 2}
    assert {r.node for r in graph.reach(arcs, start.where("root = 'r'"), 3).collect()} == {0, 1, 2, 3, 4, 5}
    through = spark.createDataFrame([(3,), (4,)], "node long")
    assert {r.node for r in graph.reach(arcs, start.where("root = 'r'"), through=through).collect()} == {0, 1, 3, 4, 5}
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, 101, 102, 200]], "node long")
    levels = {r.node: r.level for r in graph.levels(nodes, arcs).collect()}
    assert levels == {**{i: i for i in range(n + 1)}, 100: None, 101: None, 102: None, 200: 0}
    gates = spark.createDataFrame([(2, "and"), (3, "xor"), (4, "nand"), (9, "or")], "node long, gate string")
    wires = spark.createDataFrame([(2, 0, 1), (3, 2, 0), (4, 3, 3), (9, 8, 8)], "dst long, a long, b long")
    inputs = spark.createDataFrame([(0, 0b1100), (1, 0b1010)], "node long, value long")
    assert {r.node: r.value & 15 for r in simulate.gate_lanes(gates, wires, inputs).collect()} == {0: 12, 1: 10, 2: 8, 3: 4, 4: 11}
