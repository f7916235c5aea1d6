import json

import pytest

from netloom.functions.cells import Cell, BASIC_CELLS, cell_frame
from netloom.operators import graph, motifs
from netloom.operators.design import Design
from netloom.plans import designs


def write(tmp_path, nets, name="n.json"):
    path = tmp_path / name
    path.write_text(json.dumps(nets))
    return str(path)


def bare(pins, ports):
    nets = {}
    for instance, _, pin, net in pins:
        nets.setdefault(net if net in ports else f"('x', '{net}')", []).append(f"{instance}.{pin}")
    return nets


PORTS = {"din", "en", "clk", "rst_n", "success"}


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    return Design.load(spark, write(tmp_path_factory.mktemp("toy"), bare(designs.toy(), PORTS)))


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def internal(net):
    return f"('x', '{net}')"


def test_load(toy):
    row = toy.summary().first()
    assert (row.instances, row.nets, row.state_elements, row.terminals) == (6, 10, 2, 21)
    assert column(toy.nets.where("is_port"), "net") == sorted(PORTS)
    roles = {(r.instance, r.pin): (r.direction, r.role) for r in toy.terminals.collect()}
    assert roles["FF0_dfrtp", "Q"] == ("output", "state") and roles["FF0_dfrtp", "CLK"] == ("input", "clock") and roles["AND0_and2", "X"] == ("output", "data")


def test_versioned_form_and_errors(spark, tmp_path):
    nets = {"n0": {"aliases": [], "terminals": ["a_inv.Y", "b_inv.A"]}, "n1": {"aliases": ["in", "IN"], "terminals": ["a_inv.A"]}, "n2": {"aliases": ["VPWR"], "terminals": ["a_inv.VPWR"]}}
    d = Design.load(spark, write(tmp_path, {"schema_version": 1, "nets": nets}))
    assert {r.name: r.net for r in d.resolve(["n0", "IN", "a_inv.Y", "zz"]).collect()} == {"n0": "n0", "IN": "n1", "a_inv.Y": "n0", "zz": None}
    assert d.validation_issues().isEmpty()
    with pytest.raises(KeyError):
        d.resolve_one("zz")
    with pytest.raises(Exception, match="schema_version"):
        Design.load(spark, write(tmp_path, {"schema_version": 2, "nets": {}}, "v2.json"))
    for twice in ({"x": ["a_inv.A", "a_inv.A"]}, {"x": ["a_inv.A"], "y": ["a_inv.A"]}):
        with pytest.raises(ValueError, match="connected 2 times"):
            Design.load(spark, write(tmp_path, twice, "twice.json"))


def test_cone_and_dependencies(spark, toy):
    nets, cells = toy.cone("success")
    assert column(cells, "instance") == ["AND0_and2", "FF0_dfrtp", "FF1_dfrtp", "INV0_inv"]
    assert column(cells.where("boundary"), "instance") == ["FF0_dfrtp", "FF1_dfrtp"]
    assert column(nets, "net") == sorted(["success", internal("q0"), internal("q1"), internal("nq0")])
    through, _ = toy.cone("success", stop_at_flops=False)
    assert {"din", "en"} <= set(column(through, "net"))
    deps = {(r.dst, r.src) for r in toy.dependencies().collect()}
    assert deps == {("FF0_dfrtp", "FF0_dfrtp"), ("FF1_dfrtp", "FF1_dfrtp"), ("FF1_dfrtp", "FF0_dfrtp")}
    scc = graph.strongly_connected(toy.instances.where("sequential").selectExpr("instance AS node"), toy.dependencies())
    assert sorted(r["count"] for r in scc.groupBy("component").count().collect()) == [1, 1]


def test_neighbourhood(toy):
    cells, nets = toy.neighbourhood("INV0_inv", 1)
    assert column(cells, "instance") == ["AND0_and2", "FF0_dfrtp", "INV0_inv", "M0_mux2", "M1_mux2"] and "success" in column(nets, "net")
    cells, nets = toy.neighbourhood("INV0_inv", 0)
    assert column(cells, "instance") == ["INV0_inv"] and len(column(nets, "net")) == 2
    cells, _ = toy.net_neighbourhood("success", 1)
    assert column(cells, "instance") == ["AND0_and2"]


def extra_stage(n):
    n[internal("q0")].append("M2_mux2.A1")
    n["en"].append("M2_mux2.S")
    n["clk"].append("FF2_dfrtp.CLK")
    n["rst_n"].append("FF2_dfrtp.RESET_B")
    n[internal("d2")] = ["M2_mux2.X", "FF2_dfrtp.D"]
    n[internal("q2")] = ["FF2_dfrtp.Q", "M2_mux2.A0"]


def moved(n, terminal, old, new):
    n[old].remove(terminal)
    n[new] = [terminal]


#: Changes to the toy, each in a copy of its own, and the reason by which it is refused (None: it is not).
MUTATIONS = {
    "plain": (lambda n: None, None),
    "pin": (lambda n: n[internal("q0")].append("M0_mux2.EXTRA"), "mux signal pins differ from model"),
    "tapped": (lambda n: n[internal("d0")].append("TAP_and2.A"), "D net is not point-to-point"),
    "enable": (lambda n: moved(n, "M1_mux2.S", "en", "en2"), "stages do not share one enable net"),
    "branch": (extra_stage, "chain branches"),
    "reset": (lambda n: moved(n, "FF1_dfrtp.RESET_B", "rst_n", "other"), "stages do not share one reset net"),
    "tap": (lambda n: n[internal("q0")].append("DOWN_mux2.A0"), None),
}


def test_strict_registers_and_mutations(spark, tmp_path):
    every = {}
    for copy, (change, _) in MUTATIONS.items():
        nets = bare(designs.toy(), PORTS)
        change(nets)
        every |= {(net.replace("'x'", f"'{copy}'") if net[0] == "(" else f"{copy}.{net}"): [f"{copy}_{t}" for t in ts] for net, ts in nets.items()}
    found, refused = Design.load(spark, write(tmp_path, every, "m.json")).strict_shift_registers()
    rows = {r.stages[0].split("_")[0]: r for r in found.collect()}
    reasons = [(r.candidates[0].split("_")[0], x) for r in refused.collect() for x in r.reasons]
    assert set(rows) == {c for c, (_, why) in MUTATIONS.items() if why is None}
    for copy, (_, why) in MUTATIONS.items():
        assert why is None or any(c == copy and why in x for c, x in reasons)
    r = rows["plain"]
    assert (r.name, r.width, r.stages, r.serial_net, r.enable_net, r.clock_net, r.reset_net) == ("shift_plain_din", 2, ["plain_FF0_dfrtp", "plain_FF1_dfrtp"], "plain.din", "plain.en", "plain.clk", "plain.rst_n")
    assert r.external_loads == {"plain_FF0_dfrtp": ["plain_INV0_inv.A"], "plain_FF1_dfrtp": ["plain_AND0_and2.A"]}
    assert "tap_DOWN_mux2.A0" in rows["tap"].external_loads["tap_FF0_dfrtp"]


def test_adder_registers(spark):
    pins = designs.frame(spark, designs.adder()).selectExpr("net", "instance", "pin", "0 AS ordinal")
    nets = pins.selectExpr("net", "IF(net IN ('A', 'B', 'S', 'en', 'clk', 'rst_n'), array(net), cast(array() AS array<string>)) AS aliases").distinct().selectExpr("*", "size(aliases) > 0 AS is_port", "false AS is_power")
    d = Design.of(nets, pins, cell_frame(spark))
    found, refused = d.strict_shift_registers()
    rows = {r.name: r for r in found.collect()}
    assert {n: (r.width, r.stages[0], r.stages[-1]) for n, r in rows.items()} == {"shift_A": (8, "FFa0_dfrtp", "FFa7_dfrtp"), "shift_B": (8, "FFb0_dfrtp", "FFb7_dfrtp")}
    assert refused.isEmpty()
    assert d.shift_chains().groupBy("head").count().where("count = 8").count() == 2


def test_buffers_and_issues(spark):
    rows = [("n0", "B0_buf", "A"), ("n1", "B0_buf", "X"), ("n1", "B1_clkbuf", "A"), ("n2", "B1_clkbuf", "X"), ("n2", "I_inv", "A"), ("n3", "I_inv", "Y"), ("n3", "J_inv", "Y"), ("n4", "J_inv", "A"), ("n4", "K_what", "Z"), ("n4", "I_inv", "ODD"), ("VPWR", "I_inv", "VPWR"), ("n5", "K_what", "A")]
    pins = spark.createDataFrame([(*r, 0) for r in rows], "net string, instance string, pin string, ordinal int")
    nets = pins.selectExpr("net", "IF(net = 'n0', array('in'), cast(array() AS array<string>)) AS aliases", "net = 'n0' AS is_port", "net = 'VPWR' AS is_power").distinct()
    d = Design.of(nets, pins, cell_frame(spark))
    assert {r.net: r.source for r in d.transparent_sources().collect()} == {"n0": "n0", "n1": "n0", "n2": "n0", "n3": "n3", "n4": "n4", "n5": "n5", "VPWR": "VPWR"}
    assert {(r.issue, r.node) for r in d.validation_issues().collect()} == {("unknown cell model", "K_what"), ("unknown pin", "I_inv.ODD"), ("multiple drivers", "n3"), ("undriven internal net", "n5")}


def test_pair_classes(spark):
    components = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("f", 3), ("g", 4)], "node string, component int")
    cones = [("a", "m", True, False), ("c", "x", False, False), ("c", "s", False, True)] + [("e", f"g{i}", i == 0, False) for i in range(30)]
    kinds = motifs.classify_pairs(components, spark.createDataFrame(cones, "node string, cell string, is_mux boolean, is_state boolean"))
    assert {r.component: (r.n_cells, r.kind) for r in kinds.collect()} == {1: (1, "reused"), 2: (1, "thin"), 3: (30, "fat")}


def test_unknown_cells_have_inferred_pins(spark):
    cells = cell_frame(spark, {"inv": BASIC_CELLS["inv"], "odd": Cell("odd", ("P",), {"O": "P"})})
    assert cells.count() == 2


def test_instances_by_the_start_of_their_name(toy):
    assert toy.resolve_instance("FF0") == toy.resolve_instance("FF0_dfrtp") == "FF0_dfrtp"
    for name in ("FF", "M", "nope"):
        with pytest.raises(KeyError, match="unknown instance"):
            toy.resolve_instance(name)


def test_ambiguous_instances_and_other_rails(spark, tmp_path):
    nets = {"VDD": ["U1_a_inv.VDD", "U1_b_inv.VDD"], "VSS": ["U1_a_inv.VSS"], "x": ["U1_a_inv.A"], "y": ["U1_a_inv.Y", "U1_b_inv.A"], "z": ["U1_b_inv.Y"]}
    design = Design.load(spark, write(tmp_path, nets))
    with pytest.raises(KeyError, match="U1_a_inv, U1_b_inv"):
        design.resolve_instance("U1")
    assert {r.net for r in design.nets.where("is_power").collect()} == {"VDD", "VSS"}
    assert {r.role for r in design.terminals.where("pin IN ('VDD', 'VSS')").collect()} == {"power"}
