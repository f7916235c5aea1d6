"""Graph and inventory options of the command line, over the toy circuit with a buffered clock."""

import json
from pathlib import Path

import pytest

from netloom import cli
from netloom.operators.design import Design
from netloom.plans import designs

PORTS = {"din", "en", "clk", "rst_n", "success"}


@pytest.fixture(scope="module")
def netlist(tmp_path_factory):
    pins = [(i, k, pin, "clk_b" if net == "clk" else net) for i, k, pin, net in designs.toy()]
    pins += [("CB0_clkbuf", "clkbuf", "A", "clk_a"), ("CB0_clkbuf", "clkbuf", "X", "clk_b"), ("CB1_buf", "buf", "A", "clk"), ("CB1_buf", "buf", "X", "clk_a")]
    nets = {}
    for instance, _, pin, net in pins:
        nets.setdefault(net if net in PORTS else f"('x', '{net}')", []).append(f"{instance}.{pin}")
    path = tmp_path_factory.mktemp("commands") / "toy.json"
    path.write_text(json.dumps(nets))
    return str(path)


def run(spark, *args):
    return cli.run(spark, cli.parser().parse_args(list(args)))


def graph_of(path):
    return "\n".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_registers_and_chains_as_graphs(spark, netlist, tmp_path):
    text = run(spark, "registers", netlist, "--dot", str(tmp_path / "r"))
    made = graph_of(tmp_path / "r")
    muxes = {r.mux for r in Design.load(spark, netlist).registers().collect()}
    assert len(text) == len(muxes) == 2 and all(f'"i:{x}"' in made for x in {"FF0_dfrtp", "FF1_dfrtp"} | muxes) and "CB0" not in made and "AND0" not in made
    assert len(run(spark, "shift-chains", netlist, "--dot", str(tmp_path / "c"))) == 2
    made = graph_of(tmp_path / "c")
    for cell in {"FF0_dfrtp", "FF1_dfrtp", "CB0_clkbuf", "CB1_buf"} | muxes:
        assert f'"i:{cell}"' in made
    assert '"n:clk"' in made and '"n:rst_n"' in made and '"n:en"' in made and '"n:din"' in made and '"n:success"' not in made


def test_only_drivers_and_only_inputs(spark, netlist):
    whole, short = run(spark, "net", netlist, "success"), run(spark, "net", netlist, "success", "--driver")
    assert short == [x for x in whole if x.startswith(("net ", "driver "))] and short[1].startswith("driver AND0")
    pins = run(spark, "instance", netlist, "CB0", "--inputs")
    assert [x.split()[:2] for x in pins] == [["A", "input"]] and len(run(spark, "instance", netlist, "CB0")) == 2


def test_component_inventory(spark, tmp_path):
    """Two flops that feed each other, another such pair, and one alone."""
    nets = {}
    for instance, d, q in (("F0_dfxtp", "b", "a"), ("F1_dfxtp", "a", "b"), ("F2_dfxtp", "d", "c"), ("F3_dfrtp", "c", "d"), ("F4_dfxtp", "a", "e")):
        nets.setdefault(f"('x', '{d}')", []).append(f"{instance}.D")
        nets.setdefault(f"('x', '{q}')", []).append(f"{instance}.Q")
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps(nets))
    assert run(spark, "components", str(path)) == ["component sizes: 1: 1, 2: 2", "  1 of 2 flops (dfxtp 2), such as F0_dfxtp", "  1 of 2 flops (dfrtp 1, dfxtp 1), such as F2_dfxtp"]
    hidden = run(spark, "components", str(path), "--hide", "F0_dfxtp", "--hide", "F1_dfxtp", "--hide", "F2_dfxtp")
    assert hidden == ["component sizes: 1: 1, 2: 2", "  1 of 2 flops (dfrtp 1, dfxtp 1), such as F2_dfxtp"]
