import json

import pytest

from netloom import cli
from netloom.operators.extract import extract
from netloom.plans import designs


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


SHAPE = "layer int, datatype int, ring array<struct<x:double,y:double>>"
LABEL = "instance string, text string, layer int, datatype int, x double, y double"


def test_extraction(spark):
    shapes = spark.createDataFrame([
        (67, 20, box(0, 0, 4, 1)), (67, 20, box(4, 0, 6, 1)), (68, 20, box(5, 0, 6, 9)), (67, 44, box(5.2, 0.2, 5.6, 0.6)),
        (67, 20, box(20, 0, 22, 1)), (68, 44, box(30, 30, 31, 31)), (67, 20, box(40, 0, 41, 1)), (99, 0, box(0, 0, 50, 50)),
    ], SHAPE)
    labels = spark.createDataFrame([("U0_inv", "A", 67, 5, 0.5, 0.5), ("U1_inv", "Y", 67, 5, 4.5, 0.5), ("U1_inv", "A", 67, 5, 21.0, 0.5), ("U2_inv", "A", 67, 5, 70.0, 70.0), ("FILL_1", "A", 67, 5, 21.0, 0.5), (None, "in", 68, 5, 5.5, 8.0), (None, "lost", 68, 5, 90.0, 8.0)], LABEL)
    instances = spark.createDataFrame([("U0_inv",), ("U1_inv",), ("U2_inv",)], "instance string")
    got = extract(shapes, labels, instances)
    assert [(r.net, r.aliases, r.terminals) for r in got.nets.orderBy("net").collect()] == [("in", ["in"], ["U0_inv.A", "U1_inv.Y"]), ("n0000", [], ["U1_inv.A"])]
    assert sorted((r.kind, r.name, r.net) for r in got.unresolved.collect()) == [("pin", "U2_inv.A", "unresolved_0000"), ("port", "lost", "unresolved_0000")]
    assert sorted(tuple(r) for r in got.stitches.collect()) == [(0, 1, 1, 1), (1, 2, 1, 0)]
    both = labels.unionByName(spark.createDataFrame([("U0_inv", "A", 67, 5, 20.5, 0.5)], LABEL))
    with pytest.raises(ValueError, match="pin U0_inv.A touches 2 nets"):
        extract(shapes, both, instances)


def test_command_line(spark, tmp_path, capsys):
    ports = {"din", "en", "clk", "rst_n", "success"}
    nets = {}
    for instance, _, pin, net in designs.toy():
        nets.setdefault(net if net in ports else f"('x', '{net}')", []).append(f"{instance}.{pin}")
    path = tmp_path / "toy.json"
    path.write_text(json.dumps(nets))

    def out(*args):
        return cli.run(spark, cli.parser().parse_args([args[0], str(path), *args[1:]]))

    assert "instances: 6" in out("summary") and "no issues" in out("summary")
    assert out("cone", "success", "--dot", str(tmp_path / "dot"))[0] == "cone of success: 4 cells, 4 nets, 2 at the boundary"
    assert any(p.name.startswith("part") for p in (tmp_path / "dot").iterdir())
    trace = out("simulate", "--input", "din=1,0,1,1", "--input", "en=1", "--input", "rst_n=1", "--input", "clk=1", "--watch", "success")
    assert trace[2] == "edge 2: success=1 | FF0_dfrtp=1 FF1_dfrtp=0"
    assert out("influence", "FF0_dfrtp.Q", "success")[-1] == "high = False"
    assert "net success" in out("net", "success") and any(x.startswith("A ") for x in out("instance", "INV0_inv"))
    assert cli.main(["net", str(path), "nothing"]) == 1 and "error:" in capsys.readouterr().err
