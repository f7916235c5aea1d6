"""Command line: python -m netloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from netloom import report
from netloom.functions.cells import POWER_VALUES, cell_frame, collect_cells
from netloom.operators.design import Design
from netloom.operators.layout import Layout
from netloom.operators.simulate import Circuit, EvaluationError
from netloom.sources import catalogue, netlist_json, vcd


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="netloom")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, design: bool = True) -> None:
        p = commands.add_parser(name)
        if design:
            p.add_argument("netlist")
            p.add_argument("--cells", help="a catalogue snapshot; the built-in cells otherwise")
        for flag, settings in options:
            p.add_argument(flag, **settings)

    dot = ("--dot", {"help": "folder for the graph's text"})
    depth = ("--depth", {"type": int, "default": 1})
    add("summary")
    add("net", ("name", {}), depth, dot, ("--driver", {"action": "store_true", "help": "only the net and what drives it"}))
    add("instance", ("name", {}), depth, dot, ("--inputs", {"action": "store_true", "help": "only the input pins"}))
    add("cone", ("target", {}), ("--through-flops", {"action": "store_true"}), dot)
    add("registers", dot)
    add("shift-chains", dot)
    add("components", ("--hide", {"action": "append", "default": [], "help": "a flop left out"}))
    add("shift-registers", ("--show-rejected", {"action": "store_true"}), dot)
    add("gate-inputs", ("names", {"nargs": "+"}), dot)
    add("export", ("--out", {"required": True}), ("--document", {"action": "store_true", "help": "one JSON document rather than a folder a section"}))
    add("influence", ("candidate", {}), ("target", {}), ("--max-variables", {"type": int, "default": 20}))
    add("simulate", ("--input", {"action": "append", "default": [], "help": "NAME=0,1,..."}), ("--watch", {"action": "append", "default": []}), ("--initial", {"action": "append", "default": [], "help": "FLOP=1"}))
    top_cell, to_json = ("--top", {"help": "the top cell, if there are several"}), ("--json", {"help": "folder for the JSON text"})
    add("layout", ("layout", {}), top_cell, to_json, design=False)
    add("extract", ("layout", {}), top_cell, to_json, design=False)
    add(
        "models", ("library", {"help": "checkout of the cell library"}), ("netlists", {"nargs": "+"}), ("--out", {"required": True}), ("--revision", {"required": True}),
        ("--source", {"default": "https://github.com/google/skywater-pdk-libs-sky130_fd_sc_hd"}), ("--corner", {"default": "tt_025C_1v80"}), ("--check", {"action": "store_true"}), design=False,
    )
    add("waveform", ("dump", {}), ("--clock", {"default": "clk"}), design=False)
    return top


#: Terminals of a circuit that is simulated as a whole; larger ones are refused.
MAX_TERMINALS = 1_000_000


def circuit_of(design: Design) -> Circuit:
    rows = design.terminals.select("instance", "cell_type", "pin", "net").limit(MAX_TERMINALS + 1).collect()
    if len(rows) > MAX_TERMINALS:
        raise ValueError(f"over {MAX_TERMINALS} terminals: the circuit is too large for one driver")
    rails = {r.net: any(POWER_VALUES.get(name, False) for name in [r.net, *r.aliases]) for r in design.nets.where("is_power").select("net", "aliases").collect()}
    return Circuit.of([tuple(r) for r in rows], collect_cells(design.cells), rails)


def bits_of(text: str) -> tuple[str, list[bool]]:
    name, found, values = text.partition("=")
    if not found or not name or any(v not in ("0", "1") for v in values.split(",")):
        raise ValueError(f"not NAME=0,1,...: {text}")
    return name, [v == "1" for v in values.split(",")]


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    if args.command == "layout":
        found = Layout.load(spark, args.layout, args.top)
        if args.json:
            report.write_text(found.inventory(), args.json)
        return report.layout_text(found)
    if args.command == "extract":
        found = Layout.load(spark, args.layout, args.top)
        made = found.netlist()
        if args.json:
            report.write_text(found.document(made), args.json)
            return [f"{made.nets.count()} nets", f"wrote {args.json}"]
        return report.extraction_text(made)
    if args.command == "models":
        types = catalogue.used_cell_types(reduce(DataFrame.unionByName, [netlist_json.read_nets(spark, n) for n in args.netlists]))
        cells, header = catalogue.import_library(spark, args.library, types, args.corner), (args.source, args.revision, args.corner)
        if args.check:
            changed = catalogue.stale(cells, args.out, *header).orderBy("cell_type").limit(20).collect()
            if changed:
                raise ValueError(f"{args.out} is out of date: " + ", ".join(f"{r.cell_type} {r.problem}" for r in changed))
            return [f"{cells.count()} cells as in {args.out}"]
        report.write_text(catalogue.snapshot(cells, *header), args.out)
        return [f"{cells.count()} cells written to {args.out}"]
    if args.command == "waveform":
        lines = vcd.read_lines(spark, args.dump)
        names = sorted(r.name for r in vcd.signals(lines).collect())
        return [" ".join(map(str, r[1:])) for r in vcd.at_rising_edges(vcd.changes(lines), names, args.clock).orderBy("dump", "line_no").collect()]
    design = Design.load(spark, args.netlist, catalogue.read_cells(spark, args.cells) if args.cells else cell_frame(spark))
    graph, out = None, []
    match args.command:
        case "summary":
            out = report.summary_text(design)
        case "net":
            out, graph = report.net_text(design, args.name, args.driver), design.net_neighbourhood(args.name, args.depth)
        case "instance":
            name = design.resolve_instance(args.name)
            out, graph = report.instance_text(design, name, args.inputs), design.neighbourhood(name, args.depth)
        case "cone":
            out, (nets, cells) = report.cone_text(design, args.target, not args.through_flops), design.cone(args.target, not args.through_flops)
            graph = cells, nets
        case "registers":
            out, graph = report.registers_text(design), design.register_graph() if args.dot else None
        case "shift-chains":
            out = [f"{r.head} {r.rank} {r.node}" for r in design.shift_chains().orderBy("head", "rank").collect()]
            graph = design.chain_graph() if args.dot else None
        case "components":
            hide = spark.createDataFrame([(design.resolve_instance(n),) for n in args.hide], "instance string") if args.hide else None
            out = report.inventory_text(design, hide)
        case "shift-registers":
            found, refused = design.strict_shift_registers()
            out = report.shift_registers_text(found, refused if args.show_rejected else None)
            if args.dot:
                report.write_text(report.dot_registers(found), args.dot)
        case "gate-inputs":
            lines = report.dot_gate_inputs(design, args.names)
            if args.dot:
                report.write_text(lines, args.dot)
            out = [r.line for r in lines.collect()]
        case "export":
            if args.document:
                report.write_text(report.design_document(design, args.netlist), args.out)
            else:
                report.export(design, args.out)
        case "influence":
            row = circuit_of(design).influences(spark, design.resolve_one(args.candidate), design.resolve_one(args.target), args.max_variables).first()
            out = ["no influence"] if row is None else [f"{k} = {v}" for k, v in row.asDict().items()]
        case "simulate":
            circuit = circuit_of(design)
            inputs = {design.resolve_one(n): b for n, b in map(bits_of, args.input)}
            watch = {n: design.resolve_one(n) for n in args.watch}
            columns = {net: f"in{i}" for i, net in enumerate(inputs)}
            runs = spark.createDataFrame([(0, *inputs.values())], "run long" + "".join(f", {c} array<boolean>" for c in columns.values()))
            state = {n: b[0] for n, b in map(bits_of, args.initial)}
            rows = circuit.fold(runs, columns, list(watch.values()), state).orderBy("edge").collect()
            out = [f"edge {r.edge}: " + " ".join(f"{n}={int(r[net])}" for n, net in watch.items()) + " | " + " ".join(f"{f}={int(r[f])}" for f in sorted(circuit.flops)) for r in rows]
    if graph is not None and getattr(args, "dot", None):
        report.write_text(report.dot_netlist(design, graph[0], graph[1]), args.dot)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("netloom").getOrCreate()
    try:
        print("\n".join(run(spark, args)))
    except (OSError, ValueError, KeyError, EvaluationError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
