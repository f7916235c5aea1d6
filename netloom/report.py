"""Sinks: DOT graphs, HTML boards, text reports and JSON exports.

Lines are rows (section, key, line); ``text_of`` writes or returns them in order. Only what a person reads is collected.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.cells import POWER_PINS
from netloom.functions.names import quoted
from netloom.operators.ordered import numbered_all
from netloom.shared import cut

BOARD = 11


def lines(rows: DataFrame, section: int, key, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), key.alias("key") if isinstance(key, Column) else F.col(key).cast("string").alias("key"), line.alias("line"))


def fixed(spark, section: int, *texts: str) -> DataFrame:
    return spark.createDataFrame([(section, f"{i:06d}", t) for i, t in enumerate(texts)], "section int, key string, line string")


def ordered(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).orderBy("section", "key", "line").select("line")


def json_name(text: Column) -> Column:
    """``text`` as a JSON string."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def json_row(*columns) -> Column:
    """The columns as a JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def document(spark, parts: dict) -> DataFrame:
    """The lines of one JSON object, an entry a line, so that the document is sorted and written as a stream.

    A part is a plain value, a dict of parts, rows (key, value: JSON text) for an object, or rows (place: a number, value)
    for a list in order of place. Keys and places don't repeat.
    """
    texts, tables = [], []

    def put(line) -> int:
        texts.append((len(texts) + len(tables), "", line))
        return texts[-1][0]

    def walk(part, begin: str) -> None:
        if isinstance(part, dict):
            put(begin + "{")
            for i, (name, inner) in enumerate(part.items()):
                walk(inner, ("," if i else "") + json.dumps(name) + ": ")
            put("}")
        elif isinstance(part, DataFrame):
            keyed = "key" in part.columns
            put(begin + ("{" if keyed else "["))
            rows = cut(part.select((F.col("key") if keyed else F.lpad(F.col("place").cast("string"), 19, "0")).alias("key"), "value"), "document")
            first = F.when(F.col("key") == rows.agg(F.min("key")).scalar(), "").otherwise(",")
            line = F.concat(first, json_name(F.col("key")), F.lit(": "), "value") if keyed else F.concat(first, "value")
            tables.append(lines(rows, len(texts) + len(tables), F.col("key"), line))
            put("}" if keyed else "]")
        else:
            put(begin + json.dumps(part))

    walk(parts, "")
    return ordered(spark.createDataFrame(texts, "section int, key string, line string"), *tables)


def write_text(rows: DataFrame, path: str) -> None:
    """The ordered lines as one text file in ``path``."""
    rows.coalesce(1).write.mode("overwrite").text(path)


def dot_netlist(design, cells: DataFrame, nets: DataFrame, title: str = "netlist", registers: DataFrame | None = None) -> DataFrame:
    """A bipartite graph of ``cells`` (instance) and ``nets`` (net): drivers point to nets, nets to loads.

    With ``registers`` (name, stages, ...; see ``strict_shift_registers``) each is one block; nets whose every terminal
    lies in one block are hidden, unless they are ports.
    """
    spark = design.nets.sparkSession
    shown = design.signals.join(cells.select("instance"), "instance", "left_semi").join(nets.select("net"), "net", "left_semi")
    if registers is not None:
        block = registers.select(F.explode("stages").alias("instance"), F.col("name").alias("block"))
        stages = design.stage_reasons().select(F.col("flop").alias("instance"), F.col("mux"))
        block = block.unionByName(block.join(stages, "instance").select(F.col("mux").alias("instance"), "block")).where("instance IS NOT NULL")
        shown = shown.join(block, "instance", "left")
        whole = design.signals.join(block, "instance", "left").groupBy("net").agg(F.count_distinct("block").alias("n"), F.count_if(F.col("block").isNull()).alias("free"))
        hidden = whole.where("n = 1 AND free = 0").join(design.nets.where("is_port"), "net", "left_anti")
        shown = shown.join(hidden.select("net"), "net", "left_anti")
    else:
        shown = shown.withColumn("block", F.lit(None).cast("string"))
    shown = cut(shown.withColumn("node", F.coalesce("block", "instance")), "shown")
    boxes = shown.groupBy("node").agg(F.max("block").alias("block"), F.max("cell_type").alias("cell_type"))
    label = F.when(F.col("block").isNotNull(), F.col("node")).otherwise(F.concat("node", F.lit("\n"), "cell_type"))
    arrow = F.when(F.col("direction") == "output", F.concat(quoted(F.concat(F.lit("i:"), "node")), F.lit(" -> "), quoted(F.concat(F.lit("n:"), "net")))).otherwise(F.concat(quoted(F.concat(F.lit("n:"), "net")), F.lit(" -> "), quoted(F.concat(F.lit("i:"), "node"))))
    named = shown.select("net").distinct().join(design.nets, "net").select("net", F.when(F.col("is_port"), F.array_join("aliases", "|")).otherwise(F.col("net")).alias("shown"))
    return ordered(
        fixed(spark, 0, f'digraph "{title}" {{', "  rankdir=LR;"),
        lines(boxes, 1, "node", F.concat(F.lit("  "), quoted(F.concat(F.lit("i:"), "node")), F.lit(" [shape=box, label="), quoted(label), F.lit("];"))),
        lines(named, 2, "net", F.concat(F.lit("  "), quoted(F.concat(F.lit("n:"), "net")), F.lit(" [shape=ellipse, label="), quoted(F.col("shown")), F.lit("];"))),
        lines(shown.select("node", "net", "direction", "pin"), 3, F.concat_ws(" ", "node", "net", "pin"), F.concat(F.lit("  "), arrow, F.lit(" [label="), quoted(F.col("pin")), F.lit("];"))).distinct(),
        fixed(spark, 4, "}"),
    )


def dot_registers(registers: DataFrame) -> DataFrame:
    """Each register as a cluster of its stages in order, fed by its serial net."""
    spark = registers.sparkSession
    stage = registers.select("name", "serial_net", F.posexplode("stages").alias("i", "flop"))
    node = lambda i: F.concat("name", F.lit("/"), i.cast("string"))
    key = F.format_string("%s %06d", "name", "i")
    source = F.when(F.col("i") == 0, F.col("serial_net")).otherwise(node(F.col("i") - 1))
    return ordered(
        fixed(spark, 0, "digraph registers {", "  rankdir=LR;"),
        lines(stage, 1, key, F.concat(F.lit("  "), quoted(node(F.col("i"))), F.lit(" [shape=record, label="), quoted(F.concat(F.lit("Q"), F.col("i").cast("string"), F.lit("\n"), "flop")), F.lit("];"))),
        lines(stage, 2, key, F.concat(F.lit("  "), quoted(source), F.lit(" -> "), quoted(node(F.col("i"))), F.lit(";"))),
        fixed(spark, 3, "}"),
    )


def dot_gate_inputs(design, names: list[str]) -> DataFrame:
    """What drives each data input of the cells ``names``; a source that feeds several pins is drawn once."""
    spark = design.nets.sparkSession
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "instance string")
    pins = design.signals.where("direction = 'input'").join(asked, "instance").select("instance", "pin", "net")
    driver = design.single_drivers.select("net", F.concat_ws(".", "instance", "pin").alias("driver"))
    fed = cut(pins.join(driver, "net", "left").join(design.nets, "net").select("instance", "pin", F.coalesce("driver", F.when(F.col("is_port"), F.array_join("aliases", "|")), "net").alias("source")), "fed")
    return ordered(
        fixed(spark, 0, "digraph inputs {", "  rankdir=LR;"),
        lines(fed.select("source").distinct(), 1, "source", F.concat(F.lit("  "), quoted(F.col("source")), F.lit(";"))),
        lines(fed, 2, F.concat_ws(".", "instance", "pin"), F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("instance")), F.lit(" [label="), quoted(F.col("pin")), F.lit("];"))),
        fixed(spark, 3, "}"),
    )


def board(rows: DataFrame) -> DataFrame:
    """``rows`` (pos) with row and col of the board; another number of places than all 121 raises."""
    n = BOARD * BOARD
    whole = rows.agg((F.count("*") == n) & (F.count_distinct("pos") == n) & (F.min("pos") == 0) & (F.max("pos") == n - 1)).first()[0]
    if not whole:
        raise ValueError(f"a board has places 0 to {n - 1}, each once")
    return rows.withColumns({"row": F.expr(f"pos div {BOARD}"), "col": F.col("pos") % BOARD})


def dot_grid(cells: DataFrame) -> DataFrame:
    """A board (pos, region, star): a node a place, an edge to the left and upper neighbour of the same region."""
    spark = cells.sparkSession
    placed = board(cells)
    b = placed.select(F.col("pos").alias("other"), F.col("region").alias("r2"))
    near = placed.select("pos", "region", F.explode(F.array(F.when(F.col("col") > 0, F.col("pos") - 1), F.when(F.col("row") > 0, F.col("pos") - BOARD))).alias("other")).where("other IS NOT NULL")
    same = near.join(b, "other").where("region = r2")
    label = F.when(F.col("star"), "*").otherwise("")
    return ordered(
        fixed(spark, 0, "graph board {"),
        lines(placed, 1, F.format_string("%06d", "pos"), F.format_string('  p%d [group=%d, label="%s"];', "pos", "region", label)),
        lines(same, 2, F.format_string("%06d %06d", "pos", "other"), F.format_string("  p%d -- p%d;", "other", "pos")),
        fixed(spark, 3, "}"),
    )


def square(text: Column, colour: Column) -> Column:
    return F.concat(F.lit('<div style="width:1.4em;height:1.4em;background:'), colour, F.lit('">'), text, F.lit("</div>"))


def grid_html(cells: DataFrame, columns: int = BOARD) -> str:
    """A grid (pos, text, colour) in order of pos."""
    entry = F.array_sort(F.collect_list(F.struct("pos", square(F.col("text"), F.col("colour")).alias("html"))))
    body = cells.agg(F.array_join(F.transform(entry, lambda s: s["html"]), "")).first()[0]
    return f'<div style="display:grid;grid-template-columns:repeat({columns},1.6em)">{body}</div>'


def bits_html(bits: DataFrame, columns: int = BOARD) -> str:
    """A grid (pos, bit), ones dark, under a line that counts them."""
    ones = bits.agg(F.count_if("bit")).first()[0]
    shown = bits.select("pos", F.when(F.col("bit"), "1").otherwise("0").alias("text"), F.when(F.col("bit"), "#444").otherwise("#eee").alias("colour"))
    return f"<div>{ones} ones</div>{grid_html(shown, columns)}"


def table_html(rows: DataFrame, order: list[str], wrap: int = 0) -> str:
    """Rows as a table in ``order``, wrapped into side-by-side parts of ``wrap`` rows if positive."""
    cells = F.concat(*[F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in rows.columns])
    made = [r[0] for r in rows.orderBy(*order).select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).collect()]
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in rows.columns) + "</tr>"
    parts = [made[i : i + wrap] for i in range(0, len(made), wrap)] if wrap else [made]
    return "".join(f"<table>{head}{''.join(p)}</table>" for p in parts)


def traces_html(trace: DataFrame, names: list[str], chunks: list[int] | None = None, size: int = BOARD) -> str:
    """A strip of bits for every signal of ``trace`` (pos, <names>), optionally only some chunks of ``size``."""
    kept = trace if chunks is None else trace.where(F.expr(f"pos div {size}").isin(*chunks))
    strips = []
    for n in names:
        bits = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col(n), "1").otherwise("0").alias("c"))))
        text = kept.agg(F.array_join(F.transform(bits, lambda s: s["c"]), "")).first()[0]
        strips.append(f"<div><b>{n}</b> <code>{text}</code></div>")
    return "".join(strips)


def summary_text(design, limit: int = 25) -> list[str]:
    """Counts, cell types by frequency, and the first issues with how many more there are."""
    s = design.summary().first()
    types = design.instances.groupBy("cell_type").count().orderBy(F.desc("count"), "cell_type").collect()
    issues = design.validation_issues().orderBy("issue", "node")
    shown, total = issues.limit(limit).collect(), issues.count()
    out = [f"{k}: {v}" for k, v in s.asDict().items()] + [f"{r['count']:6d}  {r.cell_type}" for r in types]
    out += [f"{r.issue}: {r.node}" for r in shown] + ([f"... and {total - limit} more"] if total > limit else [])
    return out if total else [*out, "no issues"]


def net_text(design, name: str, driver_only: bool = False) -> list[str]:
    """A net's names, drivers and loads; loads of one kind are counted."""
    net = design.resolve_one(name)
    pins = design.signals.where(F.col("net") == net)
    drivers = pins.where("direction = 'output'").select(F.concat_ws(".", "instance", "pin").alias("x")).orderBy("x").collect()
    if driver_only:
        return [f"net {net}", *[f"driver {r.x}" for r in drivers]]
    loads = pins.where("direction = 'input'").groupBy("cell_type", "pin", "role").count().orderBy(F.desc("count"), "cell_type", "pin").collect()
    return [f"net {net}", *[f"driver {r.x}" for r in drivers], *[f"{r['count']:6d}  {r.cell_type}.{r.pin} ({r.role})" for r in loads]]


def instance_text(design, name: str, inputs_only: bool = False) -> list[str]:
    """A cell's pins, inputs first, with what drives them."""
    driver = design.single_drivers.select("net", F.concat_ws(".", "instance", "pin").alias("driver"))
    pins = design.signals.where(F.col("instance") == name)
    pins = (pins.where("direction = 'input'") if inputs_only else pins).join(driver, "net", "left").orderBy(F.col("direction") != "input", "pin")
    return [f"{r.pin:8s} {r.direction:7s} {r.role:6s} {r.net}" + (f"  from {r.driver}" if r.direction == "input" and r.driver else "") for r in pins.collect()]


def cone_text(design, target: str, stop_at_flops: bool = True) -> list[str]:
    """Size of a cone, its boundary, and its cells by type."""
    nets, cells = design.cone(target, stop_at_flops)
    kinds = cells.join(design.instances, "instance").groupBy("cell_type").count().orderBy(F.desc("count"), "cell_type").collect()
    n = cells.agg(F.count("*").alias("cells"), F.count_if("boundary").alias("boundary")).first()
    return [f"cone of {target}: {n.cells} cells, {nets.count()} nets, {n.boundary} at the boundary", *[f"{r['count']:6d}  {r.cell_type}" for r in kinds]]


def register_equation(r) -> str:
    return f"{r.q_net}' = {r.select_net} ? {r.data_net} : {r.q_net}" if r.hold_pin == "A0" else f"{r.q_net}' = {r.select_net} ? {r.q_net} : {r.data_net}"


def registers_text(design) -> list[str]:
    return [f"{r.flop}: {register_equation(r)}" for r in design.registers().orderBy("flop").collect()]


def inventory_text(design, hide: DataFrame | None = None) -> list[str]:
    """How many strong components of the state have each size, and those of several flops by their cell types, large ones first."""
    sizes, several = design.component_inventory(hide)
    rows = several.orderBy(F.desc("size"), "example").collect()
    return [
        "component sizes: " + ", ".join(f"{r.size}: {r.n}" for r in sizes.orderBy("size").collect()),
        *[f"{r.n:3d} of {r.size} flops ({', '.join(f'{t.cell_type} {t.k}' for t in r.types)}), such as {r.example}" for r in rows],
    ]


def shift_registers_text(found: DataFrame, refused: DataFrame | None = None) -> list[str]:
    out = [f"{r.name}: {r.width} stages {' -> '.join(r.stages)}; in {r.serial_net}, enable {r.enable_net}, clock {r.clock_net}, reset {r.reset_net}" for r in found.orderBy("name").collect()]
    return out + ([f"refused {', '.join(r.candidates)}: {'; '.join(r.reasons)}" for r in refused.orderBy("candidates").collect()] if refused is not None else [])


def layout_text(layout, shown: int = 8) -> list[str]:
    """Counts of a layout's components by kind and by cell, and its first logic components."""
    parts = cut(layout.components(), "components")
    kinds = parts.groupBy("kind").count().orderBy("kind").collect()
    cells = parts.groupBy("cell", "kind").count().orderBy(F.desc("count"), "cell").collect()
    first = parts.where("kind = 'logic'").orderBy("ordinal").limit(shown).join(layout.pins(), "ordinal", "left").orderBy("ordinal").collect()
    ports = [r.text for r in layout.own.where("kind = 'label'").orderBy("ordinal").select("text").collect()]
    return [
        f"cells: {layout.elements.where(F.col('kind') == 'cell').count()}", f"top cell: {layout.top}", f"instances: {sum(r['count'] for r in kinds)}", f"labels: {', '.join(ports)}",
        *[f"{r.kind}: {r['count']}" for r in kinds], *[f"{r['count']:6d}  {r.cell} [{r.kind}]" for r in cells],
        *[f"{r.instance:5s} {r.cell} at ({r.x:.3f}, {r.y:.3f}), {'mirrored, ' if r.reflect else ''}pins {', '.join(r.pins or ())}" for r in first],
    ]


def extraction_text(found) -> list[str]:
    """The nets of an extraction with their terminals, and what could not be resolved."""
    nets = found.nets.orderBy("net").collect()
    lost = found.unresolved.orderBy("kind", "name").collect()
    return [
        f"{len(nets)} nets", *[x for r in nets for x in (f"net {r.net}{' [power]' if set(r.aliases) & set(POWER_PINS) else ''} ({len(r.terminals)} terminals)", *[f"    {t}" for t in r.terminals])],
        *[f"unresolved {r.kind} {r.name}" for r in lost],
    ]


def export(design, path: str) -> None:
    """Every section of the design as JSON lines, a folder each."""
    found, refused = design.strict_shift_registers()
    for name, rows in {"nets": design.nets, "terminals": design.terminals, "instances": design.instances, "registers": design.registers(), "shift_registers": found, "refused": refused}.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def design_document(design, source: str) -> DataFrame:
    """Ports, instances, nets, shift registers with what was refused, and issues of a design, as ``document`` lines."""
    spark, t = design.nets.sparkSession, design.terminals
    pins = F.map_from_entries(F.array_sort(F.collect_list(F.struct("pin", F.struct("net", "direction", "role").alias("at")))))
    equations = F.array_join(F.transform(F.array_sort(F.map_entries("output_functions")), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "; ")
    models = F.broadcast(design.cells.select("cell_type", equations.alias("function")))
    per = t.groupBy("instance", "cell_type").agg(F.bool_or("known").alias("known_model"), F.bool_or("sequential").alias("sequential"), pins.alias("pins")).join(models, "cell_type", "left")
    on = t.groupBy("net").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == way, F.struct("ordinal", F.concat_ws(".", "instance", "pin").alias("name"))))), lambda x: x["name"]).alias(name) for name, way in (("drivers", "output"), ("loads", "input"), ("unknowns", "unknown"))])
    none = F.array().cast("array<string>")
    nets = design.nets.join(on, "net", "left").withColumns({c: F.coalesce(c, none) for c in ("drivers", "loads", "unknowns")})
    way = F.when(~F.col("is_port"), "internal").when(F.col("is_power"), "power").when(F.size("drivers") > 0, "output").when(F.size("loads") > 0, "input").otherwise("unknown")
    nets = cut(nets.withColumn("inferred_direction", way), "nets")
    found, refused = design.strict_shift_registers()

    def listed(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
        return numbered_all(rows, order, "place").select("place", value.alias("value"))

    register = json_row("name", F.lit("shift_register").alias("kind"), "width", F.col("serial_net").alias("serial_input_net"), "enable_net", "clock_net", "reset_net", "stages", F.col("external_loads").alias("external_q_loads"))
    return document(spark, {
        "source": source,
        "ports": design.ports.join(nets.select("net", "inferred_direction"), "net").select(F.col("alias").alias("key"), json_row("net", F.col("inferred_direction").alias("direction")).alias("value")),
        "instances": per.select(F.col("instance").alias("key"), json_row("cell_type", "known_model", "sequential", "function", "pins").alias("value")),
        "nets": nets.select(F.col("net").alias("key"), json_row("aliases", "is_port", "is_power", "inferred_direction", "drivers", "loads", "unknowns").alias("value")),
        "abstractions": {
            "shift_registers": listed(found, ["name"], register),
            "shift_register_rejections": listed(refused, ["candidates"], json_row("candidates", "reasons")),
        },
        "validation_issues": listed(design.validation_issues(), ["issue", "node"], json_name(F.concat_ws(": ", "issue", "node"))),
    })
