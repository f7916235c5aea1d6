"""A netlist as relations, and the questions asked of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.cells import OUTPUT_NAMES, POWER_PINS, cell_frame
from netloom.functions.names import infer_by_suffix, numbered_duplicates, sanitised
from netloom.operators import graph, motifs
from netloom.operators.relate import first_match
from netloom.shared import cut
from netloom.sources import netlist_json


#: Fixed wording of the reasons by which a stage, and then a chain, is refused, in the order in which they are given.
STAGE_REASONS = {
    "cell": "sequential cell model is not authoritative",
    "pins": "flip-flop signal pins differ from model: expected=%s, actual=%s",
    "d_and_q": "flip-flop does not expose both D and Q",
    "set": "asynchronous-set flip-flops are not supported by this shift-register abstraction",
    "d_drivers": "D net has %d drivers instead of one",
    "d_driver": "D driver is %s, not a mux2.X output",
    "d_net": "D net is not point-to-point mux.X -> flip-flop.D: %s",
    "q_net": "Q net is not driven exclusively by this flip-flop.Q",
    "mux_cell": "mux cell model is not authoritative",
    "mux_pins": "mux signal pins differ from model: expected=%s, actual=%s",
    "mux_parts": "mux is missing one of A0/A1/S/X",
    "own_q": "exactly one mux data input must be the stage's own Q",
}
CHAIN_REASONS = {
    "stages": "a shift register needs at least two stages",
    "head": "chain must have exactly one head, found %d",
    "branches": "chain branches",
    "clock": "a stage does not have exactly one clock",
    "resets": "a stage has multiple reset controls",
    "enable": "stages do not share one enable net",
    "clocks": "stages do not share one buffered clock source",
    "reset": "stages do not share one reset net",
    "ways": "mux hold/data orientation changes within chain",
    "loads": "Q has incorrect internal mux loads",
}


def typed(pins: DataFrame, cells: DataFrame) -> DataFrame:
    """Terminals (net, instance, pin, ordinal) with cell_type, known, sequential, direction and role.

    The cell type is the longest known name that the instance's name ends in. An unknown cell's pins of usual output
    names are outputs and its others inputs.
    """
    named = infer_by_suffix(pins, "instance", cells.select("cell_type"), "cell_type") if "cell_type" not in pins.columns else pins
    model = cells.select("cell_type", "inputs", "outputs", "clock_pins", "reset_pins", "set_pins", "sequential", F.lit(True).alias("known"))
    rows = named.join(model, "cell_type", "left")
    pin, power, is_known = F.col("pin"), F.col("pin").isin(*POWER_PINS), F.coalesce("known", F.lit(False))

    def among(column):
        return F.coalesce(F.array_contains(column, pin), F.lit(False))

    control = [among(c) for c in ("clock_pins", "reset_pins", "set_pins")]
    as_output = among("outputs") | (~is_known & pin.isin(*OUTPUT_NAMES))
    as_input = among("inputs") | control[0] | control[1] | control[2] | ~is_known
    direction = first_match([("power", power), ("output", as_output), ("input", as_input)], "unknown")
    sequential = F.coalesce("sequential", F.lit(False))
    role = first_match([("power", power), ("clock", control[0]), ("reset", control[1]), ("set", control[2]), ("state", as_output & sequential), ("data", as_output | as_input)], "unknown")
    return rows.select("net", "instance", "pin", "ordinal", "cell_type", is_known.alias("known"), sequential.alias("sequential"), direction.alias("direction"), role.alias("role"))


@dataclass
class Design:
    """nets (net, aliases, is_port, is_power) and terminals (see ``typed``)."""

    nets: DataFrame
    terminals: DataFrame
    cells: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str, cells: DataFrame | None = None) -> Design:
        """From a netlist file. A terminal on two nets, or twice on one, raises."""
        read = cut(netlist_json.read_nets(spark, path), "netlist")
        pins = netlist_json.pins_of(read)
        bad = netlist_json.repeated_terminals(pins).orderBy("instance", "pin").first()
        if bad:
            raise ValueError(f"{bad.instance}.{bad.pin} is connected {bad.times} times")
        return cls.of(netlist_json.nets_of(read), pins, cells if cells is not None else cell_frame(spark))

    @classmethod
    def of(cls, nets: DataFrame, pins: DataFrame, cells: DataFrame) -> Design:
        return cls(cut(nets, "nets"), cut(typed(pins, cells), "terminals"), cells)

    @property
    def signals(self) -> DataFrame:
        return self.terminals.where("role <> 'power'")

    @property
    def drivers(self) -> DataFrame:
        """(net, instance, pin, cell_type, sequential) of outputs."""
        return self.terminals.where("direction = 'output'").select("net", "instance", "pin", "cell_type", "sequential")

    @property
    def single_drivers(self) -> DataFrame:
        """``drivers`` of nets that have exactly one."""
        alone = self.drivers.groupBy("net").count().where("count = 1").select("net")
        return self.drivers.join(alone, "net", "left_semi")

    @property
    def instances(self) -> DataFrame:
        return self.terminals.groupBy("instance").agg(F.first("cell_type").alias("cell_type"), F.bool_or("sequential").alias("sequential"), F.bool_or("known").alias("known"))

    @property
    def ports(self) -> DataFrame:
        """(alias, net); of several nets of one alias the last by name counts."""
        return self.nets.select(F.explode("aliases").alias("alias"), "net").groupBy("alias").agg(F.max("net").alias("net"))

    def summary(self) -> DataFrame:
        """One row of counts."""
        i = self.instances.agg(F.count("*").alias("instances"), F.count_if("sequential").alias("state_elements"))
        n = self.nets.agg(F.count("*").alias("nets"), F.count_if(~F.col("is_power")).alias("signal_nets"))
        return i.select("*", n.select("nets").scalar().alias("nets"), n.select("signal_nets").scalar().alias("signal_nets"), self.terminals.agg(F.count("*")).scalar().alias("terminals"))

    def resolve(self, names: list[str]) -> DataFrame:
        """(name, net): a net's own name, else an alias, else a terminal ``instance.pin``; null if none."""
        spark = self.nets.sparkSession
        asked = spark.createDataFrame([(n,) for n in names], "name string")
        own = self.nets.select(F.col("net").alias("name"), F.col("net").alias("by_net"))
        alias = self.ports.select(F.col("alias").alias("name"), F.col("net").alias("by_alias"))
        pin = self.terminals.select(F.concat_ws(".", "instance", "pin").alias("name"), F.col("net").alias("by_pin"))
        found = asked.join(own, "name", "left").join(alias, "name", "left").join(pin, "name", "left")
        return found.select("name", F.coalesce("by_net", "by_alias", "by_pin").alias("net"))

    def resolve_one(self, name: str) -> str:
        net = self.resolve([name]).first().net
        if net is None:
            raise KeyError(f"unknown net, port or terminal {name}")
        return net

    def resolve_instance(self, name: str) -> str:
        """An instance by its name, or by the one whose name goes on with an underscore after ``name``."""
        begins = (F.col("instance") == name) | F.startswith("instance", F.lit(name + "_"))
        found = [r.instance for r in self.terminals.where(begins).select("instance").distinct().orderBy(F.col("instance") != name, "instance").limit(9).collect()]
        if not found:
            raise KeyError(f"unknown instance {name}")
        if found[0] != name and len(found) > 1:
            raise KeyError(f"several instances begin with {name}_: {', '.join(found[:8])}{' and more' if len(found) > 8 else ''}")
        return found[0]

    def data_arcs(self) -> DataFrame:
        """(src, dst, instance, sequential): from an output's net back to the nets of its cell's data inputs."""
        outs = self.drivers.select(F.col("net").alias("src"), "instance", "sequential")
        ins = self.terminals.where("direction = 'input' AND role = 'data'").select("instance", F.col("net").alias("dst"))
        return outs.join(ins, "instance").select("src", "dst", "instance", "sequential")

    def cones(self, targets: DataFrame, stop_at_flops: bool = True) -> tuple[DataFrame, DataFrame]:
        """(root, net) and (root, instance, boundary) of what feeds each target (root, net) through data inputs.

        A flop that drives a net of the cone is one of its cells, and its boundary if the walk stops there.
        """
        arcs = self.data_arcs()
        if stop_at_flops:
            arcs = arcs.where("NOT sequential")
        nets = graph.reach(arcs.select("src", "dst").distinct(), targets.select("root", F.col("net").alias("node"))).select("root", F.col("node").alias("net"))
        cells = nets.join(self.drivers, "net").select("root", "instance", (F.col("sequential") & F.lit(stop_at_flops)).alias("boundary")).distinct()
        return nets, cells

    def cone(self, target: str, stop_at_flops: bool = True) -> tuple[DataFrame, DataFrame]:
        net = self.resolve_one(target)
        return self.cones(self.nets.sparkSession.createDataFrame([(net, net)], "root string, net string"), stop_at_flops)

    def dependencies(self) -> DataFrame:
        """(dst, src): the flops in the cone of every flop's D, all flops in one fixpoint."""
        d = self.terminals.where("sequential AND pin = 'D'").select(F.col("instance").alias("root"), "net")
        _, cells = self.cones(d)
        return cells.where("boundary").select(F.col("root").alias("dst"), F.col("instance").alias("src"))

    def state_classes(self, hide: DataFrame | None = None, thin_limit: int = 30) -> DataFrame:
        """(members, kind, n_cells, extra_state) of the state's strong components of two flops (see
        ``motifs.classify_pairs``; extra_state: other flops their cones begin at) and of one, kind single, those of
        ``hide`` (instance) left out."""
        d = self.terminals.where("sequential AND pin = 'D'").select(F.col("instance").alias("root"), "net")
        cells = cut(self.cones(d)[1], "cones")
        arcs = cells.where("boundary").select(F.col("root").alias("dst"), F.col("instance").alias("src"))
        parts = cut(graph.strongly_connected(self.instances.where("sequential").select(F.col("instance").alias("node")), arcs), "components")
        members = parts.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("one"), F.max("node").alias("two"))
        muxes = self.instances.select("instance", (F.col("cell_type") == "mux2").alias("is_mux"))
        cones = cells.join(muxes, "instance").select(F.col("root").alias("node"), F.col("instance").alias("cell"), (F.col("is_mux") & ~F.col("boundary")).alias("is_mux"), F.col("boundary").alias("is_state"))
        behind = parts.join(cones.where("is_state"), "node").groupBy("component").agg(F.array_sort(F.collect_set("cell")).alias("behind"))
        both = F.array("one", "two")
        pairs = motifs.classify_pairs(parts, cones, thin_limit).join(members, "component").join(behind, "component").select(both.alias("members"), "kind", "n_cells", F.array_except("behind", both).alias("extra_state"))
        lone = members.where("n = 1")
        if hide is not None:
            lone = lone.join(hide.select(F.col("instance").alias("one")), "one", "left_anti")
        return pairs.unionByName(lone.select(F.array("one").alias("members"), F.lit("single").alias("kind")), allowMissingColumns=True)

    def neighbourhood(self, instance: str, radius: int) -> tuple[DataFrame, DataFrame]:
        """(instance) and (net) within ``radius`` steps of a cell; steps never lead through a power net. All signal nets
        of the cells found are listed, a rail too where a signal pin is tied to it."""
        joined = self.signals.join(self.nets.where("NOT is_power").select("net"), "net", "left_semi").select("instance", "net").distinct()
        arcs = joined.select(F.concat(F.lit("i:"), "instance").alias("src"), F.concat(F.lit("n:"), "net").alias("dst"))
        start = self.nets.sparkSession.createDataFrame([("r", f"i:{instance}")], "root string, node string")
        seen = graph.neighbourhood(arcs, start, 2 * max(radius, 0))
        cells = seen.where("node LIKE 'i:%'").select(F.substr("node", F.lit(3)).alias("instance"))
        return cells, self.signals.join(cells, "instance", "left_semi").select("net").distinct()

    def net_neighbourhood(self, net: str, radius: int) -> tuple[DataFrame, DataFrame]:
        """(instance) and (net) within ``radius`` steps of a net: cells on it, their nets, and so on."""
        joined = self.signals.join(self.nets.where("NOT is_power").select("net"), "net", "left_semi").select("instance", "net").distinct()
        arcs = joined.select(F.concat(F.lit("n:"), "net").alias("src"), F.concat(F.lit("i:"), "instance").alias("dst"))
        start = self.nets.sparkSession.createDataFrame([("r", f"n:{self.resolve_one(net)}")], "root string, node string")
        seen = graph.neighbourhood(arcs, start, 2 * max(radius, 0))
        return seen.where("node LIKE 'i:%'").select(F.substr("node", F.lit(3)).alias("instance")), seen.where("node LIKE 'n:%'").select(F.substr("node", F.lit(3)).alias("net"))

    def transparent_sources(self, through: tuple[str, ...] = ("buf", "clkbuf")) -> DataFrame:
        """(net, source): every net followed back through buffers; its own source where none drives it alone."""
        passes = self.single_drivers.where(F.col("cell_type").isin(*through)).select("net", "instance")
        ins = self.terminals.where("direction = 'input' AND role = 'data'").groupBy("instance").agg(F.min("net").alias("parent"), F.count("*").alias("n")).where("n = 1")
        parents = self.nets.select("net").join(passes.join(ins, "instance").select("net", "parent"), "net", "left")
        found = graph.pointer_roots(parents.withColumnRenamed("net", "node"))
        return found.select(F.col("node").alias("net"), F.coalesce("root", "node").alias("source"))

    def buffer_paths(self, nets: DataFrame, through: tuple[str, ...] = ("buf", "clkbuf")) -> tuple[DataFrame, DataFrame]:
        """(instance) and (net) of the buffers and nets by which ``nets`` (net) are reached, back to what no buffer drives."""
        passes = self.single_drivers.where(F.col("cell_type").isin(*through)).select("net", "instance")
        behind = self.terminals.where("pin = 'A'").groupBy("instance").agg(F.min("net").alias("parent"))
        arcs = cut(passes.join(behind, "instance").select(F.col("net").alias("src"), F.col("parent").alias("dst"), "instance"), "buffers")
        seen = graph.reach(arcs.select("src", "dst"), nets.select(F.lit(0).alias("root"), F.col("net").alias("node")).distinct()).select(F.col("node").alias("net")).distinct()
        return arcs.join(seen, F.col("src") == F.col("net"), "left_semi").select("instance"), seen

    def register_graph(self) -> tuple[DataFrame, DataFrame]:
        """(instance) and (net) of all flops, of the muxes of ``registers``, and of the nets on them."""
        cells = self.instances.where("sequential").select("instance").unionByName(self.registers().select(F.col("mux").alias("instance"))).distinct()
        return cells, self.signals.join(cells, "instance", "left_semi").select("net").distinct()

    def chain_graph(self) -> tuple[DataFrame, DataFrame]:
        """(instance) and (net) of the ``shift_chains``: flops, muxes, their data, select, clock and reset nets, and the
        buffers behind the clocks."""
        registers = cut(self.registers(), "registers")
        flops = self.terminals.where("sequential").join(registers.select(F.col("flop").alias("instance")), "instance", "left_semi")
        own = registers.select(F.explode(F.array("q_net", "d_net", "data_net", "select_net")).alias("net"))
        buffers, path = self.buffer_paths(flops.where("role = 'clock'").select("net"))
        cells = registers.select(F.explode(F.array("flop", "mux")).alias("instance")).unionByName(buffers).distinct()
        return cells, own.unionByName(flops.where("role IN ('clock', 'reset')").select("net")).unionByName(path).distinct()

    def component_inventory(self, hide: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(size, n) of the state's strong components, and (size, types, n, example) of those of several flops by their
        cell types, without those that ``hide`` (instance) holds whole."""
        flops = self.instances.where("sequential").select("instance", "cell_type")
        arcs = self.dependencies()
        parts = cut(graph.strongly_connected(flops.select(F.col("instance").alias("node")), arcs), "components")
        hidden = F.lit(False) if hide is None else F.col("hidden")
        rows = parts.join(flops, F.col("node") == F.col("instance"))
        if hide is not None:
            rows = rows.join(hide.select("instance", F.lit(True).alias("hidden")).distinct(), "instance", "left")
        kinds = rows.groupBy("component", "cell_type").agg(F.count("*").alias("k"), F.min("node").alias("least"), F.bool_and(F.coalesce(hidden, F.lit(False))).alias("gone"))
        each = kinds.groupBy("component").agg(F.sum("k").alias("size"), F.min("least").alias("example"), F.bool_and("gone").alias("gone"), F.array_sort(F.collect_list(F.struct("cell_type", "k"))).alias("types"))
        each = cut(each, "inventory")
        several = each.where("size > 1 AND NOT gone").groupBy("size", "types").agg(F.count("*").alias("n"), F.min("example").alias("example"))
        return each.groupBy("size").agg(F.count("*").alias("n")), several

    def validation_issues(self) -> DataFrame:
        """(issue, node); rails are exempt from the checks of nets."""
        t, nets = self.terminals, self.nets.where("NOT is_power")
        driven = self.drivers.groupBy("net").agg(F.count("*").alias("n"))
        return motifs.issues({
            "unknown cell model": self.instances.where("NOT known").select(F.col("instance").alias("node")),
            "unknown pin": t.where("direction = 'unknown'").select(F.concat_ws(".", "instance", "pin").alias("node")),
            "multiple drivers": driven.where("n > 1").join(nets, "net", "left_semi").select(F.col("net").alias("node")),
            "undriven internal net": nets.where("NOT is_port AND NOT startswith(net, 'unresolved_')").join(driven, "net", "left_anti").select(F.col("net").alias("node")),
        })

    def registers(self) -> DataFrame:
        """Flops behind a mux that feeds back their own output; see ``motifs.enabled_registers``."""
        d = self.terminals.where("sequential AND pin = 'D'").select(F.col("instance").alias("flop"), F.col("net").alias("d_net"))
        q = self.terminals.where("sequential AND pin = 'Q'").select(F.col("instance").alias("flop"), F.col("net").alias("q_net"))
        mux = self.terminals.where("cell_type = 'mux2'").groupBy(F.col("instance").alias("mux")).pivot("pin", ["A0", "A1", "S", "X"]).agg(F.min("net"))
        mux = mux.select("mux", F.col("A0").alias("a0_net"), F.col("A1").alias("a1_net"), F.col("S").alias("select_net"), F.col("X").alias("x_net")).dropna()
        alone = self.single_drivers.where("pin = 'X'").select(F.col("instance").alias("mux"))
        return motifs.enabled_registers(d.join(q, "flop"), mux.join(alone, "mux", "left_semi"))

    def shift_chains(self) -> DataFrame:
        """(node, head, rank): permissive chains of ``registers``."""
        registers = self.registers()
        source = self.single_drivers.select(F.col("net").alias("data_net"), F.col("instance").alias("parent"))
        links = registers.join(source, "data_net").join(registers.select(F.col("flop").alias("parent")), "parent", "left_semi").select(F.col("flop").alias("node"), "parent")
        return graph.chains(links, registers.select(F.col("flop").alias("node")))

    def stage_reasons(self) -> DataFrame:
        """(flop, mux, hold_pin, data_pin, data_net, select_net, q_net, reasons) of every flop held against the strict stage rules."""
        t = self.terminals.where("role <> 'power'")
        expected = F.array_sort(F.array_distinct(F.concat("inputs", "outputs", "clock_pins", "reset_pins", "set_pins")))
        model = F.broadcast(self.cells.select("cell_type", expected.alias("expected"), F.array_sort(F.concat("inputs", "outputs", "clock_pins", "reset_pins")).alias("mux_expected"), F.size("set_pins").alias("n_set")))
        actual = t.groupBy("instance", "cell_type", "sequential", "known").agg(F.array_sort(F.collect_set("pin")).alias("actual"), F.map_from_entries(F.collect_list(F.struct("pin", "net"))).alias("pins")).join(model, "cell_type", "left")
        out = self.drivers.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("instance", "pin", "cell_type"))).alias("drivers"))
        on = t.groupBy("net").agg(F.array_sort(F.collect_set(F.concat_ws(".", "instance", "pin"))).alias("members"))
        net = on.join(out, "net", "left").withColumn("drivers", F.coalesce("drivers", F.expr("cast(array() as array<struct<instance:string,pin:string,cell_type:string>>)")))
        flop = actual.where("sequential").select(F.col("instance").alias("flop"), "known", "actual", "expected", "n_set", F.element_at("pins", "D").alias("d_net"), F.element_at("pins", "Q").alias("q_net"))
        flop = flop.join(net.select(F.col("net").alias("d_net"), F.col("members").alias("d_members"), F.col("drivers").alias("d_drivers")), "d_net", "left")
        flop = flop.join(net.select(F.col("net").alias("q_net"), F.col("drivers").alias("q_drivers")), "q_net", "left")
        driver = F.get("d_drivers", F.lit(0))
        is_mux = (F.size("d_drivers") == 1) & (driver["cell_type"] == "mux2") & (driver["pin"] == "X")
        flop = flop.withColumn("mux", F.when(is_mux, driver["instance"])).join(actual.select(F.col("instance").alias("mux"), F.col("known").alias("m_known"), F.col("actual").alias("m_actual"), F.col("mux_expected").alias("m_expected"), F.col("pins").alias("m_pins")), "mux", "left")
        has_mux, q, d = F.col("mux").isNotNull(), F.col("q_net"), F.col("d_net")
        complete = F.size(F.array_except(F.array(*map(F.lit, ("A0", "A1", "S", "X"))), "m_actual")) == 0
        a0, a1 = F.coalesce(F.element_at("m_pins", "A0") == q, F.lit(False)), F.coalesce(F.element_at("m_pins", "A1") == q, F.lit(False))
        listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
        wanted = F.array_sort(F.array_distinct(F.concat(F.array(F.concat("flop", F.lit(".D"))), F.transform(F.slice("d_drivers", 1, 1), lambda x: F.concat_ws(".", x["instance"], x["pin"])))))
        say = STAGE_REASONS
        reasons = [
            F.when(~F.col("known"), say["cell"]),
            F.when(F.coalesce(F.col("actual") != F.col("expected"), F.lit(False)), F.format_string(say["pins"], listed(F.col("expected")), listed(F.col("actual")))),
            F.when(d.isNull() | q.isNull(), say["d_and_q"]),
            F.when(F.coalesce("n_set", F.lit(0)) > 0, say["set"]),
            F.when(d.isNotNull() & (F.size("d_drivers") != 1), F.format_string(say["d_drivers"], F.size("d_drivers"))),
            F.when((F.size("d_drivers") == 1) & ~is_mux, F.format_string(say["d_driver"], F.concat_ws(".", driver["instance"], driver["pin"]))),
            F.when(d.isNotNull() & (F.col("d_members") != wanted), F.format_string(say["d_net"], listed(F.col("d_members")))),
            F.when(q.isNotNull() & ~((F.size("q_drivers") == 1) & (F.get("q_drivers", F.lit(0))["instance"] == F.col("flop")) & (F.get("q_drivers", F.lit(0))["pin"] == "Q")), say["q_net"]),
            F.when(has_mux & ~F.col("m_known"), say["mux_cell"]),
            F.when(has_mux & (F.col("m_actual") != F.col("m_expected")), F.format_string(say["mux_pins"], listed(F.col("m_expected")), listed(F.col("m_actual")))),
            F.when(has_mux & ~complete, say["mux_parts"]),
            F.when(has_mux & complete & q.isNotNull() & (a0 == a1), say["own_q"]),
        ]
        data = F.when(a0, F.element_at("m_pins", "A1")).otherwise(F.element_at("m_pins", "A0"))
        return flop.select("flop", "mux", F.when(a0, "A0").otherwise("A1").alias("hold_pin"), F.when(a0, "A1").otherwise("A0").alias("data_pin"), data.alias("data_net"), F.element_at("m_pins", "S").alias("select_net"), "q_net", F.array_compact(F.array(*reasons)).alias("reasons"))

    def strict_shift_registers(self) -> tuple[DataFrame, DataFrame]:
        """(name, width, stages, serial_net, enable_net, clock_net, reset_net, external_loads) of exact shift registers,
        and (candidates, reasons) of what was refused."""
        stages = cut(self.stage_reasons(), "stages")
        refused = stages.where("size(reasons) > 0 OR mux IS NULL").select(F.array("flop").alias("candidates"), "reasons")
        good = stages.where("size(reasons) = 0 AND mux IS NOT NULL").drop("reasons")
        source = self.single_drivers.where("pin = 'Q'").select(F.col("net").alias("data_net"), F.col("instance").alias("parent"))
        links = cut(good.join(source, "data_net").join(good.select(F.col("flop").alias("parent")), "parent", "left_semi").select(F.col("flop").alias("node"), "parent"), "links")
        comp = graph.connected_components(links.select(F.col("node").alias("u"), F.col("parent").alias("v")))
        member = good.join(comp, F.col("flop") == F.col("node"), "left").withColumn("component", F.coalesce("root", "flop")).drop("node", "root")
        member = member.join(links.withColumnRenamed("node", "flop"), "flop", "left")
        kids = links.groupBy(F.col("parent").alias("flop")).agg(F.array_sort(F.collect_list("node")).alias("children"))
        member = member.join(kids, "flop", "left").join(graph.chains(links, good.select(F.col("flop").alias("node"))).withColumnRenamed("node", "flop"), "flop")
        clock = self.terminals.where("sequential AND role = 'clock'").groupBy(F.col("instance").alias("flop")).agg(F.min("net").alias("clock_leaf"), F.count("*").alias("n_clock"))
        reset = self.terminals.where("sequential AND role = 'reset'").groupBy(F.col("instance").alias("flop")).agg(F.min("net").alias("reset_net"), F.count("*").alias("n_reset"))
        member = member.join(clock, "flop", "left").join(reset, "flop", "left").join(self.transparent_sources().select(F.col("net").alias("clock_leaf"), F.col("source").alias("clock_net")), "clock_leaf", "left")
        loads = self.terminals.where("direction = 'input'").select(F.col("net").alias("q_net"), "instance", F.concat_ws(".", "instance", "pin").alias("load"))
        muxes = member.select(F.col("mux").alias("instance"), F.col("component").alias("c2"), F.concat_ws(".", "mux", "hold_pin").alias("own"), F.concat_ws(".", "mux", "data_pin").alias("serial"), F.col("flop").alias("of"), F.col("parent").alias("of_parent"))
        met = member.select("flop", "component", "q_net").join(loads, "q_net").join(muxes, "instance", "left")
        inside = F.col("c2") == F.col("component")
        allowed = ((F.col("of") == F.col("flop")) & (F.col("load") == F.col("own"))) | ((F.col("of_parent") == F.col("flop")) & (F.col("load") == F.col("serial")))
        taps = met.groupBy("flop").agg(F.bool_or(F.coalesce(inside & ~allowed, F.lit(False))).alias("stray"), F.array_sort(F.collect_set(F.when(~F.coalesce(inside & allowed, F.lit(False)), F.col("load")))).alias("external"))
        member = cut(member.join(taps, "flop", "left"), "members")
        one = lambda c: F.count_distinct(F.struct(c))
        entry = F.struct("rank", "flop", "external", "data_net")
        groups = member.groupBy("component").agg(
            F.count("*").alias("width"), F.array_sort(F.collect_list("flop")).alias("candidates"), F.count_if(F.col("parent").isNull()).alias("heads"), F.max(F.size(F.coalesce("children", F.array().cast("array<string>")))).alias("kids"),
            one("select_net").alias("enables"), one("clock_net").alias("clocks"), one("reset_net").alias("resets"), one(F.struct("hold_pin", "data_pin")).alias("ways"), F.count_if(F.coalesce("n_clock", F.lit(0)) != 1).alias("odd_clock"),
            F.count_if(F.coalesce("n_reset", F.lit(0)) > 1).alias("odd_reset"), F.bool_or(F.coalesce("stray", F.lit(False))).alias("stray"), F.array_sort(F.collect_list(entry)).alias("entries"), F.min("select_net").alias("enable_net"),
            F.min("clock_net").alias("clock_net"), F.min("reset_net").alias("reset_net"),
        )
        why = CHAIN_REASONS
        lined = F.col("heads").eqNullSafe(1) & (F.col("kids") <= 1)
        reasons = [
            F.when(F.col("width") < 2, why["stages"]),
            F.when(F.col("heads") != 1, F.format_string(why["head"], "heads")),
            F.when(F.col("kids") > 1, why["branches"]),
            F.when(lined & (F.col("odd_clock") > 0), why["clock"]),
            F.when(lined & (F.col("odd_reset") > 0), why["resets"]),
            F.when(lined & (F.col("enables") != 1), why["enable"]),
            F.when(lined & (F.col("clocks") != 1), why["clocks"]),
            F.when(lined & (F.col("resets") != 1), why["reset"]),
            F.when(lined & (F.col("ways") != 1), why["ways"]),
            F.when(lined & F.col("stray"), why["loads"]),
        ]
        groups = groups.withColumn("reasons", F.array_compact(F.array(*reasons)))
        refused = refused.unionByName(groups.where("size(reasons) > 0").select("candidates", "reasons"))
        found = groups.where("size(reasons) = 0").withColumn("serial_net", F.get("entries", F.lit(0))["data_net"]).join(self.nets.select(F.col("net").alias("serial_net"), "aliases", "is_port"), "serial_net", "left")
        label = F.coalesce(F.when(F.col("is_port"), sanitised(F.array_join("aliases", "_"))), F.lit("internal"))
        base = F.concat(F.lit("shift_"), F.when(label == "", "register").otherwise(label))
        named = numbered_duplicates(found.withColumn("base", base), "base", ["candidates"], "name")
        stages_ = F.transform("entries", lambda e: e["flop"])
        external = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["flop"], e["external"])))
        return named.select("name", "width", stages_.alias("stages"), "serial_net", "enable_net", "clock_net", "reset_net", external.alias("external_loads")), refused
