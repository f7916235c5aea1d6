"""Evaluating circuits over many rows of states and inputs.

A circuit's demanded cone is levelised on the driver, where its plan is built; its size is bounded by ``MAX_GATES``.
Rows stay distributed: one boolean column per net, one projection per level, all inside whole-stage codegen. Long
stimuli fold over clock edges in Arrow batches, with one NumPy lane per run.

Values: two-valued; a null input raises. Nets that are supplied cut the circuit, drivers or not; rails are forced.
State wins over inputs. Outputs after an edge use inputs and the new flop values only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.cells import BASIC_CELLS, POWER_VALUES, Cell
from netloom.functions.logic import Node, known, parse
from netloom.shared import cut, cut_any

MAX_GATES = 100_000


class EvaluationError(ValueError):
    """A demanded net that has no value: undriven, driven twice, or on a combinational cycle."""


@dataclass(frozen=True)
class Instance:
    name: str
    cell: Cell
    pins: dict[str, str]  # pin -> net


@dataclass
class Circuit:
    """Instances by name, drivers by net; built from a bounded terminal table."""

    instances: dict[str, Instance]
    rails: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self):
        self.drivers: dict[str, list[tuple[Instance, str]]] = {}
        for i in self.instances.values():
            for pin in i.cell.outputs:
                if pin in i.pins:
                    self.drivers.setdefault(i.pins[pin], []).append((i, pin))
        self.flops = {n: i for n, i in self.instances.items() if i.cell.sequential}

    @classmethod
    def of(cls, pins: Iterable[tuple[str, str, str, str]], cells: dict[str, Cell] = BASIC_CELLS, rails: dict[str, bool] | None = None) -> Circuit:
        """From (instance, cell_type, pin, net) rows."""
        found: dict[str, tuple[str, dict[str, str]]] = {}
        for name, cell, pin, net in pins:
            found.setdefault(name, (cell, {}))[1][pin] = net
            if len(found) > MAX_GATES:
                raise ValueError(f"over {MAX_GATES} instances; restrict to a cone first")
        return cls({n: Instance(n, cells[c], p) for n, (c, p) in found.items()}, dict(POWER_VALUES if rails is None else rails))

    def q_net(self, flop: str) -> str:
        return self.instances[flop].pins["Q"]

    def order(self, nets: Iterable[str], given: set[str]) -> list[list[tuple[str, Node, dict[str, str]]]]:
        """Levels of (net, function, pin -> net) that the demanded ``nets`` need, ``given`` nets and rails apart."""
        level: dict[str, int] = {}
        gate: dict[str, tuple[Node, dict[str, str]]] = {}
        pending: set[str] = set()
        given = given | set(self.rails)
        stack = [(n, False) for n in nets]
        while stack:
            net, ready = stack.pop()
            if net in given or net in level:
                continue
            if ready:
                level[net] = 1 + max((level.get(n, 0) for n in gate[net][1].values()), default=0)
                pending.discard(net)
                continue
            if net in pending:
                raise EvaluationError(f"{net} is on a combinational cycle")
            drivers = self.drivers.get(net, [])
            if len(drivers) != 1:
                raise EvaluationError(f"{net} has {len(drivers)} drivers")
            instance, pin = drivers[0]
            if instance.cell.sequential:
                raise EvaluationError(f"{net} is state without a value")
            tree = parse(instance.cell.outputs[pin])
            missing = [s for s in tree.symbols if s not in instance.pins]
            if missing:
                raise EvaluationError(f"{instance.name}.{sorted(missing)[0]} is not connected")
            gate[net] = tree, {s: instance.pins[s] for s in tree.symbols}
            pending.add(net)
            stack.append((net, True))
            stack += [(n, False) for n in gate[net][1].values()]
        rows: list[list] = [[] for _ in range(max(level.values(), default=0))]
        for net in sorted(level):
            rows[level[net] - 1].append((net, *gate[net]))
        return rows

    def symbol(self, given: set[str], name) -> Column:
        """Column of a net: a rail's constant, a checked given column, or a computed one."""
        if name in self.rails:
            return F.lit(self.rails[name])
        return known(name) if name in given else F.col(f"`{name}`")

    def evaluate(self, rows: DataFrame, nets: Iterable[str]) -> DataFrame:
        """``rows`` (boolean columns named by nets) with a column for each of ``nets`` and of their cone."""
        given, nets = set(rows.columns), list(nets)
        for gates in self.order(nets, given):
            rows = rows.withColumns({net: tree.column(lambda s, p=pins: self.symbol(given, p[s])) for net, tree, pins in gates})
        wanted = {n: F.lit(self.rails[n]) for n in nets if n in self.rails}
        return rows.withColumns(wanted) if wanted else rows

    def next_state(self, flop: str) -> Node:
        """Clear beats preset beats data, as one tree over net names."""
        cell, pins = self.instances[flop].cell, self.instances[flop].pins

        def over_nets(text: str) -> Node:
            def walk(n: Node) -> Node:
                return Node("symbol", pins[n.value]) if n.op == "symbol" else Node(n.op, n.value, tuple(map(walk, n.parts)))

            return walk(parse(text))

        tree = over_nets(cell.next_state)
        if cell.preset:
            tree = Node("or", parts=(over_nets(cell.preset), tree))
        if cell.clear:
            tree = Node("and", parts=(Node("not", parts=(over_nets(cell.clear),)), tree))
        return tree

    def transition(self, rows: DataFrame, outputs: Iterable[str] = ()) -> DataFrame:
        """One clock edge for every row: next_<flop> for each flop; before_<net> and after_<net> for ``outputs``.

        ``rows`` has a column for each flop's Q net and each input net.
        """
        trees = {f: self.next_state(f) for f in self.flops}
        given, outputs, base = set(rows.columns), list(outputs), list(rows.columns)
        demand = sorted({n for t in trees.values() for n in t.symbols} | set(outputs))
        wide = self.evaluate(rows, demand)
        wide = wide.withColumns({f"next_{f}": t.column(lambda n: self.symbol(given, n)) for f, t in trees.items()})
        out = wide.select(*[F.col(f"`{c}`") for c in base], *[F.col(f"`{n}`").alias(f"before_{n}") for n in outputs], *[F.col(f"`next_{f}`") for f in trees])
        if not outputs:
            return out
        q = {self.q_net(f): f for f in self.flops}
        after = out.select("*", *[F.col(f"`next_{f}`").alias(f"_q_{n}") for n, f in q.items()])
        names = [c for c in after.columns]
        moved = after.select(*[F.col(f"`{c}`").alias(f"_keep_{c}") if c in q else F.col(f"`{c}`") for c in names if not c.startswith("_q_")], *[F.col(f"`_q_{n}`").alias(n) for n in q])
        done = self.evaluate(moved, outputs)
        return done.select(
            *[F.col(f"`_keep_{c}`").alias(c) if c in q else F.col(f"`{c}`") for c in base], *[F.col(f"`before_{n}`") for n in outputs],
            *[F.col(f"`next_{f}`") for f in trees], *[F.col(f"`{n}`").alias(f"after_{n}") for n in outputs],
        )

    # Folds over clock edges

    def lanes(self, values: dict[str, np.ndarray], nets: Iterable[str]) -> dict[str, np.ndarray]:
        """Values of ``nets`` for every lane, by NumPy in level order."""
        values = dict(values)
        size = len(next(iter(values.values())))
        values |= {n: np.full(size, v) for n, v in self.rails.items()}
        for gates in self.order(list(nets), set(values)):
            for net, tree, pins in gates:
                values[net] = _lane(tree, lambda s, p=pins: values[p[s]], size)
        return values

    def fold(self, runs: DataFrame, inputs: dict[str, str], watch: list[str], state: dict[str, bool] | None = None, constants: dict[str, bool] | None = None) -> DataFrame:
        """(run, edge, <watched nets before the edge>, <flops after it>) of every clock edge of every run.

        ``runs`` has run (long) and, for each input net, an array<boolean> column (``inputs``: net -> column). Arrays of
        one value hold for the whole run; others end together or a shorter one counts as false. All flops start at
        ``state`` (false if not listed). Time is sequential; runs are parallel.
        """
        flops = sorted(self.flops)
        trees = {f: self.next_state(f) for f in flops}
        demand = sorted({n for t in trees.values() for n in t.symbols} | set(watch))
        start, fixed, columns = state or {}, constants or {}, list(dict.fromkeys(inputs.values()))
        schema = "run long, edge int, " + ", ".join(f"`{n}` boolean" for n in [*watch, *flops])

        def simulate(batches):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                given = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns}
                longest = [max((len(given[c][i] or ()) for c in columns), default=0) for i in range(n)]
                now = {self.q_net(f): np.full(n, start.get(f, False)) for f in flops}
                run = np.array(batch.column(batch.schema.get_field_index("run")).to_pylist(), np.int64)
                for edge in range(max(longest)):
                    live = np.array([edge < x for x in longest])
                    bits = {net: np.array([_bit(given[c][i], edge) for i in range(n)]) for net, c in inputs.items()}
                    lanes = self.lanes({k: np.full(n, v) for k, v in fixed.items()} | bits | now, demand)
                    after = {f: _lane(trees[f], lanes.__getitem__, n) for f in flops}
                    arrays = [run, np.full(n, edge, np.int32), *[lanes[w] for w in watch], *[after[f] for f in flops]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[live]) for a in arrays], names=["run", "edge", *watch, *flops])
                    now = {self.q_net(f): after[f] for f in flops}

        return runs.select("run", *columns).mapInArrow(simulate, schema)

    def toggling(self, states: DataFrame, net: str) -> DataFrame:
        """``states`` with ``changed``: the flops whose next value differs between ``net`` at 0 and at 1."""
        keys, flops = [c for c in states.columns if c != net], sorted(self.flops)
        low = self.transition(states.withColumn(net, F.lit(False)))
        low = low.select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`next_{f}`").alias(f"_low_{f}") for f in flops])
        both = self.transition(low.withColumn(net, F.lit(True)))
        changed = F.array_compact(F.array(*[F.when(F.col(f"`_low_{f}`") != F.col(f"`next_{f}`"), F.lit(f)) for f in flops]))
        return both.select(*[F.col(f"`{c}`") for c in keys], changed.alias("changed"))

    def influences(self, spark, candidate: str, target: str, max_variables: int = 20) -> DataFrame:
        """The first assignment, counting up with the first variable highest, in which toggling ``candidate`` changes
        ``target``; no row if there is none."""
        variables = [n for n in self.leaves(target) if n != candidate]
        if len(variables) > max_variables:
            raise ValueError(f"{len(variables)} variables, over {max_variables}")
        n = len(variables)
        rows = spark.range(1 << n).select("id", *[(F.getbit("id", F.lit(n - 1 - i)) == 1).alias(v) for i, v in enumerate(variables)])
        low = self.evaluate(rows.withColumn(candidate, F.lit(False)), [target]).select("id", *[F.col(f"`{v}`") for v in variables], F.col(f"`{target}`").alias("_low"))
        both = self.evaluate(low.withColumn(candidate, F.lit(True)), [target])
        found = both.select("id", *[F.col(f"`{v}`") for v in variables], F.col("_low").alias("low"), F.col(f"`{target}`").alias("high"))
        return found.where("low <> high").orderBy("id").limit(1)

    def leaves(self, target: str) -> list[str]:
        """Nets at which the combinational cone of ``target`` begins: state and undriven inputs, rails apart."""
        seen, found, stack = set(), set(), [target]
        while stack:
            net = stack.pop()
            if net in seen or net in self.rails:
                continue
            seen.add(net)
            drivers = [(i, p) for i, p in self.drivers.get(net, []) if not i.cell.sequential]
            if not drivers:
                found.add(net)
            for i, p in drivers:
                stack += [i.pins[s] for s in parse(i.cell.outputs[p]).symbols]
        return sorted(found)


def _bit(bits: list | None, edge: int) -> bool:
    if not bits:
        return False
    if len(bits) == 1:
        return bool(bits[0])
    return bool(bits[edge]) if edge < len(bits) else False


def _lane(tree: Node, value, size: int) -> np.ndarray:
    match tree.op:
        case "const":
            return np.full(size, tree.value == "1")
        case "symbol":
            return value(tree.value)
        case "not":
            return ~_lane(tree.parts[0], value, size)
    a, b = (_lane(p, value, size) for p in tree.parts)
    return {"and": a & b, "or": a | b, "xor": a ^ b}[tree.op]


#: Levels after which chains are halved, and rounds after which values are written anew as one table.
BEFORE_CHAINS, COMPACT = 12, 8


def _gate(a: Column, b: Column) -> Column:
    """Output of the column ``gate``, bit by bit."""
    both, either = a.bitwiseAND(b), a.bitwiseOR(b)
    return F.when(F.col("gate") == "and", both).when(F.col("gate") == "or", either).when(F.col("gate") == "xor", a.bitwiseXOR(b)).when(F.col("gate") == "nand", F.bitwise_not(both))


def _picked(value: Column, low: Column, high: Column) -> Column:
    """``high`` where ``value`` has a one, else ``low``."""
    return value.bitwiseAND(high).bitwiseOR(F.bitwise_not(value).bitwiseAND(low))


def _by_halved_chains(waiting: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` and the values of ``waiting``, whose gates may stand in long chains.

    A gate with one source left makes of it, bit by bit, one output at zero and one at one. In a round a gate that waits for
    such a gate waits for that one's source instead, through both; a chain is halved and a level of the others is done.
    """
    ones, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    sides = [c for s in "ab" for c in (F.when(~F.col(f"has_{s}"), F.col(s)).alias(s), *(F.when(F.col(f"has_{s}"), F.col(f"v{s}")).otherwise(x).alias(f"{s}{k}") for k, x in enumerate((zero, ones))))]
    state, rounds = waiting.select(F.col("dst").alias("node"), "gate", *sides), 0
    while True:
        single = state.where("a IS NULL OR b IS NULL OR a = b")
        single = single.select(F.col("node").alias("via"), F.coalesce("a", "b").alias("further"), *[_gate(F.col(f"a{k}"), F.col(f"b{k}")).alias(f"u{k}") for k in (0, 1)])
        single = single.unionByName(done.select(F.col("node").alias("via"), F.lit(None).cast(single.schema["further"].dataType).alias("further"), *[F.col("value").alias(f"u{k}") for k in (0, 1)]))
        moved = state
        for s in "ab":
            moved = moved.join(single, F.col(s) == F.col("via"), "left")
            through = {f"{s}{k}": F.when(F.col("via").isNull(), F.col(f"{s}{k}")).otherwise(_picked(F.col(f"u{k}"), F.col(f"{s}0"), F.col(f"{s}1"))) for k in (0, 1)}
            moved = moved.withColumns(through | {s: F.when(F.col("via").isNull(), F.col(s)).otherwise(F.col("further"))}).drop("via", "further", "u0", "u1")
        moved, more = cut_any(moved, "lanes", F.col("a").isNull() & F.col("b").isNull())
        if not more:
            return done
        done, state, rounds = done.unionByName(moved.where("a IS NULL AND b IS NULL").select("node", _gate(F.col("a0"), F.col("b0")).alias("value"))), moved.where("a IS NOT NULL OR b IS NOT NULL"), rounds + 1
        if rounds % COMPACT == 0:
            done = cut(done, "lanes")


def gate_lanes(nodes: DataFrame, arcs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(node, value) of a two-input gate graph, 64 vectors to a long.

    ``nodes`` (node, gate: and, or, xor, nand), ``arcs`` (dst, a, b), ``inputs`` (node, value). Level by level at first; what
    lies deeper than BEFORE_CHAINS levels goes by the logarithm of its chains. Gates on or behind a cycle get no value.
    """
    done = new = cut(inputs.select("node", "value"), "lanes")
    ends = [c for side in "ab" for c in (F.lit(None).cast("long").alias(f"v{side}"), F.lit(False).alias(f"has_{side}"))]
    waiting = arcs.join(nodes, F.col("dst") == F.col("node")).join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("dst", "a", "b", "gate", *ends)
    for _ in range(BEFORE_CHAINS):
        # Only the newest values are joined; a gate that waits keeps the one it has got.
        state = waiting
        for side in "ab":
            came = new.select(F.col("node").alias(side), F.col("value").alias("_v"), F.lit(True).alias("_has"))
            state = state.join(came, side, "left").withColumns({f"v{side}": F.coalesce(f"v{side}", "_v"), f"has_{side}": F.col(f"has_{side}") | F.coalesce("_has", F.lit(False))}).drop("_v", "_has")
        state, more = cut_any(state, "lanes", F.col("has_a") & F.col("has_b"))
        new, waiting = state.where("has_a AND has_b").select(F.col("dst").alias("node"), _gate(F.col("va"), F.col("vb")).alias("value")), state.where("NOT (has_a AND has_b)")
        if not more:
            return done
        done = done.unionByName(new)
    return _by_halved_chains(waiting, cut(done, "lanes"))


def covered_order(items: DataFrame) -> DataFrame:
    """(block, item, step): in every block, items in the order in which all that they need has come before.

    ``items`` (block, item, needs). One of those ready goes at a time, the one of fewest needs, then the smallest; items
    whose needs are never met are left out. A round of joins per step, all blocks at once.
    """
    rest = cut(items.select("block", "item", F.array_distinct("needs").alias("needs")), "order")
    done = cut(rest.where("false").select("block", "item", F.lit(0).alias("step")), "order")
    step = 0
    while True:
        covered = done.groupBy("block").agg(F.collect_set("item").alias("have"))
        ready = rest.join(done, ["block", "item"], "left_anti").join(covered, "block", "left").where(F.size(F.array_except("needs", F.coalesce("have", F.array().cast("array<bigint>")))) == 0)
        picked = cut(ready.groupBy("block").agg(F.min(F.struct(F.size("needs").alias("size"), "item")).alias("x")).select("block", F.col("x.item").alias("item"), F.lit(step).alias("step")), "order")
        if picked.isEmpty():
            return done
        done, step = cut(done.unionByName(picked), "order"), step + 1
