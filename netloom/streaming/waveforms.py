"""Streams of signal changes: hold, rising edges, and clocked simulation, with state kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.operators.simulate import Circuit, _lane

EDGES = "run string, seq long, time long, sample string"


class EdgeSampler(StatefulProcessor):
    """Last value of every signal of a run; a row at each 0 to 1 of the clock, with all signals as they stand."""

    def __init__(self, clock: str):
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        now = {k[0]: v[0] for k, v in self.values.iterator()}
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            before = now.get(r.name, 0)
            now[r.name] = int(r.value)
            self.values.updateValue((r.name,), (int(r.value),))
            if r.name == self.clock and before == 0 and r.value == 1:
                out.append((key[0], r.seq, r.time, ",".join(f"{n}={v}" for n, v in sorted(now.items()))))
        yield pd.DataFrame(out, columns=["run", "seq", "time", "sample"])

    def close(self) -> None:
        pass


def sample_edges(changes: DataFrame, clock: str = "clk") -> DataFrame:
    """(run, seq, time, sample) at rising edges of a stream of changes (run, seq, time, name, value).

    Rows of a run must come in order of seq across batches, as a dump is written; inside a batch they are sorted.
    """
    return changes.groupBy("run").transformWithStateInPandas(EdgeSampler(clock), EDGES, "Append", "None")


class ClockedCircuit(StatefulProcessor):
    """Flop values of a run; every row of inputs is one clock edge."""

    def __init__(self, circuit: Circuit, inputs: list[str], watch: list[str]):
        self.circuit, self.inputs, self.watch = circuit, inputs, watch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("flops", "flop string", "value boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import numpy as np

        flops = sorted(self.circuit.flops)
        held = {k[0]: v[0] for k, v in self.state.iterator()}
        now = {f: np.array([held.get(f, False)]) for f in flops}
        trees = {f: self.circuit.next_state(f) for f in flops}
        demand = sorted({n for t in trees.values() for n in t.symbols} | set(self.watch))
        out = []
        for r in pd.concat(list(rows)).sort_values("edge").to_dict("records"):
            given = {n: np.array([bool(r[n])]) for n in self.inputs} | {self.circuit.q_net(f): v for f, v in now.items()}
            lanes = self.circuit.lanes(given, demand)
            now = {f: _lane(trees[f], lanes.__getitem__, 1) for f in flops}
            out.append((key[0], r["edge"], *[bool(lanes[w][0]) for w in self.watch], *[bool(now[f][0]) for f in flops]))
        for f, v in now.items():
            self.state.updateValue((f,), (bool(v[0]),))
        yield pd.DataFrame(out, columns=["run", "edge", *self.watch, *flops])

    def close(self) -> None:
        pass


def simulate_stream(rows: DataFrame, circuit: Circuit, inputs: list[str], watch: list[str]) -> DataFrame:
    """(run, edge, <watched nets before the edge>, <flops after it>) of a stream (run, edge, <inputs>)."""
    schema = "run long, edge long, " + ", ".join(f"`{n}` boolean" for n in [*watch, *sorted(circuit.flops)])
    return rows.groupBy("run").transformWithStateInPandas(ClockedCircuit(circuit, inputs, watch), schema, "Append", "None")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, late ones dropped after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
