"""Clocking a circuit through reset, serial scans and replays, many runs at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.simulate import Circuit


@dataclass
class Player:
    """``circuit`` with a serial ``data`` net, an ``enable`` and an active-low ``reset``; ``held`` nets keep a value.

    Runs are rows (run, bits: array<boolean>); a null bit counts as 0, null ``bits`` as none.
    """

    circuit: Circuit
    data: str = "I"
    enable: str = "enable"
    reset: str = "rst_n"
    held: dict[str, bool] = field(default_factory=dict)

    def _fold(self, runs: DataFrame, watch: list[str], state: dict[str, bool]) -> DataFrame:
        return self.circuit.fold(runs, {self.data: "data", self.enable: "enable", self.reset: "reset"}, watch, state, self.held)

    def reset_state(self, spark: SparkSession, clocks: int = 3) -> dict[str, bool]:
        """Flops, false at first, after ``clocks`` edges in reset and one idle edge released. One row: the circuit's flops."""
        idle = [False] * (clocks + 1)
        run = spark.createDataFrame([(0, idle, idle, idle[1:] + [True])], "run long, data array<boolean>, enable array<boolean>, reset array<boolean>")
        last = self._fold(run, [], {}).where(F.col("edge") == clocks).first()
        return {f: last[f] for f in self.circuit.flops}

    def _scans(self, runs: DataFrame, length: Column, idle: int) -> DataFrame:
        """(run, length, data, enable, reset): ``length`` enabled edges, bits cut or filled with 0, then ``idle`` idle ones."""
        sized = runs.select("run", "bits", length.cast("int").alias("length"))
        edges = F.sequence(F.lit(0), F.col("length") + idle)
        on = F.slice(F.transform(edges, lambda t: t < F.col("length")), F.lit(1), F.col("length") + idle)
        data = F.slice(F.transform(edges, lambda t: (t < F.col("length")) & F.coalesce(F.get("bits", t), F.lit(False))), F.lit(1), F.col("length") + idle)
        return sized.select("run", "length", data.alias("data"), on.alias("enable"), F.transform(on, lambda _: F.lit(True)).alias("reset"))

    def scan(self, runs: DataFrame, clocks: int | None = None) -> DataFrame:
        """(run, <flops>) after reset and ``clocks`` enabled edges, by default one a bit."""
        flops, start = sorted(self.circuit.flops), self.reset_state(runs.sparkSession)
        length = F.lit(clocks) if clocks is not None else F.coalesce(F.size("bits"), F.lit(0))
        scans = self._scans(runs, F.greatest(length, F.lit(0)), 0)
        ends = self._fold(scans, [], start).groupBy("run").agg(F.max_by(F.struct(*[F.col(f"`{f}`") for f in flops]), "edge").alias("end"))
        kept = scans.select("run").join(ends, "run", "left")
        return kept.select("run", *[F.coalesce(F.col("end").getField(f), F.lit(start[f])).alias(f) for f in flops])

    def replay(self, runs: DataFrame, success: str, bus: list[str], trailing: int = 16) -> DataFrame:
        """(run, edge, byte, success) of the ``trailing`` idle edges that follow a scan: the nets of ``bus``, lowest bit
        first, and ``success``, as they stand after the edge."""
        length = F.greatest(F.coalesce(F.size("bits"), F.lit(0)), F.lit(0))
        scans = self._scans(runs, length, trailing + 1)
        watch = list(dict.fromkeys([success, *bus]))
        trace = self._fold(scans, watch, self.reset_state(runs.sparkSession)).join(scans.select("run", "length"), "run")
        # What stands after an idle edge is what stands before the next one: their inputs are the same.
        byte = sum((F.shiftleft(F.col(f"`{n}`").cast("int"), i) for i, n in enumerate(bus)), F.lit(0))
        return trace.where(F.col("edge") > F.col("length")).select("run", (F.col("edge") - F.col("length") - 1).alias("edge"), byte.alias("byte"), F.col(f"`{success}`").alias("success"))

    def data_hits(self, spark: SparkSession, groups: DataFrame, length: int = 121) -> DataFrame:
        """(group, position) at which a flop of ``groups`` (group, flop) would take another value if the data bit were 1,
        along a scan of zeros."""
        flops, start = sorted(self.circuit.flops), self.reset_state(spark)
        zeros = spark.createDataFrame([(0, [False] * length)], "run long, bits array<boolean>")
        after = self._fold(self._scans(zeros, F.lit(length), 0), [], start).where(F.col("edge") < length - 1)
        first = spark.createDataFrame([(0, *[start[f] for f in flops])], "position int" + "".join(f", `{f}` boolean" for f in flops)).where(F.lit(length > 0))
        states = after.select((F.col("edge") + 1).alias("position"), *[F.col(f"`{f}`") for f in flops]).unionByName(first)
        pins = {self.enable: True, self.reset: True, **self.held}
        given = states.select("position", *[F.col(f"`{f}`").alias(self.circuit.q_net(f)) for f in flops], *[F.lit(v).alias(n) for n, v in pins.items()], F.lit(False).alias(self.data))
        changed = self.circuit.toggling(given, self.data).select("position", F.explode("changed").alias("flop"))
        return changed.join(groups, "flop").select("group", "position").distinct()
