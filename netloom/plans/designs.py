"""Two small circuits, made by rule: a two-stage enabled shift register and an adder over two shift registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.functions.cells import BASIC_CELLS, Cell
from netloom.operators.simulate import Circuit

#: The adder's own cell, beside the basic ones.
CELLS = BASIC_CELLS | {"maj3": Cell("maj3", ("A", "B", "C"), {"X": "(A&B)|(A&C)|(B&C)"})}
PINS = "instance string, cell_type string, pin string, net string"


def _instance(name: str, cell: str, **pins: str) -> list[tuple[str, str, str, str]]:
    return [(f"{name}_{cell}", cell, pin, net) for pin, net in pins.items()]


def stage(k: int, data: str, q: str, enable: str = "en", clock: str = "clk", reset: str = "rst_n", tag: str = "") -> list:
    """A flop behind a mux that holds its value while ``enable`` is low."""
    return _instance(f"M{tag}{k}", "mux2", A0=q, A1=data, S=enable, X=f"d{tag}{k}") + _instance(f"FF{tag}{k}", "dfrtp", D=f"d{tag}{k}", CLK=clock, RESET_B=reset, Q=q)


def toy() -> list[tuple[str, str, str, str]]:
    """din -> q0 -> q1; success = q1 & !q0."""
    pins = stage(0, "din", "q0") + stage(1, "q0", "q1")
    return pins + _instance("INV0", "inv", A="q0", Y="nq0") + _instance("AND0", "and2", A="q1", B="nq0", X="success")


def adder(bits: int = 8) -> list[tuple[str, str, str, str]]:
    """Registers a and b shift in from A and B; S is high where a + b is all ones over the lower half of zeros."""
    pins = []
    for r in "ab":
        for k in range(bits):
            pins += stage(k, r.upper() if k == 0 else f"{r}{k - 1}", f"{r}{k}", tag=r)
    carry = None
    for k in range(bits):
        pins += _instance(f"X{k}", "xor2", A=f"a{k}", B=f"b{k}", X=f"x{k}" if carry else f"s{k}")
        if carry:
            pins += _instance(f"S{k}", "xor2", A=f"x{k}", B=carry, X=f"s{k}") + _instance(f"C{k}", "maj3", A=f"a{k}", B=f"b{k}", C=carry, X=f"c{k}")
        else:
            pins += _instance(f"C{k}", "and2", A=f"a{k}", B=f"b{k}", X=f"c{k}")
        carry = f"c{k}"
    half = bits // 2
    low = _tree("nor2", "or2", [f"s{k}" for k in range(half)], "low", pins)
    high = _tree("and2", "and2", [f"s{k}" for k in range(half, bits)] + [carry], "high", pins)
    return pins + _instance("OUT", "and2", A=low, B=high, X="S")


def _tree(last: str, inner: str, nets: list[str], name: str, pins: list) -> str:
    """Fold ``nets`` by two-input gates; the last one is ``last``."""
    at = nets[0]
    for i, net in enumerate(nets[1:]):
        final = i == len(nets) - 2
        out = name if final else f"{name}{i}"
        cell = last if final else inner
        pins += _instance(f"T{name}{i}", cell, A=at, B=net, **{"Y" if cell[0] == "n" else "X": out})
        at = out
    return at


def frame(spark: SparkSession, pins: list) -> DataFrame:
    return spark.createDataFrame(pins, PINS)


TOY, ADDER = Circuit.of(toy()), Circuit.of(adder(), CELLS)
