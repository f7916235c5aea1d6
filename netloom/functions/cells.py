"""Cell behaviour: what a cell's pins do and compute."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POWER_VALUES = {"VPWR": True, "VPB": True, "VDD": True, "VGND": False, "VNB": False, "VSS": False}
POWER_PINS = tuple(POWER_VALUES)
#: Fixed names: what the library's cells begin with, its cells that hold no logic, and vias.
LIBRARY = "sky130_fd_sc_hd__"
FILLERS = ("decap", "tap", "fill", "diode")
VIAS = ("VIA_", "via")
OUTPUT_NAMES = ("Q", "Q_N", "X", "Y", "Z")

CELL_SCHEMA = (
    "cell_type string, inputs array<string>, outputs array<string>, output_functions map<string,string>, clock_pins array<string>, "
    "reset_pins array<string>, set_pins array<string>, sequential boolean, clocked_on string, next_state string, clear string, preset string"
)


def component_kind(cell: Column) -> Column:
    """via, filler, logic or other, by the name of a placed cell."""

    def begins(*names):
        return cell.rlike("^(" + "|".join(names) + ")")

    return F.when(begins(*VIAS), "via").when(begins(*[LIBRARY + f for f in FILLERS]), "filler").when(begins(LIBRARY), "logic").otherwise("other")


@dataclass(frozen=True)
class Cell:
    """One row of the cell dimension."""

    cell_type: str
    inputs: tuple[str, ...]
    outputs: dict[str, str] = field(default_factory=dict)
    clock_pins: tuple[str, ...] = ()
    reset_pins: tuple[str, ...] = ()
    set_pins: tuple[str, ...] = ()
    clocked_on: str | None = None
    next_state: str | None = None
    clear: str | None = None
    preset: str | None = None

    @property
    def sequential(self) -> bool:
        return self.next_state is not None

    def row(self) -> tuple:
        return (
            self.cell_type, list(self.inputs), list(self.outputs), dict(self.outputs), list(self.clock_pins), list(self.reset_pins), list(self.set_pins),
            self.sequential, self.clocked_on, self.next_state, self.clear, self.preset,
        )


#: Gates whose inputs come in groups, by name.
GROUPED = (
    "a2111oi a211o a211oi a21bo a21boi a21o a21oi a221o a221oi a22o a22oi a311o a31o a31oi a32o a41oi "
    "o211a o211ai o21a o21ai o21ba o21bai o221a o22a o22ai o2bb2a o311a o31a o31ai o32a o32ai"
).split()
#: Gates with some inverted inputs, by name, and those inputs.
INVERTED = {
    "and2b": "A", "and3b": "A", "and4b": "A", "and4bb": "AB", "nand2b": "A", "nand3b": "A",
    "nor3b": "C", "nor4b": "D", "or3b": "C", "or4b": "D", "or4bb": "CD",
}


def grouped_gate(name: str) -> Cell:
    """A gate by its name: a (and) or o (or) of groups of inputs of the given sizes, b for inverted inputs, joined by the
    other of the two (o or a), inverted if an i follows."""
    first, sizes, bars, _, invert = re.fullmatch(r"([ao])(\d(?:bb)?\d*)(b?)([ao])(i?)", name).groups()
    inner, outer = ("&", "|") if first == "a" else ("|", "&")
    groups, pins = [], []
    for letter, (size, barred) in zip("ABCD", re.findall(r"(\d)(b*)", sizes), strict=False):
        own = [f"{letter}{i + 1}" + ("_N" if barred else "") for i in range(int(size))]
        groups.append(own)
        pins += own
    if bars:
        groups[-1] = [groups[-1][0] + "_N"]
        pins[-1] += "_N"
    text = outer.join("(" + inner.join("!" + p if p.endswith("_N") else p for p in g) + ")" for g in groups)
    return Cell(name, tuple(pins), {"Y": f"!({text})"} if invert else {"X": text})


def inverted_gate(name: str, barred: str) -> Cell:
    kind, n = re.match(r"(n?)(?:and|or)(\d)", name).groups()
    pins = tuple(p + "_N" if p in barred else p for p in "ABCD"[: int(n)])
    text = ("&" if "and" in name else "|").join("!" + p if p.endswith("_N") else p for p in pins)
    return Cell(name, pins, {"Y": f"!({text})"} if kind else {"X": text})


def _gates() -> list[Cell]:
    """The 64 cell types, plain gates by rule: n-input and, or and their complements, and those that the names spell out."""
    made = [Cell("inv", ("A",), {"Y": "!A"}), Cell("buf", ("A",), {"X": "A"}), Cell("clkbuf", ("A",), {"X": "A"}), Cell("conb", (), {"HI": "1", "LO": "0"})]
    for n in (2, 3, 4):
        pins = tuple("ABCD"[:n])
        both, any_ = "&".join(pins), "|".join(pins)
        made += [Cell(f"and{n}", pins, {"X": both}), Cell(f"or{n}", pins, {"X": any_}), Cell(f"nand{n}", pins, {"Y": f"!({both})"}), Cell(f"nor{n}", pins, {"Y": f"!({any_})"})]
    made += [Cell("xor2", ("A", "B"), {"X": "A^B"}), Cell("xnor2", ("A", "B"), {"Y": "!(A^B)"}), Cell("mux2", ("A0", "A1", "S"), {"X": "(A0&!S)|(A1&S)"})]
    made += [*map(grouped_gate, GROUPED), *(inverted_gate(name, barred) for name, barred in INVERTED.items())]
    flop = dict(outputs={"Q": "IQ"}, clock_pins=("CLK",), clocked_on="CLK", next_state="D")
    made += [Cell("dfxtp", ("D", "CLK"), **flop), Cell("dfrtp", ("D", "CLK", "RESET_B"), reset_pins=("RESET_B",), clear="!RESET_B", **flop), Cell("dfstp", ("D", "CLK", "SET_B"), set_pins=("SET_B",), preset="!SET_B", **flop)]
    return made


BASIC_CELLS: dict[str, Cell] = {c.cell_type: c for c in _gates()}


def cell_frame(spark: SparkSession, cells: dict[str, Cell] = BASIC_CELLS) -> DataFrame:
    return spark.createDataFrame([c.row() for c in cells.values()], CELL_SCHEMA)


def collect_cells(cells: DataFrame, limit: int = 10_000) -> dict[str, Cell]:
    """The dimension on the driver; refused beyond ``limit`` cells."""
    rows = cells.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} cell types")
    return {
        r.cell_type: Cell(r.cell_type, tuple(r.inputs), dict(r.output_functions), tuple(r.clock_pins), tuple(r.reset_pins), tuple(r.set_pins), r.clocked_on, r.next_state, r.clear, r.preset)
        for r in rows
    }
