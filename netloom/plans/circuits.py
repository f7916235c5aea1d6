"""Expression, evaluation and simulation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import bits
from netloom.functions.cells import BASIC_CELLS
from netloom.functions.logic import compiled, parse
from netloom.operators import simulate
from netloom.plans.designs import ADDER, TOY
from netloom.plans.graphs import INPUTS
from netloom.queries import load, query

_STATES = " CROSS JOIN ".join(f"(SELECT range AS {r} FROM range(256))" for r in "ab")


@query("exhaustive_states", f"SELECT a, b, a + b AS total FROM {_STATES} WHERE a + b = 496")
def exhaustive_states(spark, sf_dir):
    """Which of the 65,536 register states raise the adder's output."""
    states = spark.range(1 << 16).select("id", *[(F.getbit("id", F.lit(8 * r + k)) == 1).alias(f"{n}{k}") for r, n in enumerate("ab") for k in range(8)])
    a, b = F.col("id") % 256, F.expr("id div 256")
    return ADDER.evaluate(states, ["S"]).where("S").select(a.alias("a"), b.alias("b"), (a + b).alias("total"))


def _combinational():
    return [(c, pin, text) for _, c in sorted(BASIC_CELLS.items()) if not c.sequential for pin, text in c.outputs.items()]


_WIDEST = max(len(c.inputs) for c, _, _ in _combinational())
#: Each part is an instance of a cell whose inputs are bits of a number of its own.
_PLACED = f"SELECT p_partkey, p_partkey % {len(_combinational())} AS kind, (p_partkey * 37 + p_size * 11 + p_partkey // {len(_combinational())}) % {1 << _WIDEST} AS bits FROM part"


def _truth_sql() -> str:
    names, values = [], []
    for k, (c, pin, text) in enumerate(_combinational()):
        names.append(f"WHEN {k} THEN '{c.cell_type}.{pin}'")
        values.append(f"WHEN {k} THEN {parse(text).sql(lambda s, i=c.inputs: f'((bits >> {i.index(s)}) & 1 = 1)')}")
    return f"SELECT p_partkey, CASE kind {' '.join(names)} END AS output, bits, CASE kind {' '.join(values)} END AS value FROM ({_PLACED})"


@query("truth_table", _truth_sql())
def truth_table(spark, sf_dir):
    """Every combinational cell over inputs of its instances, in one projection."""
    cells, k = _combinational(), F.col("p_partkey")
    bits = ((k * 37 + F.col("p_size") * 11 + F.floor(k / len(cells))) % (1 << _WIDEST)).cast("long")
    rows = load(spark, sf_dir, "part").select("p_partkey", (k % len(cells)).alias("kind"), bits.alias("bits"))
    rows = rows.withColumns({f"bit{i}": F.getbit("bits", F.lit(i)) == 1 for i in range(_WIDEST)})
    output = value = F
    for n, (c, pin, text) in enumerate(cells):
        here = F.col("kind") == n
        output = output.when(here, f"{c.cell_type}.{pin}")
        value = value.when(here, compiled(text, lambda s, i=c.inputs: F.col(f"bit{i.index(s)}")))
    return rows.select("p_partkey", output.alias("output"), "bits", value.alias("value"))


EXPRESSIONS = {"e1": "hi & !err | odd", "e2": "hi ^ odd + err", "e3": "!(hi * err) ^ 1", "e4": "(hi | err) & (odd | 0)"}
_FLAGS = "SELECT event_id, value > 20 AS hi, event_type = 'error' AS err, event_id % 2 = 1 AS odd FROM events"


@query("bool_kit", f"SELECT event_id, (hi AND NOT err) OR odd AS e1, (hi <> odd) OR err AS e2, hi AND err AS e3, (hi OR err) AND odd AS e4 FROM ({_FLAGS})")
def bool_kit(spark, sf_dir):
    flags = load(spark, sf_dir, "events").select("event_id", (F.col("value") > 20).alias("hi"), (F.col("event_type") == "error").alias("err"), (F.col("event_id") % 2 == 1).alias("odd"))
    return flags.select("event_id", *[compiled(t).alias(k) for k, t in EXPRESSIONS.items()])


# The part graph as gates: kind by p_size % 4, sixteen vectors in a long; the upper eight have input 0 flipped.
LANES = 16
_SEED = "((p_partkey * 37 + 11) & 255)"


def _input_value():
    low = (F.col("p_partkey") * 37 + 11).bitwiseAND(F.lit(255))
    flip = F.when(F.col("p_partkey") == 0, low.bitwiseXOR(F.lit(255))).otherwise(low)
    return (low + flip * 256).alias("value")


def _gate_values(spark, sf_dir) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("and", "or", "xor", "nand"))), (F.col("p_size") % 4 + 1).cast("int"))
    nodes = parts.select(F.col("p_partkey").alias("node"), kind.alias("gate"))
    arcs = parts.where(F.col("p_partkey") >= INPUTS).select(F.col("p_partkey").alias("dst"), F.expr("(p_partkey - 1) div 2").alias("a"), F.expr("(p_partkey - 1) div 3").alias("b"))
    inputs = parts.where(F.col("p_partkey") < INPUTS).select(F.col("p_partkey").alias("node"), _input_value())
    values = simulate.gate_lanes(nodes, arcs, inputs)
    return values.withColumn("value", F.col("value").bitwiseAND(F.lit((1 << LANES) - 1)))


def _gate_sql(depth: int = 14) -> str:
    steps = [f"v0 AS (SELECT p_partkey AS node, {_SEED} + 256 * (CASE WHEN p_partkey = 0 THEN xor({_SEED}, 255) ELSE {_SEED} END) AS value FROM part WHERE p_partkey < {INPUTS})"]
    for i in range(depth):
        steps.append(
            f"v{i + 1} AS MATERIALIZED (SELECT node, value FROM v{i} UNION ALL SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN x.value & y.value WHEN 1 THEN x.value | y.value WHEN 2 THEN xor(x.value, y.value) ELSE 65535 - (x.value & y.value) END "
            f"FROM part JOIN v{i} x ON x.node = (p_partkey - 1) // 2 JOIN v{i} y ON y.node = (p_partkey - 1) // 3 WHERE p_partkey >= {INPUTS} AND p_partkey NOT IN (SELECT node FROM v{i}))"
        )
    return f"WITH {', '.join(steps)}, gates AS (SELECT node, CAST(value AS BIGINT) AS value FROM v{depth})"


@query("gate_eval", f"{_gate_sql()} SELECT node, value FROM gates")
def gate_eval(spark, sf_dir):
    return _gate_values(spark, sf_dir)


@query("counterfactual", f"{_gate_sql()} SELECT node, CAST(xor(value & 255, value >> 8) AS BIGINT) AS changed FROM gates WHERE value & 255 <> value >> 8")
def counterfactual(spark, sf_dir):
    """Nodes that flipping input 0 changes, and in which vectors."""
    low, high = F.col("value").bitwiseAND(F.lit(255)), F.shiftrightunsigned("value", 8)
    return _gate_values(spark, sf_dir).select("node", low.bitwiseXOR(high).alias("changed")).where("changed <> 0")


_VARIABLES = [f"a{k}" for k in range(8)] + [f"b{k}" for k in range(7)]


def _witness_sql() -> str:
    def total(r):
        return " + ".join(f"(((id >> {len(_VARIABLES) - 1 - i}) & 1) << {int(v[1:])})" for i, v in enumerate(_VARIABLES) if v[0] == r)

    return f"SELECT min(id) AS id, arg_min(a + b = 496, id) AS low, arg_min(a + b + 128 = 496, id) AS high FROM (SELECT range AS id FROM range({1 << len(_VARIABLES)})) , LATERAL (SELECT {total('a')} AS a, {total('b')} AS b) WHERE (a + b = 496) <> (a + b + 128 = 496)"


@query("influence_witness", _witness_sql())
def influence_witness(spark, sf_dir):
    """The first assignment in which toggling b7 changes the adder's output."""
    return ADDER.influences(spark, "b7", "S").select("id", "low", "high")


@query("toy_trace", """WITH RECURSIVE bits(edge, din) AS (VALUES (0, true), (1, false), (2, true), (3, true)),
w AS (SELECT -1 AS edge, false AS success, false AS q0, false AS q1 UNION ALL SELECT bits.edge, q1 AND NOT q0, bits.din, q0 FROM w JOIN bits ON bits.edge = w.edge + 1)
SELECT CAST(edge AS INTEGER) AS edge, success, q0, q1 FROM w WHERE edge >= 0""")
def toy_trace(spark, sf_dir):
    runs = spark.createDataFrame([(0, [True, False, True, True], [True])], "run long, din array<boolean>, one array<boolean>")
    trace = TOY.fold(runs, {"din": "din", "en": "one", "rst_n": "one", "clk": "one"}, ["success"])
    return trace.select("edge", "success", F.col("FF0_dfrtp").alias("q0"), F.col("FF1_dfrtp").alias("q1"))


#: Reset for three edges, one idle edge, the scanned bits, and trailing edges with enable low.
RESET, TRAILING, SCAN = 3, 3, 4


@query("reset_scan_replay", f"""WITH RECURSIVE e AS (SELECT run, edge, edge >= {RESET} AS rst, edge BETWEEN {RESET + 1} AND {RESET + SCAN} AS en,
  edge BETWEEN {RESET + 1} AND {RESET + SCAN} AND (run >> (edge - {RESET + 1})) & 1 = 1 AS din FROM (SELECT range AS run FROM range({1 << SCAN})), (SELECT CAST(range AS INTEGER) AS edge FROM range({RESET + 1 + SCAN + TRAILING}))),
w AS (SELECT range AS run, -1 AS edge, false AS success, false AS q0, false AS q1 FROM range({1 << SCAN}) UNION ALL
  SELECT e.run, e.edge, q1 AND NOT q0, rst AND (CASE WHEN en THEN din ELSE q0 END), rst AND (CASE WHEN en THEN q0 ELSE q1 END) FROM w JOIN e ON e.run = w.run AND e.edge = w.edge + 1)
SELECT run, CAST(edge AS INTEGER) AS edge, success, q0, q1 FROM w WHERE edge >= {RESET + 1}""")
def reset_scan_replay(spark, sf_dir):
    """Every four-bit scan of the toy, after reset, with trailing edges."""
    total = RESET + 1 + SCAN + TRAILING

    def wave(high):
        return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), high)

    scan = wave(lambda t: F.when(t.between(RESET + 1, RESET + SCAN), F.getbit("run", t - (RESET + 1)) == 1).otherwise(False))
    runs = spark.range(1 << SCAN).withColumnRenamed("id", "run").select("run", scan.alias("din"), wave(lambda t: t.between(RESET + 1, RESET + SCAN)).alias("en"), wave(lambda t: t >= RESET).alias("rst"), F.array(F.lit(True)).alias("one"))
    trace = TOY.fold(runs, {"din": "din", "en": "en", "rst_n": "rst", "clk": "one"}, ["success"]).where(F.col("edge") > RESET)
    return trace.select("run", "edge", "success", F.col("FF0_dfrtp").alias("q0"), F.col("FF1_dfrtp").alias("q1"))


@query("toggle_hits", "SELECT a.range = 1 AS q0, b.range = 1 AS q1, e.range = 1 AS en, CASE WHEN e.range = 1 THEN 'FF0_dfrtp' ELSE '' END AS changed FROM range(2) a, range(2) b, range(2) e")
def toggle_hits(spark, sf_dir):
    """Which flops of the toy notice its data input, in every state."""
    states = spark.range(8).select(*[(F.getbit("id", F.lit(i)) == 1).alias(n) for i, n in enumerate(("q0", "q1", "en"))], F.lit(True).alias("rst_n"), F.lit(True).alias("clk"), F.lit(False).alias("din"))
    return TOY.toggling(states, "din").select("q0", "q1", "en", F.array_join("changed", ",").alias("changed"))


@query("one_transition", """SELECT q0, q1, din, en, rst_n, q1 AND NOT q0 AS before, n1 AND NOT n0 AS after, n0, n1 FROM (SELECT *, rst_n AND (CASE WHEN en THEN din ELSE q0 END) AS n0, rst_n AND (CASE WHEN en THEN q0 ELSE q1 END) AS n1
  FROM (SELECT range & 1 = 1 AS q0, range & 2 = 2 AS q1, range & 4 = 4 AS din, range & 8 = 8 AS en, range & 16 = 16 AS rst_n FROM range(32)))""")
def one_transition(spark, sf_dir):
    names = ("q0", "q1", "din", "en", "rst_n")
    rows = spark.range(32).select(*[(F.getbit("id", F.lit(i)) == 1).alias(n) for i, n in enumerate(names)], F.lit(True).alias("clk"))
    out = TOY.transition(rows, ["success"])
    return out.select(*names, F.col("before_success").alias("before"), F.col("after_success").alias("after"), F.col("next_FF0_dfrtp").alias("n0"), F.col("next_FF1_dfrtp").alias("n1"))


@query("bit_literals", """SELECT * FROM (VALUES ('din', '101', 3, '00100000000'), ('en', '1', 1, '01000000001'), ('rst_n', '0011', 4, '00000000000')) AS t(name, bits, n, hot)""")
def bit_literals(spark, sf_dir):
    rows = spark.createDataFrame([("din=1,0,1", [2]), ("en=1", [1, 10]), ("rst_n=0,0,1,1", [])], "text string, places array<int>")
    parsed = rows.select(bits.stimulus(F.col("text")).alias("s"), bits.bits_at(F.col("places"), 11).alias("hot"))
    shown = F.array_join(F.transform("s.bits", lambda b: F.when(b, "1").otherwise("0")), "")
    return parsed.select(F.col("s.name").alias("name"), shown.alias("bits"), F.size("s.bits").alias("n"), "hot")


@query("closure_order", """WITH RECURSIVE deps AS (SELECT s_suppkey AS item, s_suppkey % 10 AS place, s_suppkey // 10 AS block FROM supplier),
w AS (SELECT block, item, 0 AS step FROM deps WHERE place = 0 UNION ALL SELECT d.block, d.item, step + 1 FROM w JOIN deps d ON d.block = w.block AND d.place = step + 1) SELECT block, item, step FROM w""")
def closure_order(spark, sf_dir):
    """Suppliers of a block, each depending on all before it, in the order in which their needs are covered."""
    deps = load(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 10").alias("block"), F.col("s_suppkey").alias("item"), F.expr("CASE WHEN s_suppkey % 10 = 0 THEN array() ELSE sequence(s_suppkey div 10 * 10, s_suppkey - 1) END").cast("array<bigint>").alias("needs"))
    return simulate.covered_order(deps)
