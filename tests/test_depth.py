"""Deep graphs: rounds by the logarithm of chains, values by brute force."""

import random

import pytest

from netloom.operators import graph, simulate

MASK = (1 << 64) - 1
OPS = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "nand": lambda a, b: ~(a & b) & MASK}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture
def rounds(monkeypatch):
    seen = []
    write = simulate.cut_any
    monkeypatch.setattr(simulate, "cut_any", lambda *a: seen.append(1) or write(*a))
    return seen


def evaluated(spark, gates, inputs):
    nodes = spark.createDataFrame([(n, g) for n, g, _, _ in gates], "node long, gate string")
    arcs = spark.createDataFrame([(n, a, b) for n, _, a, b in gates], "dst long, a long, b long")
    given = spark.createDataFrame([(n, signed(v)) for n, v in inputs.items()], "node long, value long")
    return {r.node: r.value & MASK for r in simulate.gate_lanes(nodes, arcs, given).collect()}


def by_hand(gates, inputs):
    values = dict(inputs)
    for n, g, a, b in gates:
        values[n] = OPS[g](values[a], values[b])
    return values


def test_a_long_chain_takes_few_rounds(spark, rounds):
    rng = random.Random(1)
    inputs = {i: rng.getrandbits(64) for i in range(4)}
    gates = [(n, rng.choice(["xor", "nand", "or", "and"]), n - 1, rng.choice([n - 1, 0, 1, 2])) for n in range(4, 10_004)]
    assert evaluated(spark, gates, inputs) == by_hand(gates, inputs)
    assert len(rounds) < 30


def test_deep_graphs_and_cycles(spark, rounds, monkeypatch):
    monkeypatch.setattr(simulate, "BEFORE_CHAINS", 2)
    rng = random.Random(2)
    inputs = {i: rng.getrandbits(64) for i in range(5)}
    gates = [(n, rng.choice(list(OPS)), rng.randrange(max(0, n - 6), n), rng.randrange(max(0, n - 12), n)) for n in range(5, 300)]
    loose = [(1000, "and", 1001, 1001), (1001, "or", 1000, 1000), (1002, "xor", 1001, 3), (1003, "and", 77777, 1)]
    assert evaluated(spark, gates + loose, inputs) == by_hand(gates, inputs)


def test_long_tails_take_few_rounds(spark, monkeypatch):
    """Rings with tails of hundreds of nodes before and behind them, a loop of one, branches and lone nodes."""
    made = []
    write = graph.cut
    monkeypatch.setattr(graph, "cut", lambda *a: made.append(1) or write(*a))
    arcs = [(i, i + 1) for i in range(400)] + [(400, 398)] + [(400, 500)] + [(i, i + 1) for i in range(500, 900)] + [(7, 500), (950, 950), (951, 952), (960, 961), (961, 960), (960, 961)]
    rows = spark.createDataFrame(arcs, "src long, dst long")
    nodes = sorted({x for a in arcs for x in a} | {999})
    got = {r.node: r.component for r in graph.strongly_connected(spark.createDataFrame([(n,) for n in nodes], "node long"), rows).collect()}
    assert got == {n: 400 if 398 <= n <= 400 else 961 if n in (960, 961) else n for n in nodes}
    assert len(made) < 110
