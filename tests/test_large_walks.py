"""Walks over large tables send none of them to every task, and reach what they reach over small ones."""

import random

from netloom.operators import graph


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    arcs = spark.createDataFrame([(i, rng.randrange(max(0, i - 9), i)) for i in range(1, 150) for _ in range(2)], "src long, dst long").repartition(2)
    starts = spark.createDataFrame([(i, i) for i in range(1, 150, 10)], "root long, node long")
    through = spark.createDataFrame([(i,) for i in range(150) if i % 7], "node long")
    plans, write = [], graph.cut_told

    def watched(df, what, **told):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, what, **told)

    monkeypatch.setattr(graph, "cut_told", watched)
    want = None
    for few, sent in ((1 << 17, None), (0, False)):
        monkeypatch.setattr(graph, "FEW", few)
        plans.clear()
        got = sorted((r.root, r.node, r.hop) for r in graph.reach(arcs, starts, 4, through=through).collect())
        want = want or got
        assert got == want and len(got) > 60
        assert sent is not False or not any("BroadcastExchange" in p for p in plans)
