"""Component queries over all part-supplier edges, against union-find."""

import pyarrow.parquet as pq

from netloom import catalog

SF = "/root/testdata/sf0.001"


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        u, v = top(u), top(v)
        up[max(u, v)] = min(u, v)
    return {x: top(x) for x in up}


def check(spark, sf, edges):
    want = union_find(edges)
    got = catalog.queries()["connected_components"](spark, sf).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(want.items())
    sets = {}
    for node, root in want.items():
        sets.setdefault(root, []).append(node)
    order = sorted(sets, key=lambda root: sorted(f"{n:010d}" for n in sets[root]))
    ids = catalog.queries()["canonical_ids"](spark, sf).collect()
    assert sorted((r.id, r.node, r.n) for r in ids) == sorted((f"n{i:04d}", n, len(sets[root])) for i, root in enumerate(order) for n in sets[root])
    return len(sets)


def test_every_edge_counts(spark):
    t = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_partkey", "l_suppkey"]).to_pydict()
    assert check(spark, SF, [(2 * p, 2 * s + 1) for p, s in zip(t["l_partkey"], t["l_suppkey"])]) >= 1


def test_several_components_and_a_hot_part(spark, tmp_path):
    rows = [(1, s) for s in range(40)] + [(p, 50 + p % 3) for p in range(60, 90)] + [(200, 300)]
    lines = spark.createDataFrame([(p, s, 1.0, 0.0) for p, s in rows], "l_partkey long, l_suppkey long, l_quantity double, l_discount double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert check(spark, str(tmp_path), [(2 * p, 2 * s + 1) for p, s in rows]) == 5
