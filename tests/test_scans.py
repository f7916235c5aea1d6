"""Scans in two levels against windows, dumps read in splits, names by suffix, feedback without pairs."""

import random

from pyspark.sql import functions as F

from netloom.functions import names
from netloom.operators import motifs, ordered
from netloom.sources import vcd

BY = (["k"], ["at"])


def stream(spark, n=3000):
    """One hot key, some small ones and a null one; values and levels with nulls."""
    rng = random.Random(4)
    rows = [(None if k == 9 else k, at, rng.choice([None, rng.randrange(100)]), rng.choice([True, False, None])) for at in range(n) for k in [0 if rng.random() < 0.8 else rng.randrange(1, 10)]]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, at long, v int, level boolean").repartition(5)


def rows_of(frame, *columns):
    return sorted((tuple(map(str, r)) for r in frame.select("k", "at", *columns).collect()))


def test_scans_equal_windows(spark):
    rows = stream(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = ordered.in_ranges(rows, *BY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranges.groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2400  # the hot key lies in several ranges
    assert rows_of(ordered.held_over(ranges, *BY, ["v"]), "v_held") == rows_of(ordered.held(rows, *BY, ["v"]), "v_held")
    assert rows_of(ordered.previous_over(ranges, *BY, F.col("v")), "previous") == rows_of(ordered.predecessor(rows, *BY, "v"), "previous")
    level = F.coalesce("level", F.lit(False))
    for initial in (False, True):
        assert rows_of(ordered.rising_over(ranges, *BY, level, initial)) == rows_of(ordered.rising(rows, *BY, level, initial))
    want = rows.withColumn("total", F.coalesce(F.sum("v").over(ordered._so_far(*BY)), F.lit(0)))
    assert rows_of(ordered.sum_over(ranges, *BY, F.col("v")), "total") == rows_of(want, "total")
    none = ordered.in_ranges(rows.limit(0), *BY)
    assert ordered.held_over(none, *BY, ["v"]).count() == ordered.sum_over(none, *BY, F.col("v")).count() == 0


def test_scans_without_keys(spark):
    rows = stream(spark, 500).where("v IS NOT NULL")
    got = ordered.sum_over(ordered.in_ranges(rows, [], ["at"]), [], ["at"], F.lit(1)).orderBy("at").collect()
    assert [r.total for r in got] == list(range(1, len(got) + 1))


def dump(rng, edges):
    lines = ["$var wire 1 ! clk $end", "$var wire 1 % I $end", "$var wire 8 & bus $end", "$enddefinitions $end"]
    clk = bit = before = 0
    want = []
    for t in range(edges):
        lines.append(f"#{t}")
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.5:
                bit = rng.randrange(2)
                lines.append(f"{bit}%")
            elif rng.random() < 0.7:
                clk = rng.randrange(2)
                lines.append(f"{clk}!")
                if clk and not before:
                    want.append((len(lines) - 1, t, 1, bit))
                before = clk
            else:
                lines.append(rng.choice(["x%", "b0101 &", ""]))
    return lines, want


def test_dumps_are_read_in_splits(spark, tmp_path):
    rng = random.Random(5)
    for name, end in (("a", "\n"), ("b", "\r\n")):
        lines, want = dump(rng, 900)
        (tmp_path / f"{name}.vcd").write_bytes(end.join(lines).encode())
        if name == "a":
            kept = lines, want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        found = vcd.read_lines(spark, str(tmp_path)).cache()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = found.orderBy("dump", "line_no").collect()
        assert [r.text for r in rows if r.dump.endswith("a.vcd")] == kept[0]
        assert [r.line_no for r in rows if r.dump.endswith("b.vcd")] == list(range(len([r for r in rows if r.dump.endswith("b.vcd")])))
        edges = vcd.at_rising_edges(vcd.changes(found), ["clk", "I"]).where("dump LIKE '%a.vcd'").orderBy("line_no").collect()
        assert [(r.line_no, r.time, r.clk, r.I) for r in edges] == kept[1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_suffixes_of_many_types(spark):
    """More known names than a plan could hold as branches."""
    known = spark.range(200_000).select(F.concat(F.lit("cell_"), F.col("id").cast("string")).alias("k")).union(spark.createDataFrame([("a",), ("b_a",), ("b_a",)], "k string"))
    rows = spark.createDataFrame([("U1_cell_77_3",), ("cell_199999_1",), ("x_cell_200000_4",), ("x_b_a_12",), ("c_a",), (None,), ("_",), ("z",)], "n string")
    got = {r.n: r.inferred for r in names.infer_by_suffix(rows, "n", known).collect()}
    assert got == {"U1_cell_77_3": "cell_77", "cell_199999_1": "cell_199999", "x_cell_200000_4": "200000", "x_b_a_12": "b_a", "c_a": "a", None: "unknown", "_": "unknown", "z": "z"}


def test_feedback_needs_no_pairs(spark):
    rng = random.Random(7)
    lines = [(rng.randrange(12), rng.choice([1, 1, 1, 2, 3]), rng.randrange(12)) for _ in range(90)] + [(5, 8, 5), (6, 8, 5), (7, 9, 7)]
    pairs = {}
    for o, k, v in set(lines):
        for p, q, w in set(lines):
            if k == q and o != p and (v == w or o == w):
                pairs[o, k] = min(w, pairs.get((o, k), w))
    got = motifs.self_feedback(spark.createDataFrame(lines, "owner int, key int, value int"))
    assert {(r.owner, r.key): r.hold for r in got.collect()} == pairs
    hot = spark.range(100_000).select(F.col("id").alias("owner"), F.lit(1).alias("key"), (F.col("id") % 50_000 + 200_000).alias("value"))
    assert motifs.self_feedback(hot).count() == 100_000
