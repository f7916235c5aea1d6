import pytest
from pyspark.sql import functions as F

from netloom import report
from netloom.operators import graph, ordered, simulate
from netloom.operators.simulate import Circuit, EvaluationError
from netloom.plans import designs
from netloom.streaming import waveforms


def test_toy_trace(spark):
    runs = spark.createDataFrame([(0, [True, False, True, True], [True]), (1, [True], [True])], "run long, din array<boolean>, one array<boolean>")
    trace = designs.TOY.fold(runs, {"din": "din", "en": "one", "rst_n": "one", "clk": "one"}, ["success"]).orderBy("run", "edge").collect()
    states = [(r.FF0_dfrtp, r.FF1_dfrtp) for r in trace if r.run == 0]
    assert states == [(True, False), (False, True), (True, False), (True, True)]
    assert [r.success for r in trace if r.run == 0] == [False, False, True, False]


def test_errors(spark):
    rows = spark.createDataFrame([(True,)], "a boolean")
    loop = Circuit.of([("I_inv", "inv", "A", "x"), ("I_inv", "inv", "Y", "y"), ("J_inv", "inv", "A", "y"), ("J_inv", "inv", "Y", "x"), ("K_inv", "inv", "A", "a"), ("K_inv", "inv", "Y", "z"), ("L_and2", "and2", "A", "VPWR"), ("L_and2", "and2", "B", "a"), ("L_and2", "and2", "X", "w"), ("M_inv", "inv", "A", "a"), ("M_inv", "inv", "Y", "w2"), ("N_inv", "inv", "A", "a"), ("N_inv", "inv", "Y", "w2"), ("O_inv", "inv", "A", "nowhere"), ("O_inv", "inv", "Y", "o")])
    assert loop.evaluate(rows, ["z", "w", "VGND"]).first().asDict() == {"a": True, "z": False, "w": True, "VGND": False}
    for net, why in (("x", "cycle"), ("w2", "2 drivers"), ("o", "0 drivers")):
        with pytest.raises(EvaluationError, match=why):
            loop.evaluate(rows, [net])
    assert loop.evaluate(rows.withColumn("y", F.lit(True)), ["x"]).first().x is False  # a given net cuts the circuit
    with pytest.raises(Exception, match="no value for a"):
        loop.evaluate(spark.createDataFrame([(None,)], "a boolean"), ["z"]).collect()


def test_clear_beats_preset_beats_data(spark):
    flop = simulate.Cell("both", ("D", "CLK", "R", "S"), {"Q": "IQ"}, clock_pins=("CLK",), clocked_on="CLK", next_state="D", clear="R", preset="S")
    c = Circuit.of([("f", "both", p, n) for p, n in (("D", "d"), ("CLK", "clk"), ("R", "r"), ("S", "s"), ("Q", "q"))], {"both": flop})
    rows = spark.range(16).select(*[(F.getbit("id", F.lit(i)) == 1).alias(n) for i, n in enumerate("drsq")])
    for r in c.transition(rows, ["q"]).collect():
        assert r.next_f == (not r.r and (r.s or r.d)) and r.before_q == r.q and r.after_q == r.next_f


def test_influence_and_leaves(spark):
    assert designs.TOY.leaves("success") == ["q0", "q1"]
    row = designs.TOY.influences(spark, "q0", "success").first()
    assert (row.id, row.q1, row.low, row.high) == (1, True, True, False)
    assert designs.TOY.influences(spark, "din", "success").isEmpty()
    with pytest.raises(ValueError):
        designs.ADDER.influences(spark, "b7", "S", max_variables=3)


def test_toggling_keeps_repeated_states(spark):
    states = spark.createDataFrame([(True, False, True), (True, False, True)], "q0 boolean, q1 boolean, en boolean")
    rows = designs.TOY.toggling(states.withColumn("din", F.lit(True)).withColumn("rst_n", F.lit(True)).withColumn("clk", F.lit(True)), "din").collect()
    assert len(rows) == 2 and all(len(r.changed) == 1 for r in rows)


def test_graph_kernels(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r.node: r.component for r in graph.strongly_connected(nodes, arcs).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert {r.node: r.level for r in graph.levels(nodes, arcs).collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 0}
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 99)], "node long, parent long")
    assert {r.node: (r.root, r.dist) for r in graph.pointer_roots(parents).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (None, None), 6: (None, None), 7: (99, 1)}
    assert graph.connected_components(arcs.where("false").selectExpr("src AS u", "dst AS v")).count() == 0
    rows = spark.range(50).select(F.xxhash64("id").alias("x"))
    assert [r.number for r in ordered.numbered_all(rows, ["x"]).orderBy("x").collect()] == list(range(50))


def test_streams_equal_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(r, e, d, True, True, True) for r in (0, 1) for e, d in enumerate((True, False, True, True))]
    schema = "run long, edge long, din boolean, en boolean, rst_n boolean, clk boolean"
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = waveforms.simulate_stream(stream, designs.TOY, ["din", "en", "rst_n", "clk"], ["success"]).writeStream.format("memory").queryName("toy_stream").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {(r.run, r.edge): (r.success, r.FF0_dfrtp, r.FF1_dfrtp) for r in spark.table("toy_stream").collect()}
    assert [got[1, e] for e in range(4)] == [(False, True, False), (False, False, True), (True, True, False), (False, True, True)]


def test_reports(spark):
    board = spark.range(121).select(F.col("id").cast("int").alias("pos"), (F.col("id") % 11 < 5).cast("int").alias("region"), (F.col("id") % 30 == 0).alias("star"))
    lines = [r.line for r in report.dot_grid(board).collect()]
    assert lines[0] == "graph board {" and lines[-1] == "}" and sum(" -- " in x for x in lines) == 11 * 9 + 10 * 11
    with pytest.raises(ValueError):
        report.dot_grid(board.where("pos > 0"))
    html = report.bits_html(board.selectExpr("pos", "star AS bit"))
    assert html.count("<div") == 123 and "5 ones" in html
    assert report.table_html(board.limit(3).select("pos"), ["pos"], wrap=2).count("<table>") == 2
    registers = spark.createDataFrame([("shift_a", ["f0", "f1"], "a")], "name string, stages array<string>, serial_net string")
    dot = [r.line for r in report.dot_registers(registers).collect()]
    assert '  "a" -> "shift_a/0";' in dot and '  "shift_a/0" -> "shift_a/1";' in dot
