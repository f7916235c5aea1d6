import itertools

import pytest
from pyspark.sql import functions as F

from netloom.functions import bits, names
from netloom.functions.cells import BASIC_CELLS
from netloom.functions.logic import LogicExpressionError, compiled, parse


@pytest.mark.parametrize("text", ["", "A ", "A&", "(A", "A)", "A B", "A'", "A$B", "&A"])
def test_no_expression(text):
    with pytest.raises(LogicExpressionError):
        parse(text)


def test_precedence_and_constants():
    for a, b, c in itertools.product((False, True), repeat=3):
        v = {"A": a, "B": b, "C": c}
        assert parse("A|B&C").evaluate(v) == (a or (b and c))
        assert parse("A ^ B | C").evaluate(v) == ((a != b) or c)
        assert parse("!A*B+C").evaluate(v) == ((not a and b) or c)
        assert parse("!(A^B^C)&1|0").evaluate(v) == (not ((a != b) != c))
    assert parse("A&(B|A)").symbols == {"A", "B"}
    with pytest.raises(KeyError):
        parse("1|A").evaluate({})


def test_columns_equal_trees(spark):
    for cell in BASIC_CELLS.values():
        if cell.sequential or not cell.inputs:
            continue
        rows = spark.range(1 << len(cell.inputs)).withColumns({s: F.getbit("id", F.lit(i)) == 1 for i, s in enumerate(cell.inputs)})
        for text in cell.outputs.values():
            for r in rows.withColumn("v", compiled(text)).collect():
                assert r.v == parse(text).evaluate(r.asDict())


def test_null_input_raises(spark):
    rows = spark.createDataFrame([(None, True)], "A boolean, B boolean")
    with pytest.raises(Exception, match="no value for A"):
        rows.select(compiled("A|B")).collect()


def test_bits(spark):
    row = spark.range(1).select(
        bits.as_bits(F.lit("0110x")).alias("b"), bits.as_bits(F.lit("")).alias("e"), bits.bits_at(F.array(F.lit(1), F.lit(3)), 5).alias("h"), bits.text_until_nul(F.array(*[F.lit(x).cast("long") for x in (72, 105, 0, 65)])).alias("t")
    ).first()
    assert row.b == [False, True, True, False, False] and row.e == [] and row.h == "01010" and row.t == "Hi"
    with pytest.raises(Exception, match="not NAME"):
        spark.range(1).select(bits.stimulus(F.lit("din=0,2"))).collect()


def test_names(spark):
    rows = spark.createDataFrame([("n10",), ("n9",), ("n9a",), ("a2b10",), ("a2b9",)], "n string")
    assert [r.n for r in rows.orderBy(names.natural_key(F.col("n"))).collect()] == ["a2b9", "a2b10", "n9", "n9a", "n10"]
    got = names.infer_by_suffix(spark.createDataFrame([("U1_and2_3",), ("big_mux2",), ("x_y",), ("mux2",), ("",)], "n string"), "n", spark.createDataFrame([("and2",), ("mux2",), ("big_mux2",)], "k string")).collect()
    assert {r.n: r.inferred for r in got} == {"U1_and2_3": "and2", "big_mux2": "big_mux2", "x_y": "y", "mux2": "mux2", "": "unknown"}
    assert spark.range(1).select(names.quoted(F.lit('a"b\\c\nd'))).first()[0] == '"a\\"b\\\\c\\nd"'
    assert spark.range(1).select(names.sanitised(F.lit("--a b|c--"))).first()[0] == "a_b_c"


def test_the_cells_that_names_spell_out():
    """Truth tables of some cells, written out by hand."""
    import itertools

    from netloom.functions.logic import parse

    want = {
        "a21boi": lambda a1, a2, b1_n: not (a1 and a2 or not b1_n), "o2bb2a": lambda a1, a2, b1, b2: (not a1 or not a2) and (b1 or b2), "a2111oi": lambda a1, a2, b, c, d: not (a1 and a2 or b or c or d),
        "o32ai": lambda a1, a2, a3, b1, b2: not ((a1 or a2 or a3) and (b1 or b2)), "nand3b": lambda a, b, c: not (not a and b and c), "nor4b": lambda a, b, c, d: not (a or b or c or not d),
        "or4bb": lambda a, b, c, d: a or b or not c or not d, "and4bb": lambda a, b, c, d: not a and not b and c and d, "o21ba": lambda a1, a2, b1: (a1 or a2) and not b1,
    }
    assert len(BASIC_CELLS) == 64 and BASIC_CELLS["o2bb2a"].inputs == ("A1_N", "A2_N", "B1", "B2") and BASIC_CELLS["a21bo"].inputs == ("A1", "A2", "B1_N")
    for name, holds in want.items():
        cell = BASIC_CELLS[name]
        (text,) = cell.outputs.values()
        assert ("Y" in cell.outputs) == (name[-1] == "i" or name.startswith("n"))
        for bits in itertools.product((False, True), repeat=len(cell.inputs)):
            assert bool(eval_tree(parse(text), dict(zip(cell.inputs, bits)))) == bool(holds(*bits)), name


def eval_tree(tree, values):
    from netloom.operators.simulate import _lane

    import numpy as np

    return _lane(tree, lambda s: np.array([values[s]]), 1)[0]


def test_long_digit_runs_and_numbers_already_taken(spark):
    rows = spark.createDataFrame([("n" + "9" * 25,), ("n1" + "0" * 25,), ("n007",), ("n8",)], "n string")
    assert [r.n for r in rows.orderBy(names.natural_key(F.col("n"))).collect()] == ["n007", "n8", "n" + "9" * 25, "n1" + "0" * 25]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x_2"), (4, "x"), (5, "x_4"), (6, "x"), (7, "y_2"), (8, "x_1")], "id int, n string")
    found = {r.id: r.unique_name for r in names.numbered_duplicates(rows, "n", ["id"]).collect()}
    assert found == {1: "x", 2: "x_3", 3: "x_2", 4: "x_5", 5: "x_4", 6: "x_6", 7: "y_2", 8: "x_1"}
