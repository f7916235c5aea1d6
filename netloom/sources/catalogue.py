"""Cell catalogues: the JSON snapshot, and its import from timing-library JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import report
from netloom.functions.cells import CELL_SCHEMA, LIBRARY
from netloom.functions.names import owner_and_pin
from netloom.shared import cut

SNAPSHOT = (
    "schema_version int, source string, source_revision string, liberty_corner string, cells map<string, struct<description: string, inputs: array<string>, "
    "outputs: map<string,string>, clock_pins: array<string>, reset_pins: array<string>, set_pins: array<string>, sequential: boolean, clocked_on: string, "
    "next_state: string, clear: string, preset: string>>"
)
INTERNAL = ("IQ", "IQ_N")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a catalogue snapshot, one row each."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("cells").alias("cell_type", "c"))
    c = "c.inputs", F.map_keys("c.outputs").alias("outputs"), F.col("c.outputs").alias("output_functions")
    out = rows.select("cell_type", *c, "c.clock_pins", "c.reset_pins", "c.set_pins", "c.sequential", "c.clocked_on", "c.next_state", "c.clear", "c.preset")
    return out.to(spark.createDataFrame([], CELL_SCHEMA).schema)


def differences(stated: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(cell_type, problem) by a full outer join: a cell on one side only, or pins that differ as sets."""
    pins = ("inputs", "outputs", "clock_pins", "reset_pins", "set_pins")

    def side(df, mark):
        return df.select("cell_type", F.struct(*[F.array_sort(p).alias(p) for p in pins]).alias(mark))

    both = side(stated, "a").join(side(snapshot, "b"), "cell_type", "full")
    problem = F.when(F.col("a").isNull(), "not stated").when(F.col("b").isNull(), "not in the snapshot").when(F.col("a") != F.col("b"), "pins differ")
    return both.select("cell_type", problem.alias("problem")).where("problem IS NOT NULL")


def condition_pins(expression: Column) -> Column:
    """Pins that a condition names, internal state apart."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
    return F.array_except(names, F.array(*map(F.lit, INTERNAL)))


def import_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells from timing-library JSON files (one cell a file, named ``...__<cell>_<drive>...``): keys ``pin,<name>`` with direction and
    function, and at most one ``ff,...`` or ``latch,...`` record. Controls are the pins of its conditions; they leave the inputs."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    pin = "direction string, function string"
    pins = F.transform(F.filter(F.map_keys("m"), lambda k: k.startswith("pin,")), lambda k: F.struct(F.replace(k, F.lit("pin,"), F.lit("")).alias("name"), F.from_json(F.element_at("m", k), pin).alias("p")))
    kept = F.filter(F.map_keys("m"), lambda k: k.startswith("ff,") | k.startswith("latch,"))
    one = F.when(F.size(kept) > 1, F.raise_error(F.concat(F.lit("several state records in "), F.col("file"))).cast("string")).otherwise(F.get(kept, F.lit(0)))
    state = F.from_json(F.element_at("m", one), "clocked_on string, next_state string, clear string, preset string")
    rows = text.select(F.regexp_extract("file", r"__(.+?)_\d", 1).alias("cell_type"), pins.alias("pins"), F.when(one.isNotNull(), state).alias("s"))
    clock, clear, preset = (condition_pins(F.col(f"s.{c}")) for c in ("clocked_on", "clear", "preset"))
    named = lambda way: F.array_sort(F.transform(F.filter("pins", lambda x: x["p"]["direction"] == way), lambda x: x["name"]))
    functions = F.map_from_entries(F.transform(F.filter("pins", lambda x: x["p"]["direction"] == "output"), lambda x: F.struct(x["name"], x["p"]["function"])))
    return rows.select(
        "cell_type", F.array_except(named("input"), F.concat(clock, clear, preset)).alias("inputs"), named("output").alias("outputs"), functions.alias("output_functions"), clock.alias("clock_pins"), clear.alias("reset_pins"),
        preset.alias("set_pins"), F.col("s").isNotNull().alias("sequential"), "s.clocked_on", "s.next_state", "s.clear", "s.preset",
    )


def used_cell_types(nets: DataFrame) -> DataFrame:
    """(cell_type) that the instances of netlists (``terminals``) are named after: ``..._<cell>_<drive>``."""
    instance, _ = owner_and_pin(F.col("terminal"))
    return nets.select(F.explode("terminals").alias("terminal")).select(F.regexp_extract(instance, r"_([a-z][a-z0-9_]*)_[0-9]+$", 1).alias("cell_type")).where("cell_type <> ''").distinct()


def import_library(spark: SparkSession, root: str, types: DataFrame, corner: str) -> DataFrame:
    """``import_cells`` with the ``description`` of each of ``types`` from a library's checkout: ``cells/<cell>/`` with
    definition.json and one timing file of the smallest drive at ``corner``. A type without exactly one raises, as does
    an output without a function."""
    cells = cut(import_cells(spark, f"{root}/cells/*/{LIBRARY}*_1__{corner}.lib.json").join(types, "cell_type", "left_semi"), "library")
    odd = types.join(cells.groupBy("cell_type").count(), "cell_type", "left").where("count IS NULL OR count <> 1").orderBy("cell_type").limit(9).collect()
    if odd:
        raise ValueError("not one timing file: " + ", ".join(f"{r.cell_type} ({r['count'] or 0})" for r in odd[:8]) + (" and more" if len(odd) > 8 else ""))
    mute = cells.where(F.exists(F.map_values("output_functions"), lambda f: f.isNull())).orderBy("cell_type").first()
    if mute:
        raise ValueError(f"an output of {mute.cell_type} has no function")
    texts = spark.read.schema("description string").option("multiLine", True).json(f"{root}/cells/*/definition.json")
    texts = texts.select(F.regexp_extract("_metadata.file_path", r"/cells/([^/]+)/definition\.json$", 1).alias("cell_type"), "description")
    return cells.join(texts, "cell_type", "left")


#: A cell's fields in the snapshot.
FIELDS = ("clear", "clock_pins", "clocked_on", "description", "inputs", "next_state", "outputs", "preset", "reset_pins", "sequential", "set_pins")


def snapshot(cells: DataFrame, source: str, revision: str, corner: str) -> DataFrame:
    """The lines of a catalogue file."""
    value = report.json_row(*FIELDS)
    rows = cells.drop("outputs").withColumnRenamed("output_functions", "outputs").select(F.col("cell_type").alias("key"), value.alias("value"))
    return report.document(cells.sparkSession, {"cells": rows, "liberty_corner": corner, "schema_version": 1, "source": source, "source_revision": revision})


def stale(cells: DataFrame, path: str, source: str, revision: str, corner: str) -> DataFrame:
    """(cell_type, problem) where a new import differs from the file at ``path`` in any field; ``(header)`` for its own."""
    spark = cells.sparkSession
    file = spark.read.schema(SNAPSHOT).option("wholetext", True).option("multiLine", True).option("mode", "FAILFAST").json(path)
    fields = F.to_json(F.struct(*[F.array_sort(F.map_entries(f)).alias(f) if f == "outputs" else F.col(f) for f in FIELDS]))
    new = cells.drop("outputs").withColumnRenamed("output_functions", "outputs").select("cell_type", fields.alias("new"))
    old = file.select(F.explode("cells").alias("cell_type", "c")).select("cell_type", "c.*").select("cell_type", fields.alias("old"))
    problem = F.when(F.col("new").isNull(), "no longer used").when(F.col("old").isNull(), "not in the snapshot").when(F.col("new") != F.col("old"), "differs")
    header = file.where(~(F.struct("source", "source_revision", "liberty_corner").eqNullSafe(F.struct(F.lit(source), F.lit(revision), F.lit(corner)))))
    return new.join(old, "cell_type", "full").select("cell_type", problem.alias("problem")).where("problem IS NOT NULL").unionByName(header.select(F.lit("(header)").alias("cell_type"), F.lit("differs").alias("problem")))
