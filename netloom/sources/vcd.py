"""Waveform dumps (VCD) as change rows, and samples at clock edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators import ordered
from netloom.shared import cut

LINES = (["dump"], ["line_no"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(dump, line_no, text); dump is the file. Order inside one time stamp matters, so lines are numbered as they stand.

    A file is read in as many splits as Spark likes; a split's lines are numbered on from those of the splits before it."""
    raw = spark.read.text(path, lineSep="\n")
    place = [F.col("_metadata.file_path").alias("dump"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    rows = cut(raw.select(*place, F.regexp_replace("value", "\r$", "").alias("text")), "lines")
    blocks = rows.groupBy("dump", "block").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dump").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("dump", "block", (before - F.col("least")).alias("shift")), ["dump", "block"]).select("dump", (F.col("id") + F.col("shift")).alias("line_no"), "text")


def signals(lines: DataFrame) -> DataFrame:
    """(dump, symbol, name) of one-bit variables with a one-character symbol."""
    form = r"^\s*\$var\s+\S+\s+1\s+(\S)\s+(\S+).*\$end"
    return lines.where(F.col("text").rlike(form)).select("dump", F.regexp_extract("text", form, 1).alias("symbol"), F.regexp_extract("text", form, 2).alias("name"))


def changes(lines: DataFrame) -> DataFrame:
    """(dump, line_no, time, name, value) of the 0/1 changes of ``signals``; buses and unknown values are left out."""
    marked = lines.withColumn("time", F.when(F.col("text").rlike(r"^#\d+$"), F.substring("text", 2, 20).cast("long")))
    timed = ordered.held_over(ordered.in_ranges(marked, *LINES), *LINES, ["time"])
    bits = timed.where(F.col("text").rlike(r"^[01].$")).select("dump", "line_no", F.col("time_held").alias("time"), F.substring("text", 2, 1).alias("symbol"), F.substring("text", 1, 1).cast("int").alias("value"))
    return bits.join(signals(lines), ["dump", "symbol"]).select("dump", "line_no", "time", "name", "value")


def at_rising_edges(changed: DataFrame, names: list[str], clock: str = "clk") -> DataFrame:
    """(dump, line_no, time, <names>) at every 0 to 1 of ``clock``. A signal that changes after the clock in the file, even at
    the same time, still has its old value. Signals start at 0. An unknown clock raises."""
    if clock not in names:
        raise ValueError(f"no signal named {clock}")
    own = changed.select("dump", "line_no", "time", "name", *[F.when(F.col("name") == n, F.col("value")).alias(n) for n in names])
    wide = ordered.held_over(ordered.in_ranges(own, *LINES), *LINES, names)
    wide = wide.select(ordered.RANGE, "dump", "line_no", "time", "name", *[F.coalesce(f"{n}_held", F.lit(0)).alias(n) for n in names])
    edges = ordered.rising_over(wide, *LINES, F.col(clock) == 1).where(F.col("name") == clock)
    return edges.select("dump", "line_no", "time", *names)


def attempts(samples: DataFrame, enable: str = "enable") -> DataFrame:
    """``samples`` with enable high, numbered by runs of a dump (attempt) and inside them (pos)."""
    on = F.col(enable) == 1
    seen = ordered.previous_over(ordered.in_ranges(samples, *LINES), *LINES, on, "_before")
    runs = ordered.sum_over(seen, *LINES, (on & ~F.coalesce("_before", F.lit(False))).cast("int"), "attempt").where(on)
    runs = runs.withColumn("attempt", F.col("attempt") - 1).drop(ordered.RANGE, "_before")
    return runs.withColumn("pos", F.row_number().over(Window.partitionBy("dump", "attempt").orderBy("line_no")) - 1)


def words(runs: DataFrame, bit: str, size: int = 11) -> DataFrame:
    """(dump, attempt, text): every ``size`` bits a character, first bit lowest."""
    value = F.sum(F.call_function("shiftleft", F.col(bit).cast("long"), (F.col("pos") % size).cast("int"))).alias("code")
    coded = runs.groupBy("dump", "attempt", F.floor(F.col("pos") / size).alias("row")).agg(value)
    letters = F.array_sort(F.collect_list(F.struct("row", F.chr("code").alias("c"))))
    return coded.groupBy("dump", "attempt").agg(F.array_join(F.transform(letters, lambda s: s["c"]), "").alias("text"))
