"""Names: natural order, splitting, inference, escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sort key under which n9 comes before n10: a run of digits goes by how many it has without leading zeros, then by them."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), _by_length(F.ltrim(x, F.lit("0")))).otherwise(x)), "")


def _by_length(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def owner_and_pin(terminal: Column) -> tuple[Column, Column]:
    """``instance.pin`` split at the last dot."""
    return F.regexp_extract(terminal, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(terminal, r"^(.*)\.([^.]*)$", 2)


def quoted(text: Column) -> Column:
    """A DOT string: backslash, quote and line feed escaped, in that order."""
    inner = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def sanitised(name: Column) -> Column:
    """Runs of other signs than letters, digits and underscore become one underscore; none at the ends."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_"), F.lit("_"))


def infer_by_suffix(rows: DataFrame, name: str, known: DataFrame, out: str = "inferred") -> DataFrame:
    """``rows`` with the longest name of ``known`` (one column) that ``name`` (less a trailing ``_number``) is or ends in after
    an underscore; else its last underscore part; ``unknown`` for an empty one.

    The ends of every distinct name meet the known ones in an equi-join, so neither side has to be small.
    """
    base = F.regexp_replace(F.col(name), r"_\d+$", "")
    parts = F.split("_base", "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    wanted = rows.select(base.alias("_base")).where("_base IS NOT NULL").distinct().select("_base", F.explode(ends).alias("_known"))
    best = wanted.join(known.toDF("_known").distinct(), "_known").groupBy("_base").agg(F.max_by("_known", F.length("_known")).alias("_best"))
    last = F.element_at(F.split("_base", "_"), -1)
    found = F.coalesce("_best", F.when(last != "", last), F.lit("unknown"))
    return rows.withColumn("_base", base).join(best, "_base", "left").withColumn(out, found).drop("_base", "_best")


def numbered_duplicates(rows: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """The first row of a name in ``order`` keeps it; the others get ``_2`` and so on, numbers that make a name of ``rows``
    left out."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    numbered = r"^(.*)_([1-9][0-9]{0,17})$"
    ends = rows.where(F.col(name).rlike(numbered)).select(F.regexp_extract(name, numbered, 1).alias(name), F.regexp_extract(name, numbered, 2).cast("long").alias("_n"))
    taken = ends.groupBy(name).agg(F.array_sort(F.collect_set("_n")).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_n").cast("long"), lambda at, t: F.when((t >= 2) & (t <= at), at + 1).otherwise(at))
    out_name = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("_", name, free.cast("string")))
    return rows.withColumn("_n", n).join(taken, name, "left").withColumn(out, out_name).select(*rows.columns, out)
