"""Operators over rows in order: hold, edges, islands, chunks, delays, counters.

Each takes the columns that part the rows and a total order inside a part. Nothing orders the whole table at once.

Windows over one key are one task a key. Where a key may hold most of the rows (a dump, a stream of events), ``in_ranges``
cuts the rows into ranges of (keys, order), and the scans over it work in two levels: what each range hands on, a prefix over
the few rows that say so, and the rest inside each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.shared import cut


def _so_far(keys, order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def held(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last non-null of each of ``values`` up to every row, as ``<value>_held``."""
    w = _so_far(keys, order)
    return rows.withColumns({f"{v}_held": F.last(v, True).over(w) for v in values})


def rising(rows: DataFrame, keys: list[str], order: list[str], level: Column, initial: bool = False) -> DataFrame:
    """Rows at which ``level`` turns from false to true."""
    before = F.lag("_level", 1, initial).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_level", level).withColumn("_before", before).where("_level AND NOT _before").drop("_level", "_before")


def islands(rows: DataFrame, keys: list[str], order: list[str], inside: Column, out: str = "island") -> DataFrame:
    """Rows that are ``inside``, numbered from 0 by runs that rows outside part."""
    w = _so_far(keys, order)
    marked = rows.withColumn("_in", inside).withColumn("_start", F.col("_in") & ~F.lag("_in", 1, False).over(Window.partitionBy(*keys).orderBy(*order)))
    return marked.withColumn(out, F.sum(F.col("_start").cast("int")).over(w) - 1).where("_in").drop("_in", "_start")


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Dense numbers from 0."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int = 11) -> DataFrame:
    """pos, row (pos div size), col (pos mod size) and done (pos of size squared or more)."""
    pos = F.col("pos")
    return numbered(rows, keys, order).withColumns({"row": F.floor(pos / size).cast("int"), "col": pos % size, "done": pos >= size * size})


def taps(rows: DataFrame, keys: list[str], order: list[str], bit: str, delays: tuple[int, ...] = (1, 10, 11, 12)) -> DataFrame:
    """A delay line's taps, tap<k>: the bit ``k`` rows before, false before the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"tap{k}": F.lag(bit, k, False).over(w) for k in delays})


def saturating(bit: Column, keys: list[str], order: list[str], top: int = 3) -> Column:
    """Running count of ``bit`` that stays at ``top``."""
    return F.least(F.sum(bit.cast("int")).over(_so_far(keys, order)), F.lit(top).cast("long"))


def sticky(bit: Column, keys: list[str], order: list[str]) -> Column:
    """True from the first true on."""
    return F.bool_or(bit).over(_so_far(keys, order))


def first_seen(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each value's first row. Minima, not a sort: partial sums before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return picked.select(*by, *[F.col(f"_x.{c}").alias(c) for c in rest])


def predecessor(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str = "previous") -> DataFrame:
    return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def top_and_rest(rows: DataFrame, order: list, k: int = 25) -> tuple[DataFrame, Column]:
    """The first ``k`` rows, and a column that counts the others."""
    total = rows.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("n"))
    return rows.orderBy(*order).limit(k), total.scalar()


def numbered_all(rows: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Dense numbers from 0 over the whole table: ranges are sorted apart, then moved up by the rows before them.

    Only one count a range reaches the driver.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in parts.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    moved = parts.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(moved), "_part").withColumn(out, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


# scans in two levels

RANGE = "_range"


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` written in ranges of (keys, order), with the range's number."""
    return cut(rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _handed_on(ranges: DataFrame, keys: list[str], made: dict[str, Column], carried) -> DataFrame:
    """``ranges`` with, for each column that ``made`` aggregates in a range, what ``carried`` makes of it over the key's
    earlier ranges. A key has a row a range there, so all keys together have as many as keys and ranges."""
    earlier = Window.partitionBy(*keys).orderBy(RANGE)
    told = ranges.groupBy(RANGE, *keys).agg(*[c.alias(name) for name, c in made.items()])
    told = told.select(RANGE, *keys, *[carried(F.col(name), earlier).alias(name) for name in made])
    renamed = told.toDF("__range", *[f"__{k}" for k in keys], *made)
    same = [ranges[RANGE] == renamed["__range"], *(ranges[k].eqNullSafe(renamed[f"__{k}"]) for k in keys)]
    return ranges.join(renamed, reduce(lambda a, b: a & b, same), "left").drop("__range", *[f"__{k}" for k in keys])


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy(RANGE, *keys).orderBy(*order)


def held_over(ranges: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``held`` of rows ``in_ranges``."""
    last = {f"_carry_{v}": F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))) for v in values}
    rows = _handed_on(ranges, keys, last, lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    here = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"{v}_held": F.coalesce(F.last(v, True).over(here), F.col(f"_carry_{v}")) for v in values}).drop(*last)


def previous_over(ranges: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "previous") -> DataFrame:
    """Rows ``in_ranges`` with the ``value`` of the row before, null at a key's first."""
    marked = ranges.withColumn(out, F.struct(value.alias("v")))
    rows = _handed_on(marked, keys, {"_carry": F.max_by(out, F.struct(*order))}, lambda c, w: F.lag(c).over(w))
    return rows.withColumn(out, F.coalesce(F.lag(out).over(_inside(keys, order)), F.col("_carry"))["v"]).drop("_carry")


def rising_over(ranges: DataFrame, keys: list[str], order: list[str], level: Column, initial: bool = False) -> DataFrame:
    """``rising`` of rows ``in_ranges``."""
    seen = previous_over(ranges.withColumn("_level", level), keys, order, F.col("_level"), "_before")
    return seen.where(F.col("_level") & ~F.coalesce("_before", F.lit(initial))).drop("_level", "_before")


def sum_over(ranges: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "total") -> DataFrame:
    """Rows ``in_ranges`` with the sum of ``value`` up to each."""
    marked = ranges.withColumn(out, value.cast("long"))
    before = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = _handed_on(marked, keys, {"_carry": F.sum(out)}, before)
    here = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.coalesce(F.sum(out).over(here), F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_carry")
