"""Points, boxes, trapezoids and rings: joins by tile instead of by range.

Tiles come in levels, each of twice the side of the one below. A box lies on the level whose tiles are no smaller than it,
so it has four copies at most, however large it is. What looks for boxes probes the tile around it on every level that
holds one; the levels go by the logarithm of the sizes.

A trapezoid is a box (x0, y0, x1, y1) with level lower and upper edges whose left and right edges run from l0 to l1 and from
r0 to r1. Operators that get these columns test the slanted edges, else the box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import connected_components
from netloom.shared import cut

#: Edges closer than NEAR are one; a shared edge is longer than SHORT. In the unit of the coordinates, which have nine digits.
NEAR, SHORT = 1e-9, 1e-6
#: Rows up to which one side of a join goes to every task, and pairs that a sweep holds in arrays at a time.
FEW, BLOCK = 1 << 14, 1 << 18
BOX = ("x0", "y0", "x1", "y1")
SLANTED = ("l0", "l1", "r0", "r1")
TRAPEZOID = ", ".join(f"{c} double" for c in BOX + SLANTED)


def _level(tile: float) -> Column:
    """Level of a box: that of the smallest tiles, ``tile`` or a doubling of it, that are as large as the box."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(extent / tile)), F.lit(0))).cast("int")


def _side(tile: float) -> Column:
    return tile * F.pow(F.lit(2.0), F.col("level"))


def _covered(rows: DataFrame, tile: float) -> DataFrame:
    """``rows`` (boxes with a level) in each tile of that level that they touch."""
    for t, low, high in (("tx", "x0", "x1"), ("ty", "y0", "y1")):
        rows = rows.select("*", F.explode(F.sequence(F.floor(F.col(low) / _side(tile)), F.floor(F.col(high) / _side(tile)))).alias(t))
    return rows


def levels_of(boxes: DataFrame, tile: float) -> Column:
    """The levels that hold boxes, a constant array: one a doubling at most."""
    return boxes.agg(F.collect_set(_level(tile)).alias("levels")).scalar()


def _edge(low: str, high: str, y: Column, prefix: str = "") -> Column:
    """Place of an edge at height ``y``."""
    a, b, y0, y1 = (F.col(prefix + c) for c in (low, high, "y0", "y1"))
    return F.when(y <= y0, a).when(y >= y1, b).otherwise(a + (b - a) * (y - y0) / (y1 - y0))


def _shapes(boxes: DataFrame) -> DataFrame:
    """Equal boxes or trapezoids of a layer once: ``n``, how many there are, and ``box``, the lowest-numbered of them."""
    return boxes.groupBy(*[c for c in ("layer", *BOX, *SLANTED) if c in boxes.columns]).agg(F.count("*").alias("n"), F.min("box").alias("box"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """(point, box) for every point (point, x, y) in a closed box or trapezoid (columns of layer match if both sides have
    one). Both sides meet on tiles: an equi-join, a box four times at most, a point once a level. A side of up to FEW rows
    goes to every task; if neither is that small, both are shuffled, whatever Spark makes of the size of compressed files.
    """
    keys = [k for k in ("layer",) if k in points.columns and k in boxes.columns]
    placed = points.select("*", F.explode(levels_of(boxes, tile)).alias("level"))
    placed = placed.withColumns({"tx": F.floor(F.col("x") / _side(tile)), "ty": F.floor(F.col("y") / _side(tile))})
    inside = F.expr("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    if "l0" in boxes.columns:
        inside &= F.col("x").between(_edge("l0", "l1", F.col("y")) - NEAR, _edge("r0", "r1", F.col("y")) + NEAR)
    spread = _covered(boxes.withColumn("level", _level(tile)), tile)
    if boxes.count() <= FEW:
        spread = F.broadcast(spread)
    else:
        placed = F.broadcast(placed) if points.count() <= FEW else placed.hint("merge")
    return placed.join(spread, ["level", "tx", "ty", *keys]).where(inside).drop("level", "tx", "ty")


def counted(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """``points`` with ``n``, how many boxes hold each, and ``box``, the lowest-numbered of them, null if none does.

    Equal boxes and equal places meet once, so copies of them cost rows, not pairs.
    """
    at = [c for c in ("layer", "x", "y") if c in points.columns and (c != "layer" or c in boxes.columns)]
    places = points.select(*at).distinct()
    found = points_in_boxes(places, _shapes(boxes), tile).groupBy(*at).agg(F.sum("n").alias("n"), F.min("box").alias("box"))
    told = points.join(F.broadcast(found), at, "left") if places.count() <= 2 * FEW else points.hint("merge").join(found, at, "left")
    return told.select(*[F.col(c) for c in points.columns], F.coalesce("n", F.lit(0)).alias("n"), "box")


def first_region(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """``points`` with the lowest-numbered box that holds each, null if none does."""
    return counted(points, boxes, tile).drop("n")


def stitched(cuts: DataFrame, low: DataFrame, high: DataFrame, tile: float) -> DataFrame:
    """(point, low_box, high_box): cuts whose centre lies in a region of both sheets."""
    a = first_region(cuts, low, tile).where("box IS NOT NULL").withColumnRenamed("box", "low_box")
    b = first_region(a, high, tile).where("box IS NOT NULL")
    return b.select("point", "low_box", F.col("box").alias("high_box"))


def touching(boxes: DataFrame, tile: float) -> DataFrame:
    """(u, v), u < v: boxes or trapezoids of one layer that share an edge or area; corners alone do not touch.

    Each box looks for others on its own level and the ones above, so of two boxes the smaller finds the larger.
    """
    slanted = "l0" in boxes.columns
    columns = ["box", *BOX, *(SLANTED if slanted else ())]
    rows = boxes.select("layer", *columns).withColumn("own", _level(tile))
    home = _covered(rows.withColumnRenamed("own", "level"), tile)
    seeker = _covered(rows.select("*", F.explode(levels_of(boxes, tile)).alias("level")).where("level >= own"), tile)
    keys = ["level", "tx", "ty", "layer"]
    a = seeker.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = home.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    met = a.join(b, keys).where(F.col("a_box") != F.col("b_box")).where(_share_edges() if slanted else _share_boxes())
    return met.select(F.least("a_box", "b_box").alias("u"), F.greatest("a_box", "b_box").alias("v")).distinct()


def linked(boxes: DataFrame, tile: float) -> DataFrame:
    """(u, v): fewer pairs than ``touching`` that make the same components. Equal boxes touch the same others, so only the
    lowest-numbered of them looks for others; its equals are tied to it if they touch one another, as all but points do.
    """
    shapes = _shapes(boxes)
    place = [c for c in shapes.columns if c not in ("n", "box")]
    first = shapes.where("n > 1").select(*place, F.col("box").alias("least"))
    itself = [F.col(c).alias(f"{s}_{c}") for s in "ab" for c in place if c != "layer"]
    same = boxes.join(first, place).where("box <> least").select(F.col("box").alias("v"), F.col("least").alias("u"), *itself)
    tied = same.where(_share_edges() if "l0" in place else _share_boxes()).select("u", "v")
    return touching(shapes.drop("n"), tile).unionByName(tied)


def _overlap(axis: str) -> Column:
    return F.least(f"a_{axis}1", f"b_{axis}1") - F.greatest(f"a_{axis}0", f"b_{axis}0")


def _share_boxes() -> Column:
    dx, dy = _overlap("x"), _overlap("y")
    return (dx >= 0) & (dy >= 0) & ((dx > 0) | (dy > 0))


def _share_edges() -> Column:
    """Whether trapezoids a and b share area or an edge.

    Over the heights that both have, a's right edge less b's left one, and the other way round, are lines; the two meet
    where neither is below zero. That has to be a stretch; at one height alone, a level edge has to be shared.
    """
    low, high = F.greatest("a_y0", "b_y0"), F.least("a_y1", "b_y1")

    def gap(right: str, left: str, y: Column) -> Column:
        return _edge("r0", "r1", y, right) - _edge("l0", "l1", y, left)

    starts, ends = F.lit(0.0), F.lit(1.0)
    apart = F.lit(False)
    for right, left in (("a_", "b_"), ("b_", "a_")):
        at_low, at_high = gap(right, left, low) + NEAR, gap(right, left, high) + NEAR
        crossing = at_low / (at_low - at_high)
        apart |= (at_low < 0) & (at_high < 0)
        starts = F.greatest(starts, F.when((at_low < 0) & (at_high >= 0), crossing).otherwise(0.0))
        ends = F.least(ends, F.when((at_low >= 0) & (at_high < 0), crossing).otherwise(1.0))
    stretch = ~apart & ((ends - starts) * (high - low) > SHORT)
    width = F.least(_edge("r0", "r1", low, "a_"), _edge("r0", "r1", low, "b_")) - F.greatest(_edge("l0", "l1", low, "a_"), _edge("l0", "l1", low, "b_"))
    level = (F.abs(high - low) <= NEAR) & (width > SHORT)
    return (_overlap("x") >= -NEAR) & (high - low >= -NEAR) & F.when(high - low > SHORT, stretch).otherwise(level)


def _crossings(segments: np.ndarray) -> list[float]:
    """Heights at which two of ``segments`` (x and y of the lower end, x and y of the upper end) cross inside both, by blocks
    of BLOCK pairs."""
    found, (x0, y0, x1, y1) = [], segments.T
    slope = (x1 - x0) / (y1 - y0)
    step = max(1, BLOCK // max(1, len(segments)))
    for at in range(0, len(segments) - 1, step):
        one, rest = (slice(at, at + step), None), slice(at + 1, None)
        turn = slope[rest] - slope[one]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (x0[one] - slope[one] * y0[one] - x0[rest] + slope[rest] * y0[rest]) / turn
        low, high = np.maximum(y0[rest], y0[one]), np.minimum(y1[rest], y1[one])
        later = np.arange(len(turn))[:, None] <= np.arange(turn.shape[1])
        found += y[later & (turn != 0) & (y > low + NEAR) & (y < high - NEAR)].tolist()
    return found


def _few_crossings(sides: list[tuple[float, ...]]) -> list[float]:
    """``_crossings`` of a few segments without arrays, whose set-up costs more than their pairs."""
    found = []
    lines = [(x0, y0, y1, (x1 - x0) / (y1 - y0)) for x0, y0, x1, y1, *_ in sides]
    for i, (x, y0, y1, slope) in enumerate(lines):
        for u, v0, v1, other in lines[i + 1 :]:
            if (turn := other - slope) != 0 and max(y0, v0) + NEAR < (y := (x - slope * y0 - u + other * v0) / turn) < min(y1, v1) - NEAR:
                found.append(y)
    return found


def trapezoids(ring: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """A ring's area (points that it winds around) as trapezoids (x0, y0, x1, y1, l0, l1, r0, r1), by a sweep over its heights.

    The ring may cross or touch itself. A trapezoid goes on through heights at which neither of its edges ends or crosses
    another, so there are about as many as the ring has corners.
    """
    sides = [((x, y, u, v, 1) if y < v else (u, v, x, y, -1)) for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True) if y != v]
    if not sides:
        return []
    sides.sort(key=lambda e: e[1])
    heights = {y for e in sides for y in (e[1], e[3])}
    if any(e[0] != e[2] for e in sides):
        heights.update(_few_crossings(sides) if len(sides) <= 16 else _crossings(np.array([e[:4] for e in sides])))
    heights = sorted(heights)

    def place(i: int, y: float) -> float:
        x0, y0, x1, y1, _ = sides[i]
        return x0 if y <= y0 else x1 if y >= y1 else x0 + (x1 - x0) * (y - y0) / (y1 - y0)

    open_: dict[tuple[int, int], float] = {}
    out, active, at = [], [], 0

    def close(pair: tuple[int, int], y: float) -> None:
        y0, (a, b) = open_.pop(pair), pair
        l0, l1, r0, r1 = place(a, y0), place(a, y), place(b, y0), place(b, y)
        out.append((min(l0, l1), y0, max(r0, r1), y, l0, l1, r0, r1))

    for low, high in zip(heights, heights[1:], strict=False):
        while at < len(sides) and sides[at][1] <= low:
            active.append(at)
            at += 1
        active = [i for i in active if sides[i][3] > low]
        middle = (low + high) / 2
        active.sort(key=lambda i: (place(i, middle), i))
        now, winding, left = [], 0, -1
        for i in active:
            before, winding = winding, winding + sides[i][4]
            if before == 0:
                left = i
            elif winding == 0 and place(left, middle) < place(i, middle):
                now.append((left, i))
        kept = set(now)
        for pair in [p for p in open_ if p not in kept]:
            close(pair, low)
        for pair in now:
            open_.setdefault(pair, low)
    for pair in list(open_):
        close(pair, heights[-1])
    return out


def cut_rings(rings: DataFrame, *keep: str) -> DataFrame:
    """The trapezoids of every ``ring`` (array of struct x, y), with the columns ``keep``."""
    schema = ", ".join([*(f"`{c}` {rings.schema[c].dataType.simpleString()}" for c in keep), TRAPEZOID])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*kept, *t) for *kept, ring in zip(*(pdf[c] for c in keep), pdf["ring"], strict=True) for t in trapezoids([(p["x"], p["y"]) for p in ring])]
            yield pd.DataFrame(rows, columns=[*keep, *BOX, *SLANTED])

    return rings.select(*keep, "ring").where("ring IS NOT NULL").mapInPandas(run, schema)


def regions(pieces: DataFrame, tile: float) -> DataFrame:
    """``pieces`` (box, layer, TRAPEZOID, ...) with ``region``, the smallest box of those that they reach by touching."""
    pieces = cut(pieces, "pieces")
    roots = connected_components(touching(pieces, tile))
    return pieces.join(roots.toDF("box", "root"), "box", "left").withColumn("region", F.coalesce("root", "box")).drop("root")


def _united(pieces: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of the union of trapezoids (y0, y1, l0, l1, r0, r1) inside a tile: slabs in which no two edges cross."""
    lows, highs = np.maximum(pieces[:, 0], y0), np.minimum(pieces[:, 1], y1)
    edges = np.concatenate([np.stack([pieces[:, k], pieces[:, 0], pieces[:, k + 1], pieces[:, 1]], 1) for k in (2, 4)])
    slanted = np.unique(edges[edges[:, 0] != edges[:, 2]], axis=0)
    heights = [lows, highs]
    if len(slanted):
        slope = (slanted[:, 2] - slanted[:, 0]) / (slanted[:, 3] - slanted[:, 1])
        upright = np.unique(np.r_[edges[edges[:, 0] == edges[:, 2], 0], x0, x1])
        for x in upright:
            heights.append(slanted[:, 1] + (x - slanted[:, 0]) / slope)
        heights.append(np.array(_crossings(slanted)))
    heights = np.unique(np.clip(np.concatenate(heights), y0, y1))
    total = 0.0
    step = max(1, BLOCK // max(1, len(pieces)))
    for at in range(0, len(heights) - 1, step):
        low, high = heights[:-1][at : at + step, None], heights[1:][at : at + step, None]
        held = (pieces[:, 0] <= low) & (pieces[:, 1] >= high)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = ((low + high) / 2 - pieces[:, 0]) / (pieces[:, 1] - pieces[:, 0])
            left, right = (np.where(held, np.clip(pieces[:, k] + (pieces[:, k + 1] - pieces[:, k]) * share, x0, x1), x0) for k in (2, 4))
        order = np.argsort(left, axis=1)
        left, reach = np.take_along_axis(left, order, 1), np.maximum.accumulate(np.take_along_axis(right, order, 1), axis=1)
        before = np.concatenate([np.full((len(reach), 1), x0), reach[:, :-1]], axis=1)
        total += float(((high - low)[:, 0] * np.maximum(reach - np.maximum(left, before), 0).sum(1)).sum())
    return total


def areas(pieces: DataFrame, tile: float) -> DataFrame:
    """(region, area) of the union of each region's trapezoids (region, TRAPEZOID), tile by tile.

    Equal pieces count once before they are dealt. A piece has a copy in each tile that it touches; a tile of a region is
    one group, so tiles should be small enough for the pieces that lie in one.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, tx, ty = key
        held = pdf[["y0", "y1", *SLANTED]].to_numpy()
        return pd.DataFrame({"region": [key[0]], "area": [_united(held, tx * tile, ty * tile, (tx + 1) * tile, (ty + 1) * tile)]})

    rows = pieces.select("region", *BOX, *SLANTED).distinct().withColumn("level", F.lit(0))
    dealt = _covered(rows, tile).select("region", "tx", "ty", "y0", "y1", *SLANTED)
    region = pieces.schema["region"].dataType.simpleString()
    parts = dealt.groupBy("region", "tx", "ty").applyInPandas(run, f"region {region}, area double")
    return parts.groupBy("region").agg(F.sum("area").alias("area"))


def rings_at(points: DataFrame, rings: DataFrame, tile: float) -> DataFrame:
    """(point, ring) for every point (point, x, y) inside a ring (id, ring), even-odd; their boxes meet on tiles. Equal
    places meet a ring once."""
    boxes = rings.select(F.col("id").alias("box"), "ring", *bounds(F.col("ring")))
    inside = in_ring(F.col("x"), F.col("y"), F.col("ring"))
    found = points_in_boxes(points.select("x", "y").distinct(), boxes, tile).where(inside).select("x", "y", F.col("box").alias("id"))
    return points.select("point", "x", "y").hint("merge").join(found, ["x", "y"]).select("point", "id")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against ``ring`` (array of struct x, y), by ray casting."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    hits = F.filter(F.sequence(F.lit(0), n - 1), crosses)
    return (n > 2) & (F.size(hits) % 2 == 1)


def affine(ox: Column, oy: Column, rotation: Column, reflect: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A placed point: reflected over the x axis, turned counter-clockwise (radians), moved."""
    y = F.when(reflect, -y).otherwise(y)
    return ox + x * F.cos(rotation) - y * F.sin(rotation), oy + x * F.sin(rotation) + y * F.cos(rotation)


def bounds(ring: Column) -> list[Column]:
    """x0, y0, x1, y1 of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]
