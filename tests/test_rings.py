"""Rings with slanted edges, paths' outlines, levels of tiles, and layout streams in runs, against brute force."""

import math
import random
import struct
from fractions import Fraction

import pytest

from netloom.operators import geometry
from netloom.operators.extract import extract
from netloom.operators.layout import Layout
from netloom.sources import gds
from tests.test_extract_cli import LABEL, SHAPE, box, ring
from tests.test_layout_play import cell, label, ref, short, two_inverters
from tests.test_sources import name, real8, record, xy

UNITS = record(gds.UNITS, real8(0.001) + real8(1e-9))


def winding(points, x, y):
    total = 0
    for (a, b), (c, d) in zip(points, points[1:] + points[:1]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            total += 1 if d > b else -1
    return total


def held(pieces, x, y):
    """Trapezoids that hold a point."""
    return sum(y0 <= y < y1 and l0 + (l1 - l0) * (y - y0) / (y1 - y0) <= x < r0 + (r1 - r0) * (y - y0) / (y1 - y0) for _, y0, _, y1, l0, l1, r0, r1 in pieces)


def test_trapezoids_hold_what_a_ring_winds_around():
    rng = random.Random(3)
    shapes = [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)], [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0), (2, 2), (2, 6), (6, 6), (6, 2), (2, 2)]]
    shapes += [[(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randint(3, 9))] for _ in range(120)]
    for points in shapes:
        pieces = geometry.trapezoids(points)
        for _ in range(60):
            x, y = rng.uniform(-1, 13), rng.uniform(-1, 13)
            assert held(pieces, x, y) == (winding(points, x, y) != 0), points
    assert geometry.trapezoids(shapes[0]) == [(0, 0, 4, 1, 0, 0, 4, 4), (0, 1, 1, 3, 0, 0, 1, 1)]
    assert geometry.trapezoids([(0, 0), (4, 0), (2, 3)]) == [(0, 0, 4, 3, 0, 2, 4, 2)]
    assert geometry.trapezoids([(0, 0), (4, 0)]) == geometry.trapezoids([]) == []


def test_no_corner_of_a_slanted_ring_is_lost(spark):
    """A box with a cut corner and a triangle, which rectangles would lose, join their neighbours."""
    shapes = spark.createDataFrame([
        (67, 20, ring((0, 0), (4, 0), (6, 2), (6, 4), (0, 4))), (67, 20, ring((6, 2), (10, 6), (10, 2))), (67, 20, box(10, 3, 12, 5)),
        (67, 20, ring((5, 1), (4, 0), (9, 0), (9, 0.5))), (67, 20, ring((20, 0), (24, 0), (22, 4))), (67, 20, ring((22, 4), (20, 8), (24, 8))),
    ], SHAPE)
    points = [("a", 0.5, 3.5), ("b", 5.9, 3.9), ("c", 9.9, 5.8), ("d", 11.0, 4.0), ("e", 8.5, 0.2), ("f", 22.0, 3.0), ("g", 22.0, 5.0), ("h", 5.9, 0.1)]
    labels = spark.createDataFrame([(f"U_{n}", "A", 67, 5, x, y) for n, x, y in points], LABEL)
    got = extract(shapes, labels, labels.select("instance").distinct())
    assert sorted(r.terminals for r in got.nets.collect()) == [["U_a.A", "U_b.A", "U_e.A", "U_h.A"], ["U_c.A", "U_d.A"], ["U_f.A"], ["U_g.A"]]


def polygon(rng):
    """A convex ring of whole numbers."""
    x, y, r = rng.randrange(60), rng.randrange(60), rng.randint(1, 9)
    return rng.choice([
        [(x, y), (x + r, y), (x + r, y + r), (x, y + r)], [(x, y), (x + 2 * r, y), (x, y + r)], [(x, y - r), (x + r, y), (x, y + r), (x - r, y)],
        [(x, y), (x + r, y + 1), (x + 1, y + r + 1)], [(x, y), (x + r, y + r), (x + r, y + r + 2), (x, y + 2)],
    ])


def clipped(a, b):
    """What two convex rings share, in fractions (Sutherland and Hodgman)."""
    out = [(Fraction(x), Fraction(y)) for x, y in a]
    for (px, py), (qx, qy) in zip(b, b[1:] + b[:1]):
        side = lambda p: (qx - px) * (p[1] - py) - (qy - py) * (p[0] - px)
        now, out = out, []
        for s, e in zip(now, now[1:] + now[:1]):
            if (side(s) >= 0) != (side(e) >= 0):
                t = side(s) / (side(s) - side(e))
                out.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
            if side(e) >= 0:
                out.append(e)
    return out


def turned(points):
    area = sum(x * v - u * y for (x, y), (u, v) in zip(points, points[1:] + points[:1]))
    return points if area > 0 else points[::-1]


@pytest.mark.parametrize("tile", [3.0, 16.0])
def test_touching_trapezoids_match_clipping(spark, tile):
    """Regions of random convex rings: two of them are one if they share more than a point."""
    rng = random.Random(8)
    rings = [turned(polygon(rng)) for _ in range(110)] + [[(0, 0), (70, 0), (70, 2), (0, 2)]]
    label = list(range(len(rings)))
    met = [(i, j) for i in range(len(rings)) for j in range(i) if len(set(clipped(rings[i], rings[j]))) > 1]
    while True:
        new = list(label)
        for i, j in met:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            break
        label = new
    rows = spark.createDataFrame([(i, 0, ring(*r)) for i, r in enumerate(rings)], "id int, layer int, ring array<struct<x:double,y:double>>")
    pieces = geometry.cut_rings(rows, "id", "layer").selectExpr("id", "layer", "monotonically_increasing_id() AS box", *geometry.BOX, *geometry.SLANTED)
    rooted = geometry.regions(pieces, tile).collect()
    found = {}
    for r in rooted:
        found.setdefault(r.region, set()).add(r.id)
    want = {}
    for i, at in enumerate(label):
        want.setdefault(at, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    # areas by fine strips
    areas = {r.region: r.area for r in geometry.areas(geometry.regions(pieces, tile), tile).collect()}
    total = 0.0
    step = 1 / 16
    for k in range(int(-10 / step), int(80 / step)):
        y, spans = (k + 0.5) * step, []
        for r in rings:
            cross = sorted((c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(r, r[1:] + r[:1]) if (b > y) != (d > y))
            spans += [cross] if cross else []
        at = -1e9
        for a, b in sorted(spans):
            total += max(0.0, b - max(a, at)) * step
            at = max(at, b)
    assert sum(areas.values()) == pytest.approx(total, rel=2e-3)


def test_points_probe_every_level(spark):
    rng = random.Random(1)
    boxes = [(i, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-3, 2), 10 ** rng.uniform(-3, 2))) for i in range(200)]
    boxes += [(200, -1000.0, -1000.0, 1000.0, 1000.0), (201, 3.0, 3.0, 3.0, 3.0)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(300)] + [(300, 3.0, 3.0), (301, 5000.0, 0.0)]
    held_by = geometry.points_in_boxes(spark.createDataFrame(points, "point int, x double, y double"), spark.createDataFrame(boxes, "box int, x0 double, y0 double, x1 double, y1 double"), 2.0)
    want = sorted((p, b) for p, x, y in points for b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted((r.point, r.box) for r in held_by.select("point", "box").collect()) == want
    frame = spark.createDataFrame(boxes, "box int, x0 double, y0 double, x1 double, y1 double")
    copies = geometry._covered(frame.withColumn("level", geometry._level(2.0)), 2.0).groupBy("box").count()
    assert copies.agg({"count": "max"}).first()[0] <= 4
    assert geometry.points_in_boxes(spark.createDataFrame(points, "point int, x double, y double"), frame.limit(0), 2.0).count() == 0


def area(points):
    return abs(sum(x * v - u * y for (x, y), (u, v) in zip(points, points[1:] + points[:1]))) / 2


@pytest.mark.parametrize(
    ("points", "ends", "want"),
    [
        ([(0, 0), (10, 0)], gds.FLUSH, 20.0), ([(0, 0), (10, 0)], gds.HALF, 24.0), ([(0, 0), (10, 0), (10, 10)], gds.FLUSH, 40.0), ([(0, 0), (10, 0), (10, 10)], gds.HALF, 44.0),
        ([(0, 0), (5, 0), (10, 0)], gds.FLUSH, 20.0), ([(0, 0), (0, 0), (10, 0), (10, 0)], gds.FLUSH, 20.0), ([(5, 5)], gds.HALF, 4.0), ([(5, 5)], gds.FLUSH, 0.0), ([], gds.HALF, 0.0),
    ],
)
def test_outlines(points, ends, want):
    assert area(gds.outline(points, 2.0, ends)) == pytest.approx(want)
    assert gds.outline(points, 0.0, ends) == []


def test_round_and_given_ends():
    assert area(gds.outline([(0, 0), (10, 0)], 2.0, gds.ROUND)) == pytest.approx(20 + math.pi, rel=2e-3)
    assert area(gds.outline([(0, 0), (10, 0)], 2.0, gds.GIVEN, 3.0, -1.0)) == pytest.approx(24.0)
    assert area(gds.outline([(3, 3)], 2.0, gds.ROUND)) == pytest.approx(math.pi, rel=1e-2)


def test_outlines_hold_their_line():
    """Every point beside a segment and within half of the width is inside; none farther than the mitre's reach is."""
    rng = random.Random(6)
    for _ in range(60):
        line = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randint(2, 6))]
        line = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
        if len(line) < 2:
            continue
        pieces = geometry.trapezoids(gds.outline(line, 2.0))
        for _ in range(200):
            x, y = rng.uniform(-3, 33), rng.uniform(-3, 33)
            along, away = [], []
            for (a, b), (c, d) in zip(line, line[1:]):
                t = ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)
                along.append(0 <= t <= 1)
                s = min(1, max(0, t))
                away.append(math.hypot(x - a - s * (c - a), y - b - s * (d - b)))
            if any(q < 0.999 and t for q, t in zip(away, along)):
                assert held(pieces, x, y), (line, x, y)
            if min(away) > 1 * gds.MITRE + 1e-3:
                assert not held(pieces, x, y), (line, x, y)


def path(layer, datatype, width, ends, *points):
    return record(gds.PATH) + short(gds.LAYER, layer) + short(gds.DATATYPE, datatype) + short(gds.PATHTYPE, ends) + record(gds.WIDTH, struct.pack(">i", width)) + xy(*points) + record(gds.ENDEL)


def test_paths_extract_like_boundaries(spark, tmp_path):
    """The two inverters with their wires drawn as paths give the same nets."""
    drawn = two_inverters()
    wires = {
        record(gds.BOUNDARY) + short(gds.LAYER, 67) + short(gds.DATATYPE, 20) + xy((3000, 0), (10000, 0), (10000, 1000), (3000, 1000), (3000, 0)) + record(gds.ENDEL): path(67, 20, 1000, 0, (3000, 500), (10000, 500)),
        record(gds.BOUNDARY) + short(gds.LAYER, 68) + short(gds.DATATYPE, 20) + xy((-5000, 0), (1000, 0), (1000, 1000), (-5000, 1000), (-5000, 0)) + record(gds.ENDEL): path(68, 20, 1000, 2, (-4500, 500), (500, 500)),
    }
    routed = drawn
    for boundary, line in wires.items():
        assert boundary in routed
        routed = routed.replace(boundary, line)
    nets = []
    for k, stream in enumerate((drawn, routed)):
        file = tmp_path / f"{k}.gds"
        file.write_bytes(stream)
        nets.append(sorted((r.net, r.aliases, r.terminals) for r in Layout.load(spark, str(file)).netlist().nets.collect()))
    assert nets[0] == nets[1] and len(nets[0]) == 3


def test_a_label_may_have_a_width():
    stream = UNITS + record(gds.STRNAME, name("a")) + record(gds.TEXT) + short(gds.LAYER, 1) + short(gds.TEXTTYPE, 5) + short(gds.PATHTYPE, 0) + record(gds.WIDTH, struct.pack(">i", 7)) + xy((1000, 2000)) + record(gds.STRING, name("A")) + record(gds.ENDEL)
    (_, made) = gds.elements(stream)
    assert (made["text"], made["ox"], made["oy"]) == ("A", 1.0, 2.0) and "width" not in made


def chip(cells, elements):
    rng = random.Random(2)
    body = []
    for c in range(cells):
        inside = [path(67, 20, 10, k % 3, (k, 0), (k + 50, rng.randrange(1, 90))) if k % 5 == 0 else label(f"L{k}", 67, k, k) for k in range(elements)]
        grid = record(gds.AREF) + record(gds.SNAME, name("leaf")) + record(gds.COLROW, struct.pack(">hh", 2, 3)) + xy((0, 0), (20, 0), (0, 30)) + record(gds.ENDEL)
        body.append(cell(f"c{c}", *inside, grid, ref("leaf", c, c), path(67, 20, 0, 0, (0, 0), (9, 9)), label("last", 67, 1, 1)))
    return UNITS + cell("leaf", label("x", 67, 0, 0)) + b"".join(body) + record(gds.ENDLIB)


@pytest.mark.parametrize("run_bytes", [1, 1000, 20_000, 1 << 30])
def test_runs_give_the_rows_of_one_task(spark, tmp_path, run_bytes):
    """Large structures are decoded by several tasks, and every element once."""
    (tmp_path / "a.gds").write_bytes(chip(3, 400))
    (tmp_path / "b.gds").write_bytes(chip(1, 3)[: -len(record(gds.ENDLIB))])
    columns = [c.split()[0] for c in gds.ELEMENTS.split(", ")]
    whole = gds.read_elements(spark, str(tmp_path)).select(*columns)
    split = gds.read_runs(spark, str(tmp_path), max(run_bytes, 200)).select(*columns)
    if run_bytes > 1:
        parts = split.rdd.getNumPartitions()
        assert parts == 2 if run_bytes == 1 << 30 else parts > 3
    key = lambda r: repr(r)
    assert sorted(split.collect(), key=key) == sorted(whole.collect(), key=key)
    chunks = [chip(2, 40)[i : i + 7] for i in range(0, len(chip(2, 40)), 7)]
    assert list(gds.runs(iter(chunks), run_bytes)) == list(gds.runs(iter([chip(2, 40)]), run_bytes))
