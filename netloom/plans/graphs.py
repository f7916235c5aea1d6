"""Graph and geometry queries: the part graph (k to (k-1) div 2 and (k-1) div 3), customers, orders, suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import geometry, graph, motifs, ordered
from netloom.queries import load, query
from netloom.shared import cut

#: Arcs from a part to the two parts that it is made from; the first INPUTS parts are made from none.
INPUTS = 8
_ARCS = f"arcs AS (SELECT p_partkey AS src, (p_partkey - 1) // d AS dst FROM part, (VALUES (2), (3)) AS t(d) WHERE p_partkey >= {INPUTS})"


def part_arcs(spark, sf_dir) -> DataFrame:
    parts = load(spark, sf_dir, "part").where(F.col("p_partkey") >= INPUTS)
    sources = F.explode(F.array(F.expr("(p_partkey - 1) div 2"), F.expr("(p_partkey - 1) div 3"))).alias("dst")
    return parts.select(F.col("p_partkey").alias("src"), sources)


def _last_part(spark, sf_dir) -> DataFrame:
    last = load(spark, sf_dir, "part").agg(F.max("p_partkey").alias("node"))
    return last.select(F.col("node").alias("root"), "node")


def _lots(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"))


_LOTS = """lots AS (SELECT l_partkey * 2 AS u, l_suppkey * 2 + 1 AS v FROM lineitem),
ways AS (SELECT u, v FROM lots UNION SELECT v, u FROM lots), nodes AS (SELECT DISTINCT u FROM ways),
walk AS (SELECT u AS node, u AS seen FROM nodes UNION SELECT walk.node, ways.v FROM walk JOIN ways ON walk.seen = ways.u),
comp AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)"""


@query("connected_components", f"WITH RECURSIVE {_LOTS} SELECT node, root FROM comp")
def connected_components(spark, sf_dir):
    return graph.connected_components(_lots(spark, sf_dir))


@query("canonical_ids", f"""WITH RECURSIVE {_LOTS}, ids AS (SELECT root, row_number() OVER (ORDER BY lpad(CAST(root AS VARCHAR), 10, '0')) - 1 AS number, count(*) AS n FROM comp GROUP BY root)
SELECT 'n' || lpad(CAST(number AS VARCHAR), 4, '0') AS id, node, n FROM comp JOIN ids USING (root)""")
def canonical_ids(spark, sf_dir):
    """Components numbered by their sorted members. They share none, so the least member tells; members come as rows."""
    comp = graph.connected_components(_lots(spark, sf_dir))
    sets = comp.groupBy("root").agg(F.count("*").alias("n")).withColumn("least", F.lpad(F.col("root").cast("string"), 10, "0"))
    ids = ordered.numbered_all(sets, ["least"])
    return comp.join(ids, "root").select(F.format_string("n%04d", "number").alias("id"), "node", "n")


@query("khop", f"""WITH RECURSIVE {_ARCS}, ways AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs),
w AS (SELECT CAST(100 AS BIGINT) AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN ways ON node = src WHERE hop < 2) SELECT node, min(hop) AS hop FROM w GROUP BY node""")
def khop(spark, sf_dir):
    start = spark.range(1).select(F.lit(100).cast("long").alias("root"), F.lit(100).cast("long").alias("node"))
    return graph.neighbourhood(part_arcs(spark, sf_dir), start, 2).select("node", "hop")


@query("backward_cone", f"""WITH RECURSIVE {_ARCS}, cone AS (SELECT max(p_partkey) AS node FROM part UNION
  SELECT dst FROM cone JOIN part ON node = p_partkey JOIN arcs ON src = node WHERE p_size % 10 <> 0 OR node = (SELECT max(p_partkey) FROM part))
SELECT node, p_size % 10 = 0 AND node <> (SELECT max(p_partkey) FROM part) AS boundary FROM cone JOIN part ON node = p_partkey""")
def backward_cone(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    cone = graph.reach(part_arcs(spark, sf_dir), _last_part(spark, sf_dir), through=parts.where("p_size % 10 <> 0"))
    return cone.join(parts, "node").select("node", ((F.col("p_size") % 10 == 0) & (F.col("hop") > 0)).alias("boundary"))


@query("dependency_graph", f"""WITH RECURSIVE {_ARCS}, size AS (SELECT p_partkey AS k, p_size % 10 = 0 AS flop FROM part),
w AS (SELECT k AS root, dst AS node FROM size JOIN arcs ON src = k WHERE flop UNION SELECT root, dst FROM w JOIN size ON node = k JOIN arcs ON src = node WHERE NOT flop)
SELECT root AS flop, node AS source FROM w JOIN size ON node = k WHERE flop""")
def dependency_graph(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    flops, arcs = parts.where("p_size % 10 = 0"), part_arcs(spark, sf_dir)
    starts = flops.select(F.col("node").alias("root"), "node")
    cones = graph.reach(arcs, starts, through=parts.where("p_size % 10 <> 0"))
    return cones.where("hop > 0").join(flops, "node", "left_semi").select(F.col("root").alias("flop"), F.col("node").alias("source"))


_BUFFERS = f"parents AS (SELECT p_partkey AS node, CASE WHEN p_size < 10 AND p_partkey >= {INPUTS} THEN (p_partkey - 1) // 2 END AS parent FROM part)"


def _buffers(spark, sf_dir):
    passes = (F.col("p_size") < 10) & (F.col("p_partkey") >= INPUTS)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(passes, F.expr("(p_partkey - 1) div 2")).alias("parent"))


@query("pointer_source", f"""WITH RECURSIVE {_BUFFERS}, w AS (SELECT node, node AS place, 0 AS dist FROM parents UNION ALL SELECT w.node, p.parent, dist + 1 FROM w JOIN parents p ON w.place = p.node WHERE p.parent IS NOT NULL)
SELECT node, arg_max(place, dist) AS root, max(dist) AS dist FROM w GROUP BY node""")
def pointer_source(spark, sf_dir):
    return graph.pointer_roots(_buffers(spark, sf_dir))


@query("buffer_path", f"""WITH RECURSIVE {_BUFFERS}, w AS (SELECT node, node AS place, 0 AS hop FROM parents UNION ALL SELECT w.node, p.parent, hop + 1 FROM w JOIN parents p ON w.place = p.node WHERE p.parent IS NOT NULL)
SELECT node AS start, place AS via, hop FROM w WHERE hop > 0""")
def buffer_path(spark, sf_dir):
    parents = _buffers(spark, sf_dir)
    arcs = parents.where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    starts = parents.where("parent IS NOT NULL").select(F.col("node").alias("root"), "node")
    return graph.reach(arcs, starts).where("hop > 0").select(F.col("root").alias("start"), F.col("node").alias("via"), "hop")


#: Orders hang below order (k - 1) div 2 where both have one status.
_LINKS = "links AS (SELECT c.o_orderkey AS node, p.o_orderkey AS parent FROM orders c JOIN orders p ON p.o_orderkey = (c.o_orderkey - 1) // 2 AND c.o_orderkey > 0 AND c.o_orderstatus = p.o_orderstatus)"
_CHAINS = f"""{_LINKS}, single AS (SELECT parent, min(node) AS node FROM links GROUP BY parent HAVING count(*) = 1),
w AS (SELECT o_orderkey AS node, o_orderkey AS head, 0 AS rank FROM orders WHERE o_orderkey NOT IN (SELECT node FROM links) UNION ALL SELECT s.node, w.head, rank + 1 FROM w JOIN single s ON s.parent = w.node),
chain AS (SELECT node, head, rank FROM w UNION ALL SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT node FROM w))"""


def _links(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus")
    child = orders.where("node > 0").withColumn("parent", F.expr("(node - 1) div 2"))
    parent = orders.select(F.col("node").alias("parent"), "o_orderstatus")
    return child.join(parent, ["parent", "o_orderstatus"]).select("node", "parent"), orders.select("node")


@query("chains", f"WITH RECURSIVE {_CHAINS} SELECT node, head, rank FROM chain")
def chains(spark, sf_dir):
    return graph.chains(*_links(spark, sf_dir))


@query("strict_chains", f"""WITH RECURSIVE {_CHAINS}, kids AS (SELECT parent, count(*) AS n FROM links GROUP BY parent),
g AS (SELECT head, count(*) AS width, count(DISTINCT o_orderpriority) AS resets, count(DISTINCT o_custkey % 3) AS enables, max(coalesce(n, 0)) AS kids
  FROM chain JOIN orders ON node = o_orderkey LEFT JOIN kids ON parent = node GROUP BY head)
SELECT head, width, concat_ws('; ', CASE WHEN kids > 1 THEN 'chain branches' END, CASE WHEN enables > 1 THEN 'stages do not share one enable net' END,
  CASE WHEN resets > 1 THEN 'stages do not share one reset net' END, CASE WHEN width < 2 THEN 'fewer than two stages' END) AS reasons FROM g""")
def strict_chains(spark, sf_dir):
    links, nodes = _links(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("reset"), (F.col("o_custkey") % 3).alias("enable"))
    checked = motifs.strict_chains(graph.chains(links, nodes), links, orders, {"enable": "stages do not share one enable net", "reset": "stages do not share one reset net"})
    return checked.select("head", "width", F.array_join("reasons", "; ").alias("reasons"))


#: Customers of one block of ten lead to each other.
_RING = "arcs AS (SELECT c_custkey AS src, c_custkey // 10 * 10 + (c_custkey * 3 + c_nationkey) % 10 AS dst FROM customer UNION SELECT c_custkey, c_custkey // 10 * 10 + (c_custkey * c_nationkey) % 10 FROM customer WHERE c_nationkey % 2 = 0)"


def _rings(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    base = F.expr("c_custkey div 10 * 10")
    first = customers.select(F.col("c_custkey").alias("src"), (base + (F.col("c_custkey") * 3 + F.col("c_nationkey")) % 10).alias("dst"))
    more = customers.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("src"), (base + (F.col("c_custkey") * F.col("c_nationkey")) % 10).alias("dst"))
    return customers.select(F.col("c_custkey").alias("node")), first.union(more).distinct()


_REACH = f"{_RING}, w AS (SELECT src, dst FROM arcs UNION SELECT w.src, a.dst FROM w JOIN arcs a ON w.dst = a.src)"


@query("scc", f"""WITH RECURSIVE {_REACH} SELECT c_custkey AS node, greatest(c_custkey, coalesce((SELECT max(a.dst) FROM w a JOIN w b ON a.dst = b.src AND b.dst = a.src WHERE a.src = c_custkey), c_custkey)) AS component FROM customer""")
def scc(spark, sf_dir):
    return graph.strongly_connected(*_rings(spark, sf_dir))


@query("scc_inventory", f"""WITH RECURSIVE {_REACH}, c AS (SELECT c_custkey AS node, greatest(c_custkey, coalesce((SELECT max(a.dst) FROM w a JOIN w b ON a.dst = b.src AND b.dst = a.src WHERE a.src = c_custkey), c_custkey)) AS component FROM customer)
SELECT size, count(*) AS n, min(component) AS example FROM (SELECT component, count(*) AS size FROM c GROUP BY component) GROUP BY size""")
def scc_inventory(spark, sf_dir):
    sizes = graph.strongly_connected(*_rings(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"), F.min("component").alias("example"))


@query("cycle_check", f"WITH RECURSIVE {_REACH}, loops AS (SELECT src FROM w WHERE src = dst) SELECT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT src FROM loops) OR c_custkey IN (SELECT dst FROM w WHERE src IN (SELECT src FROM loops))")
def cycle_check(spark, sf_dir):
    return graph.levels(*_rings(spark, sf_dir)).where("level IS NULL").select("node")


@query("validation_issues", f"""WITH RECURSIVE {_ARCS}, faulty AS (SELECT * FROM arcs WHERE NOT (src % 97 = 0)), loads AS (SELECT dst, count(*) AS n FROM arcs GROUP BY dst)
SELECT 'unknown model' AS issue, p_partkey AS node FROM part WHERE p_size > 48
UNION ALL SELECT 'unknown pin', p_partkey FROM part WHERE p_type = 'PROMO' AND p_size < 3
UNION ALL SELECT 'several drivers', dst FROM loads WHERE n > 4
UNION ALL SELECT 'not loaded', p_partkey FROM part WHERE p_partkey NOT IN (SELECT dst FROM arcs) AND p_partkey < (SELECT max(p_partkey) FROM part) // 2
UNION ALL SELECT 'undriven', p_partkey FROM part WHERE p_partkey >= {INPUTS} AND p_partkey NOT IN (SELECT src FROM faulty)""")
def validation_issues(spark, sf_dir):
    parts, arcs = load(spark, sf_dir, "part"), part_arcs(spark, sf_dir)
    node = F.col("p_partkey").alias("node")
    half = parts.agg(F.max("p_partkey")).scalar()
    drivers = arcs.where("src % 97 <> 0")
    checks = {
        "unknown model": parts.where("p_size > 48").select(node),
        "unknown pin": parts.where("p_type = 'PROMO' AND p_size < 3").select(node),
        "several drivers": arcs.groupBy(F.col("dst").alias("node")).count().where("count > 4").select("node"),
        "not loaded": parts.join(arcs, F.col("p_partkey") == F.col("dst"), "left_anti").where(F.col("p_partkey") < F.floor(half / 2)).select(node),
        "undriven": parts.where(F.col("p_partkey") >= INPUTS).join(drivers, F.col("p_partkey") == F.col("src"), "left_anti").select(node),
    }
    return motifs.issues(checks)


_BOXES = "SELECT s_suppkey AS box, s_nationkey % 2 AS layer, s_suppkey % 45 AS x0, s_suppkey % 45 + 4 AS x1, 900 + (s_suppkey * 37) % 180 AS y0, 920 + (s_suppkey * 37) % 180 AS y1 FROM supplier"


def _boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(k.alias("box"), (F.col("s_nationkey") % 2).alias("layer"), (k % 45).alias("x0"), (k % 45 + 4).alias("x1"), (900 + k * 37 % 180).alias("y0"), (920 + k * 37 % 180).alias("y1"))


def _points(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("point"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))


@query("point_in_region", f"SELECT p_partkey AS point, min(box) AS box FROM part LEFT JOIN ({_BOXES}) ON p_size BETWEEN x0 AND x1 AND p_retailprice BETWEEN y0 AND y1 GROUP BY p_partkey")
def point_in_region(spark, sf_dir):
    return geometry.first_region(_points(spark, sf_dir), _boxes(spark, sf_dir).drop("layer"), 20).select("point", "box")


@query("stitch_two_layers", f"""WITH b AS ({_BOXES}), hit AS (SELECT p_partkey, bool_or(layer = 0) AS low, bool_or(layer = 1) AS high FROM part JOIN b ON p_size BETWEEN x0 AND x1 AND p_retailprice BETWEEN y0 AND y1 GROUP BY 1)
SELECT (SELECT count(*) FROM part) AS total, count(*) AS stitched FROM hit WHERE low AND high""")
def stitch_two_layers(spark, sf_dir):
    points, boxes = _points(spark, sf_dir), _boxes(spark, sf_dir)
    for layer in (0, 1):
        points = geometry.first_region(points, boxes.where(F.col("layer") == layer).drop("layer"), 20).withColumnRenamed("box", f"box{layer}")
    return points.agg(F.count("*").alias("total"), F.count_if(F.col("box0").isNotNull() & F.col("box1").isNotNull()).alias("stitched"))


@query("touching_regions", f"""WITH RECURSIVE b AS ({_BOXES}), t AS (SELECT a.box AS u, c.box AS v FROM b a JOIN b c ON a.layer = c.layer AND a.box <> c.box AND least(a.x1, c.x1) >= greatest(a.x0, c.x0) AND least(a.y1, c.y1) >= greatest(a.y0, c.y0)
  AND (least(a.x1, c.x1) > greatest(a.x0, c.x0) OR least(a.y1, c.y1) > greatest(a.y0, c.y0))),
w AS (SELECT box AS node, box AS seen FROM b UNION SELECT w.node, t.v FROM w JOIN t ON w.seen = t.u) SELECT node AS box, min(seen) AS region FROM w GROUP BY node""")
def touching_regions(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    merged = graph.connected_components(geometry.linked(boxes, 20))
    return boxes.select("box").join(merged, F.col("box") == F.col("node"), "left").select("box", F.coalesce("root", "box").alias("region"))


#: Squares that stand on a corner, some hundred to a thousand a side; (x + y, x - y) turns them into upright boxes of whole numbers.
_DIAMONDS = "SELECT p_partkey AS id, 3 * (p_partkey % 50) + p_partkey * 7 % 5 AS cx, 3 * (p_partkey // 50) + p_partkey * 11 % 5 AS cy, 1 + p_partkey * 13 % 2 AS r FROM part"


def _diamonds(spark, sf_dir):
    k = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").select(k.alias("id"), (3 * (k % 50) + k * 7 % 5).cast("double").alias("cx"), (3 * F.expr("p_partkey div 50") + k * 11 % 5).cast("double").alias("cy"), (1 + k * 13 % 2).cast("double").alias("r"))
    x, y, r = F.col("cx"), F.col("cy"), F.col("r")
    corners = [(x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    return rows.select("id", F.lit(0).alias("layer"), F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]).alias("ring"))


@query("merged_rings", f"""WITH RECURSIVE d AS ({_DIAMONDS}), b AS (SELECT id, cx + cy - r AS u0, cx + cy + r AS u1, cx - cy - r AS v0, cx - cy + r AS v1 FROM d),
t AS (SELECT a.id AS x, c.id AS y FROM b a JOIN b c ON a.id <> c.id AND least(a.u1, c.u1) >= greatest(a.u0, c.u0) AND least(a.v1, c.v1) >= greatest(a.v0, c.v0) AND (least(a.u1, c.u1) > greatest(a.u0, c.u0) OR least(a.v1, c.v1) > greatest(a.v0, c.v0))),
w AS (SELECT id, id AS seen FROM b UNION SELECT w.id, t.y FROM w JOIN t ON w.seen = t.x), root AS (SELECT id, min(seen) AS region FROM w GROUP BY id),
cells AS (SELECT DISTINCT region, u, v FROM b JOIN root USING (id), unnest(range(u0, u1)) AS p(u), unnest(range(v0, v1)) AS q(v)), sizes AS (SELECT region, count(*) / 2.0 AS area FROM cells GROUP BY region)
SELECT id, region, CAST(area AS DOUBLE) AS area FROM root JOIN sizes USING (region)""")
def merged_rings(spark, sf_dir):
    """Rings with slanted edges, OR-merged: each one's region, called by its least ring, and the region's area."""
    pieces = ordered.numbered_all(geometry.cut_rings(_diamonds(spark, sf_dir), "id", "layer"), ["id", *geometry.BOX, *geometry.SLANTED], "box")
    merged = cut(geometry.regions(pieces, 4.0), "regions")
    sizes = geometry.areas(merged, 16.0).join(merged.groupBy("region").agg(F.min("id").alias("least")), "region")
    rings = merged.select("id", "region").distinct()
    return rings.join(sizes, "region").select("id", F.col("least").alias("region"), F.round("area", 6).alias("area"))


@query("points_in_rings", f"SELECT c_custkey AS point, id FROM (SELECT c_custkey, (c_custkey * 31) % 150 + 0.25 AS x, (c_custkey * 17) % 90 + 0.125 AS y FROM customer) JOIN ({_DIAMONDS}) ON abs(x - cx) + abs(y - cy) < r")
def points_in_rings(spark, sf_dir):
    k = F.col("c_custkey")
    points = load(spark, sf_dir, "customer").select(k.alias("point"), (k * 31 % 150 + 0.25).alias("x"), (k * 17 % 90 + 0.125).alias("y"))
    return geometry.rings_at(points, _diamonds(spark, sf_dir), 4.0)


_SCALES = "SELECT s_suppkey AS box, s_suppkey % 45 AS x0, s_suppkey % 45 + (1 << (s_suppkey % 11)) // 16 AS x1, 900 + s_suppkey % 180 AS y0, 900 + s_suppkey % 180 + (1 << (s_suppkey * 7 % 11)) AS y1 FROM supplier"


@query("boxes_of_every_size", f"SELECT p_partkey AS point, count(box) AS n, min(box) AS box FROM part LEFT JOIN ({_SCALES}) ON p_size BETWEEN x0 AND x1 AND p_retailprice BETWEEN y0 AND y1 GROUP BY p_partkey")
def boxes_of_every_size(spark, sf_dir):
    """Points in boxes from one tile to the whole plane; a box has four copies at most."""
    k = F.col("s_suppkey")
    wide, high = (F.call_function("shiftleft", F.lit(1), (e % 11).cast("int")) for e in (k, k * 7))
    boxes = load(spark, sf_dir, "supplier").select(k.alias("box"), (k % 45).alias("x0"), (k % 45 + F.floor(wide / 16)).alias("x1"), (900 + k % 180).alias("y0"), (900 + k % 180 + high).alias("y1"))
    return geometry.counted(_points(spark, sf_dir), boxes, 4.0).select("point", "n", "box")
