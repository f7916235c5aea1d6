"""From layout shapes to nets: regions, via stitching, pins, ports, canonical names, diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import geometry, graph, ordered
from netloom.shared import cut

#: Fixed layers: conductors' names and (layer, datatype) from low to high, the cuts between neighbours, pin and port labels.
NAMES = ("li1", "met1", "met2", "met3", "met4", "met5")
CONDUCTORS = ((67, 20), (68, 20), (69, 20), (70, 20), (71, 20), (72, 20))
CUTS = ((67, 44), (68, 44), (69, 44), (70, 44), (71, 44))
PIN_LABELS = ((67, 5), (68, 5))
PORT_LABELS = ((67, 5), (68, 5), (69, 5), (70, 5), (71, 5), (72, 5))


def _on(layers):
    """Place of (layer, datatype) in ``layers``, or null."""
    wanted = [F.when((F.col("layer") == a) & (F.col("datatype") == b), F.lit(i)) for i, (a, b) in enumerate(layers)]
    return F.coalesce(*wanted)


@dataclass
class Extraction:
    """nets (net, aliases, terminals), unresolved (kind, name), stitches (low, high, total, stitched)."""

    nets: DataFrame
    unresolved: DataFrame
    stitches: DataFrame


def extract(shapes: DataFrame, labels: DataFrame, instances: DataFrame, tile: float = 10.0) -> Extraction:
    """``shapes`` (layer, datatype, ring) and ``labels`` (instance or null for a port, text, layer, datatype, x, y) in chip
    coordinates; ``instances`` (instance) are those whose pins count.

    Shapes may be any rings; they are cut into trapezoids, and touching ones of one sheet are one region. A cut whose box
    centre lies in a region below and one above joins them. A label names the first region that holds it. A pin or a port name on two nets raises. A net is called by its port
    names, joined by ``|``; the others are numbered in the order of their terminals.
    """

    sheets = shapes.withColumn("layer", _on(CONDUCTORS)).where("layer IS NOT NULL").select("layer", "ring")
    boxes = cut(ordered.numbered_all(geometry.cut_rings(sheets, "layer"), ["layer", *geometry.BOX, *geometry.SLANTED], "box"), "boxes")
    touch = geometry.touching(boxes, tile)
    middle = shapes.withColumn("low", _on(CUTS)).where("low IS NOT NULL").select("low", *geometry.bounds(F.col("ring")))
    cuts = cut(ordered.numbered_all(middle.select("low", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), ["low", "x", "y"], "point"), "cuts")
    below = geometry.first_region(cuts.withColumn("layer", F.col("low")), boxes, tile).select("point", "low", F.col("box").alias("u"))
    above = geometry.first_region(cuts.withColumn("layer", F.col("low") + 1), boxes, tile).select("point", F.col("box").alias("v"))
    stitched = cut(below.join(above, "point"), "stitches")
    stitches = stitched.groupBy("low").agg(F.count("*").alias("total"), F.count_if(F.col("u").isNotNull() & F.col("v").isNotNull()).alias("stitched")).select("low", (F.col("low") + 1).alias("high"), "total", "stitched")
    roots = graph.connected_components(touch.unionByName(stitched.select("u", "v").dropna()))
    region = boxes.select("box").join(roots, F.col("box") == F.col("node"), "left").select("box", F.coalesce("root", "box").alias("root"))

    def located(rows: DataFrame, layers) -> DataFrame:
        at = ordered.numbered_all(rows.withColumn("layer", _on(layers)).where("layer IS NOT NULL").select("name", "layer", "x", "y"), ["name", "layer", "x", "y"], "point")
        return geometry.first_region(at, boxes, tile).join(region, "box", "left").select("name", "root")

    pins = cut(located(labels.join(instances, "instance", "left_semi").withColumn("name", F.concat_ws(".", "instance", "text")), PIN_LABELS), "pins")
    ports = cut(located(labels.where("instance IS NULL").withColumnRenamed("text", "name"), PORT_LABELS), "ports")
    for what, rows in (("pin", pins), ("port", ports)):
        twice = rows.groupBy("name").agg(F.count_distinct("root").alias("n")).where("n > 1").orderBy("name").first()
        if twice:
            raise ValueError(f"{what} {twice.name} touches {twice.n} nets")
    members = pins.dropna().groupBy("root").agg(F.array_sort(F.collect_set("name")).alias("terminals"))
    aliases = ports.dropna().groupBy("root").agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    none = F.array().cast("array<string>")
    nets = members.join(aliases, "root", "full").select(F.coalesce("aliases", none).alias("aliases"), F.coalesce("terminals", none).alias("terminals"))
    nets = cut(nets, "nets")
    inner = ordered.numbered_all(nets.where("size(aliases) = 0"), ["terminals"]).select(F.format_string("n%04d", "number").alias("net"), "aliases", "terminals")
    named = nets.where("size(aliases) > 0").select(F.array_join("aliases", "|").alias("net"), "aliases", "terminals").unionByName(inner)
    lost = pins.where("root IS NULL").select(F.lit("pin").alias("kind"), "name").unionByName(ports.where("root IS NULL").select(F.lit("port").alias("kind"), "name")).distinct()
    number = F.row_number().over(Window.partitionBy("kind").orderBy("name")) - 1
    return Extraction(named, lost.select("kind", "name", F.format_string("unresolved_%04d", number).alias("net")), stitches)
