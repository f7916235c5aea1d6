"""A layout's placed components, and its netlist with what could not be resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import report
from netloom.functions.cells import component_kind
from netloom.operators import ordered
from netloom.operators.extract import NAMES, PIN_LABELS, Extraction, extract
from netloom.shared import cut
from netloom.sources import gds


@dataclass
class Layout:
    """The elements of one stream and the name of its top cell."""

    source: str
    top: str
    elements: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str, top: str | None = None) -> Layout:
        """``top`` has to be given if no or several cells are not placed in another."""
        rows = cut(gds.read_runs(spark, path), "layout")
        tops = [r.cell for r in gds.top_cells(rows).orderBy("cell", "file").limit(1001).collect()]
        chosen = [t for t in tops if top is None or t == top]
        if len(chosen) != 1:
            raise ValueError(f"{'one top cell is wanted' if top is None else f'no single top cell {top}'}; the stream has: {', '.join(tops[:1000]) or 'none'}")
        return cls(path, chosen[0], rows)

    @property
    def own(self) -> DataFrame:
        """The top cell's own elements."""
        return self.elements.where(F.col("cell") == self.top)

    def components(self) -> DataFrame:
        """(ordinal, reference_index, instance, cell, kind, x, y, rotation, reflect) of what is placed in the top cell itself.
        Logic cells are U0, U1 ... in file order; each place of an array counts."""
        refs = self.own.where("kind = 'ref'").select("ordinal", F.col("ref").alias("cell"), component_kind(F.col("ref")).alias("kind"), F.col("ox").alias("x"), F.col("oy").alias("y"), "rotation", "reflect")
        indexed = ordered.numbered_all(refs, ["ordinal"], "reference_index")
        logic = ordered.numbered_all(refs.where("kind = 'logic'").select("ordinal"), ["ordinal"], "n").select("ordinal", F.format_string("U%d", "n").alias("instance"))
        return indexed.join(logic, "ordinal", "left").select("ordinal", "reference_index", "instance", "cell", "kind", "x", "y", "rotation", "reflect")

    def flat(self) -> DataFrame:
        """Boundaries and labels in the top cell's coordinates; ``ordinal`` is the component they belong to, or null."""
        top = gds.top_cells(self.elements).where(F.col("cell") == self.top)
        return gds.flatten(self.elements, top).withColumn("ordinal", F.get("path", F.lit(0)))

    def pins(self) -> DataFrame:
        """(ordinal, pins: name -> points) of components that have pin labels."""
        kinds = " OR ".join(f"(layer = {a} AND datatype = {b})" for a, b in PIN_LABELS)
        named = self.flat().where("kind = 'label' AND ordinal IS NOT NULL").where(kinds)
        points = named.groupBy("ordinal", "text").agg(F.array_sort(F.collect_list(F.array("x", "y"))).alias("points"))
        return points.groupBy("ordinal").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "points")))).alias("pins"))

    def inventory(self) -> DataFrame:
        """Logic components with their ``pins``, as ``report.document`` lines, keyed by instance."""
        logic = self.components().where("kind = 'logic'").join(self.pins(), "ordinal", "left")
        origin = F.array("x", "y").alias("origin_um")
        value = report.json_row("reference_index", "instance", "cell", "kind", origin, F.col("rotation").alias("rotation_rad"), F.col("reflect").alias("x_reflection"), "pins")
        return report.document(logic.sparkSession, {"components": logic.select(F.col("reference_index").alias("place"), value.alias("value"))})

    def netlist(self, tile: float = 10.0) -> Extraction:
        """``extract`` over the flattened top cell. Instances are logic components, ``U<n>_<cell>``; labels inside others
        count for nothing, and the top cell's own labels are ports."""
        logic = self.components().where("kind = 'logic'")
        gates = cut(logic.select("ordinal", F.concat_ws("_", "instance", F.element_at(F.split("cell", "__"), -1)).alias("instance")), "gates")
        flat = cut(self.flat(), "flat")
        shown = flat.where("kind = 'label'").select("ordinal", "text", "layer", "datatype", "x", "y")
        inner = shown.join(gates, "ordinal").select("instance", "text", "layer", "datatype", "x", "y")
        ports = shown.where("ordinal IS NULL").select(F.lit(None).cast("string").alias("instance"), "text", "layer", "datatype", "x", "y")
        return extract(flat.where("kind = 'boundary'").select("layer", "datatype", "ring"), inner.unionByName(ports), gates.select("instance"), tile)

    def document(self, found: Extraction) -> DataFrame:
        """The versioned netlist with diagnostics, as ``report.document`` lines. A pin in no region is a net of its own."""
        spark = self.elements.sparkSession
        lost = found.unresolved.where("kind = 'pin'").select("net", F.array().cast("array<string>").alias("aliases"), F.array("name").alias("terminals"))
        nets = found.nets.unionByName(lost).select(F.col("net").alias("key"), report.json_row("aliases", "terminals").alias("value"))

        def unresolved(kind):
            rows = found.unresolved.where(F.col("kind") == kind).select("name")
            return ordered.numbered_all(rows, ["name"], "place").select("place", report.json_name(F.col("name")).alias("value"))

        stacks = spark.createDataFrame([(i, f"{a}->{b}") for i, (a, b) in enumerate(zip(NAMES, NAMES[1:]))], "low int, stack string")
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "stitched")]
        cuts = stacks.join(found.stitches, "low", "left").select(F.col("stack").alias("key"), report.json_row(*counts).alias("value"))
        return report.document(spark, {
            "schema_version": 1, "source_gds": self.source, "top_cell": self.top, "nets": nets,
            "diagnostics": {"unresolved_pins": unresolved("pin"), "unresolved_ports": unresolved("port"), "via_cuts": cuts},
        })
