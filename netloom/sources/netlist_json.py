"""Netlists from JSON: the versioned form (schema_version 1) and the bare map of net to terminals.

A document is one record per file; nets become rows by a map schema, so net names never become columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.names import owner_and_pin

V1 = "schema_version int, nets map<string, struct<aliases: array<string>, terminals: array<string>>>"
POWER = ["VPWR", "VGND", "VPB", "VNB", "VDD", "VSS"]


def read_nets(spark: SparkSession, path: str) -> DataFrame:
    """(net, aliases, terminals) of the files at ``path``. A net of the bare form is internal if it starts with ``(``;
    else its name is its aliases, joined by ``|``. Other schema versions raise."""
    text = spark.read.text(path, wholetext=True)
    version = F.get_json_object("value", "$.schema_version")
    checked = F.when(version.isNull() | (version == "1"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("unsupported schema_version "), version)))
    text = text.select(checked.alias("value"), version.isNotNull().alias("tagged"))
    tagged = text.where("tagged").select(F.explode(F.from_json("value", V1, {"mode": "FAILFAST"})["nets"]).alias("net", "n")).select("net", "n.aliases", "n.terminals")
    bare = text.where("NOT tagged").select(F.explode(F.from_json("value", "map<string, array<string>>", {"mode": "FAILFAST"})).alias("net", "terminals"))
    names = F.when(F.col("net").startswith("("), F.array().cast("array<string>")).otherwise(F.split("net", r"\|"))
    return tagged.unionByName(bare.select("net", names.alias("aliases"), "terminals"))


def nets_of(read: DataFrame) -> DataFrame:
    """(net, aliases, is_port, is_power)."""
    power = F.array(*map(F.lit, POWER))
    return read.select("net", "aliases", (F.size("aliases") > 0).alias("is_port"), F.arrays_overlap("aliases", power).alias("is_power"))


def pins_of(read: DataFrame) -> DataFrame:
    """(net, instance, pin, ordinal): terminals split at the last dot, numbered in file order inside their net."""
    rows = read.select("net", F.posexplode("terminals").alias("ordinal", "terminal"))
    instance, pin = owner_and_pin(F.col("terminal"))
    good = F.when(F.col("terminal").rlike(r"^.+\.[^.]+$"), instance).otherwise(F.raise_error(F.concat(F.lit("no instance.pin: "), F.col("terminal"))))
    return rows.select("net", good.alias("instance"), pin.alias("pin"), "ordinal")


def repeated_terminals(pins: DataFrame) -> DataFrame:
    """(instance, pin, nets, times) of terminals on two nets, or twice on one."""
    return pins.groupBy("instance", "pin").agg(F.count_distinct("net").alias("nets"), F.count("*").alias("times")).where("times > 1")


def write_nets(nets: DataFrame, path: str) -> None:
    """The versioned form, as one JSON file a partition: rows (net, aliases, terminals) folded into one document."""
    entry = F.struct("net", F.struct("aliases", "terminals").alias("body"))
    folded = nets.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("nets"))).alias("value"))
    folded.write.mode("overwrite").text(path)
