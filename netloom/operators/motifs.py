"""Structural patterns: strict chains with reasons, issue lists, register motifs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_chains(chains: DataFrame, links: DataFrame, stages: DataFrame, uniform: dict[str, str]) -> DataFrame:
    """(head, width, reasons) of chains (node, head, rank).

    A chain is rejected if a member has several children in ``links``, if its ``stages`` (node and the columns of
    ``uniform``) differ in a column, null counted as a value, with that column's reason, or if it is a single stage.
    """
    kids = links.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    rows = chains.join(stages, "node").join(kids, "node", "left")
    kinds = [F.count_distinct(F.struct(c)).alias(f"_{c}") for c in uniform]
    found = rows.groupBy("head").agg(F.count("*").alias("width"), F.max(F.coalesce("kids", F.lit(0))).alias("_kids"), *kinds)
    reasons = [F.when(F.col("_kids") > 1, "chain branches"), *[F.when(F.col(f"_{c}") > 1, why) for c, why in uniform.items()], F.when(F.col("width") < 2, "fewer than two stages")]
    return found.select("head", "width", F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def issues(checks: dict[str, DataFrame]) -> DataFrame:
    """(issue, node) of every check's nodes."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(issue).alias("issue"), "node") for issue, rows in checks.items()])


def enabled_registers(flops: DataFrame, muxes: DataFrame) -> DataFrame:
    """(flop, mux, q_net, d_net, hold_pin, data_pin, data_net, select_net).

    ``flops`` (flop, d_net, q_net), ``muxes`` (mux, a0_net, a1_net, select_net, x_net): the mux that drives a flop's data
    and takes the flop's own output on one side. A0 is the hold side if both are.
    """
    own0 = F.col("a0_net") == F.col("q_net")
    met = flops.join(muxes, F.col("d_net") == F.col("x_net")).where(own0 | (F.col("a1_net") == F.col("q_net")))
    return met.select(
        "flop", "mux", "q_net", "d_net", F.when(own0, "A0").otherwise("A1").alias("hold_pin"), F.when(own0, "A1").otherwise("A0").alias("data_pin"), F.when(own0, F.col("a1_net")).otherwise(F.col("a0_net")).alias("data_net"), "select_net"
    )


def stage_links(registers: DataFrame) -> DataFrame:
    """(node, parent): a register whose data is another register's output."""
    sources = registers.select(F.col("flop").alias("parent"), F.col("q_net").alias("data_net"))
    return registers.join(sources, "data_net").where("flop <> parent").select(F.col("flop").alias("node"), "parent")


def classify_pairs(components: DataFrame, cones: DataFrame, thin_limit: int = 30) -> DataFrame:
    """(component, n_cells, kind) of components of two: reused (a mux and under ``thin_limit`` cells), thin, or fat.

    ``components`` (node, component); ``cones`` (node, cell, is_mux, is_state) lists the cells behind every member.
    """
    pairs = components.groupBy("component").agg(F.count("*").alias("size")).where("size = 2").select("component")
    cells = components.join(pairs, "component").join(cones, "node").groupBy("component").agg(F.count_distinct(F.when(~F.col("is_state"), F.col("cell"))).alias("n_cells"), F.bool_or("is_mux").alias("mux"))
    kind = F.when(F.col("n_cells") >= thin_limit, "fat").when(F.col("mux"), "reused").otherwise("thin")
    return cells.select("component", "n_cells", kind.alias("kind"))


def self_feedback(lines: DataFrame) -> DataFrame:
    """(owner, key, hold): for each owner and key of ``lines`` (owner, key, value) the least value of another owner's line of
    that key which is one of the owner's own values, or the owner itself.

    Whether there is another owner is told by the least and the greatest of each (key, value), so no pairs of lines are made
    and a key may have any number of them.
    """
    lines = lines.select("owner", "key", "value").distinct()
    owners = lines.groupBy("key", "value").agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
    shared = lines.join(owners.where("least < most").select("key", "value"), ["key", "value"]).select("owner", "key", F.col("value").alias("hold"))
    at_owner = owners.select("key", F.col("value").alias("owner"), "least", "most")
    fed = lines.select("owner", "key").distinct().join(at_owner, ["owner", "key"]).where("least <> owner OR most <> owner").select("owner", "key", F.col("owner").alias("hold"))
    return shared.unionByName(fed).groupBy("owner", "key").agg(F.min("hold").alias("hold"))
