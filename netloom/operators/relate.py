"""Joins that resolve, enrich and compare relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_cascade(names: DataFrame, name: str, dims: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Value of ``name`` in the first of ``dims`` (kind, table, key, value) that holds it; kind and value null if none.

    Of several values of one key the smallest counts, null only if there is no other."""
    out = names
    for i, (_, table, key, value) in enumerate(dims):
        dim = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).groupBy(f"_k{i}").agg(F.min(f"_v{i}").alias(f"_v{i}"))
        out = out.join(dim, F.col(name) == F.col(f"_k{i}"), "left")
    kind = F.coalesce(*(F.when(F.col(f"_k{i}").isNotNull(), kind) for i, (kind, *_) in enumerate(dims)))
    value = F.coalesce(*(F.when(F.col(f"_k{i}").isNotNull(), F.col(f"_v{i}")) for i in range(len(dims))))
    return out.withColumns({"kind": kind, "value": value}).drop(*(f"_{c}{i}" for i in range(len(dims)) for c in "kv"))


def resolve_prefix(prefixes: list[str], names: DataFrame, name: str, mark: str = "_") -> DataFrame:
    """(prefix, n, first, status): exact name, the only name that starts with prefix + ``mark``, ambiguous or unknown."""
    wanted = F.explode(F.array(*[F.when((F.col(name) == p) | F.col(name).startswith(p + mark), F.lit(p)) for p in prefixes])).alias("prefix")
    hits = names.select(name, wanted).where("prefix IS NOT NULL")
    found = hits.groupBy("prefix").agg(F.count("*").alias("n"), F.min(name).alias("first"), F.bool_or(F.col(name) == F.col("prefix")).alias("exact"))
    asked = names.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    status = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    first = F.when(F.col("exact"), F.col("prefix")).otherwise(F.col("first"))
    return asked.join(found, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), first.alias("first"), status.alias("status"))


def having_one(rows: DataFrame, key: str, value: str, out: str = "driver") -> DataFrame:
    """(key, out): keys with exactly one distinct value."""
    return rows.groupBy(key).agg(F.min(value).alias(out), F.max(value).alias("_max")).where(F.col(out) == F.col("_max")).drop("_max")


def covering(rows: DataFrame, key: str, member: str, wanted: DataFrame) -> DataFrame:
    """Relational division: keys whose members include all of ``wanted`` (one column)."""
    need = wanted.distinct()
    column = need.columns[0]
    have = rows.select(key, member).distinct().join(F.broadcast(need) if need.count() <= 10_000 else need, F.col(member) == F.col(column), "left_semi")
    return have.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == need.count()).select(key)


def equal_sets(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(members, n, first): sets of members and the keys that share each."""
    sets = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n"), F.min(key).alias("first"))


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): left, right or both, by a full outer join of the sides' distinct keys."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side only, with how often (repeats count)."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def first_match(cases: list[tuple[str, Column]], default: str) -> Column:
    """The first case that holds."""
    return reduce(lambda acc, c: acc.when(c[1], c[0]), cases[1:], F.when(cases[0][1], cases[0][0])).otherwise(default)
