"""The cluster's shared folder, and tables cut there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Writer's options for long rows: a task that writes or reads them holds a row group of 16 MB, not one of Parquet's 128 MB.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20)}
#: Folders made since the innermost open ``scratch``.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session without one gets a folder of its own; a cluster has to name a shared one."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{key} is not set, and executors of {master} share no folder of this machine")
        found = f"file://{tempfile.mkdtemp(prefix='netloom-')}"
        spark.conf.set(key, found)
    return found.rstrip("/")


def cut(df: DataFrame, what: str = "cut", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: short lineage that outlives lost executors. ``options`` are the writer's."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_told(df: DataFrame, what: str, **wanted: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and how many rows are ``wanted``, told by the write itself rather than by a second job."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.count_if(c).alias(k) for k, c in wanted.items()]), what)
    return out, {k: seen.get.get(k, 0) for k in wanted}


def cut_any(df: DataFrame, what: str, wanted: Column) -> tuple[DataFrame, bool]:
    """``cut``, and whether a row is ``wanted``."""
    out, told = cut_told(df, what, wanted=wanted)
    return out, told["wanted"] > 0


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from the store that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Delete what was cut inside at the end, but for the last ``keep`` tables; those count as made by the scratch outside."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        last = made[len(made) - keep :] if keep else []
        for path in made[: len(made) - len(last)]:
            delete(spark, path)
        if (outer := _made.get()) is not None:
            outer.extend(last)
