"""Token counts as delta-maintained rollups.

A change is a signed fact: an insert adds a document and its tokens, a delete takes them away, and a revised count adds
the difference. A batch of changes is added up by (source, lang, tokenizer version) and written to a folder of its own;
one row in the commit log then makes it count. A batch id counts once: a committed batch is skipped, a batch that failed
before its commit row leaves files that nothing reads, and if two writers commit one id at once, the first path in order
counts, for totals and snapshots alike. ``compact`` adds committed batches up to one snapshot, from one reading of the log:
a batch that comes in meanwhile is not in the snapshot and stays as it is. The snapshot names the paths that it replaces,
and its batch ids stay known, so late retries are still skipped. ``totals`` takes the paths from the log to one scan; the
log has a row a batch since the last snapshot, and is meant to be compacted.

Totals are sums of what batches wrote, never a recount. Keys are few, so sums are partial before the shuffle.

Defined results: null source, lang or version is a key of its own; a null count is 0 tokens; an unknown kind of change
fails the batch; an empty batch commits nothing but its id; very long texts are counted whole. ``roll_up_documents``
deletes of equal texts all but one row, that of the smallest id (null ids last), whatever their ids; a null text has no
copies; extra columns are left out.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import cut, shared_folder, with_columns

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
COMMIT = "batch string, path string, covers array<string>, replaces array<string>"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes``: KEYS, kind (insert, delete, revise), n_tokens, old_tokens (of a revision)."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    tokens = F.when(F.col("kind") == "revise", n - old).otherwise(docs * n)
    known = F.when(docs.isNull(), F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null"))))).otherwise(docs)
    return changes.select(*KEYS, known.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens")).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Additive token totals in ``folder`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")

    def _add(self, batch: str, path: str, covers: list[str], replaces: list[str]) -> None:
        self.spark.createDataFrame([(batch, path, covers, replaces)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def committed(self, batch: str) -> bool:
        return not self._log().where((F.col("batch") == batch) | F.array_contains("covers", batch)).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Count ``changes`` under the id ``batch``; False if that id counts already. Fits foreachBatch."""
        if self.committed(batch):
            return False
        path = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(path)
        self._add(batch, path, [], [])
        return True

    def live(self) -> list[tuple[str, str, tuple[str, ...]]]:
        """(batch, path, covered ids) of what counts, by one reading of the log.

        Snapshots go first, the widest before those that it took in; what one replaces is out, and so is a batch whose id
        counts already, by a snapshot or by an earlier path in order (a second writer)."""
        rows = [(r.batch, r.path, tuple(r.covers or ()), tuple(r.replaces or ())) for r in self._log().collect()]
        out, known, replaced = [], set(), set()
        for batch, path, covers, gone in sorted(rows, key=lambda r: (-len(r[2]), r[1])):
            if path not in replaced and batch not in known and known.isdisjoint(covers):
                known |= {batch, *covers}
                replaced |= set(gone)
                out.append((batch, path, covers))
        return out

    def _sum(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return read.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches; keys without documents and tokens are left out."""
        return self._sum([path for _, path, _ in self.live()])

    def compact(self) -> None:
        """Replace all committed batches by one snapshot of their sums."""
        live = self.live()
        if len(live) > 1:
            path = f"{self.folder}/deltas/{uuid.uuid4().hex}"
            self._sum([p for _, p, _ in live]).coalesce(1).write.parquet(path)
            self._add(f"snapshot-{uuid.uuid4().hex}", path, [b for batch, _, covers in live for b in (batch, *covers)], [p for _, p, _ in live])


def unique_lines(text: str) -> str:
    """The text without lines that repeat an earlier one."""
    return "\n".join(dict.fromkeys(text.split("\n")))


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``docs`` with n_tokens of the text, and n_unique_line_tokens of the text without its repeated lines."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work(texts):
        import tiktoken

        if not hasattr(work, "encode"):
            ranks, pattern = shared.value
            work.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole, unique = [], []
        for t in texts:
            text = (t or b"").decode("utf-8", "replace")
            whole.append(len(work.encode(text)))
            short = unique_lines(text)
            unique.append(whole[-1] if len(short) == len(text) else len(work.encode(short)))
        return [pa.array(whole, pa.int64()), pa.array(unique, pa.int64())]

    return with_columns(docs, "text", work, [T.StructField("n_tokens", T.LongType()), T.StructField("n_unique_line_tokens", T.LongType())])


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken vocabulary file."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def roll_up_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, version: str, folder: str | None = None) -> Rollup:
    """A rollup of ``docs`` kept by batches: all documents inserted; counts revised to texts without repeated lines;
    exact copies (all but the smallest id of equal texts) deleted; and the first batch sent again, which changes nothing.
    """
    spark = docs.sparkSession
    counted = count_tokens(docs.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), "text"), ranks, pattern).drop("text")
    counted = cut(counted.withColumn("version", F.lit(version)).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rollup = Rollup(spark, folder or f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    none = F.lit(None).cast("long")
    load = counted.select(*KEYS, F.lit("insert").alias("kind"), "n_tokens", none.alias("old_tokens"))
    rollup.commit("load", load)
    rollup.commit("revise", counted.where("n_unique_line_tokens <> n_tokens").select(*KEYS, F.lit("revise").alias("kind"), F.col("n_unique_line_tokens").alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    copies = cut(counted.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order)["row"].alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")  # apart from the join, so that a hot digest can be split
    rollup.commit("copies", counted.join(copies, "digest").where("row <> first").select(*KEYS, F.lit("delete").alias("kind"), F.col("n_unique_line_tokens").alias("n_tokens"), none.alias("old_tokens")))
    rollup.commit("load", load)
    return rollup
