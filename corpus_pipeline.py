"""The corpus pipeline: quality rules, language ID, SimHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. A stage's result is written as
Parquet in the shared folder and read back as the next one's input; what a stage cut on the way is then deleted, and in the end all but the last input.

Rows are kept and dropped one by one, whatever their ids: null and repeated ids are documents like any other. Null and
empty texts go in the first stage (too few words), as do short ones. Repeated rows are near copies, of which one stays;
ties go to the smallest id, then the smallest hash of the text. Very long texts are taken whole. Extra columns of ``docs``
are carried through the filters; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontaminate, langid, quality, registry, sentencepiece_wfst, simhash
from netloom.llm.common import cut, held_out, table
from netloom.shared import SMALL_GROUPS, scratch

#: A document goes if its main language has a smaller share, or if it has none.
MIN_LANGUAGE_SHARE = 0.5
#: Column of the row numbers inside a stage, and how many numbers may be broadcast.
ROW, BROADCAST_ROWS = "__row", 1 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality.quality(docs).where("kept").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of at least MIN_LANGUAGE_SHARE."""
    model = langid.train(docs.select("doc_id", "text", "lang").where(~held_out()))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for each row, written once: ids can be null or stand twice."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered", SMALL_GROUPS)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but those whose numbers are in ``gone`` (written). Up to BROADCAST_ROWS numbers, of eight bytes each, go to
    every task, and texts are not shuffled; more are joined by shuffle, with the same rows."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ROW, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, that of the smallest id; rows outside the group stay, whatever their id."""
    rows = _numbered(docs)
    with scratch(spark):
        first = simhash.first_rows(rows.select(F.col(ROW).alias("row"), "doc_id", "text"))
        gone = cut(rows.select(ROW).join(first.toDF(ROW), ROW, "left_anti"), "taken_out")
    return _without(rows, gone).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window, exact or within the operator's slack."""
    rows = _numbered(docs)
    with scratch(spark):
        hits = decontaminate.decontaminate(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        gone = cut(hits.where("contaminated OR size(near_items) > 0").select(F.col("doc_id").alias(ROW)), "taken_out")
    return _without(rows, gone).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, checked by decoding."""
    model = sentencepiece_wfst.read_model(f"{registry.TOKENIZERS}/piece_bpe_32k.model")
    return sentencepiece_wfst.encode(docs, model, keep_text=False).select("doc_id", "lang", "source", "ids", "n_ids", "n_byte_ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
#: Zstandard, expectation-maximisation and piece ids have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = cut(stage(spark, docs, sf_dir), name, SMALL_GROUPS)
    return STAGES[-1][1](spark, docs, sf_dir)
