"""License scans by diagonal voting.

Every document's rolling word k-gram hashes are joined with the templates' k-gram positions; equal words confirm each
match. A match of document place p and template place t votes for the diagonal p - t. Votes are counted per diagonal,
neighbouring diagonals (insertions and deletions shift a copy by a few words) are merged into spans, and a span stands
if its confirmed k-grams cover enough of the template. Phrases and short notices, of under LONG_WORDS words, take grams of
SHORT_K words, license texts of LONG_K. A phrase must be covered whole. Of license texts that share a place and differ in
how much of them is covered, the better one stays.

Matching grams shuffle by document; the text does not. The template table is broadcast under a checked bound. Beyond it
the documents' grams are written once, only (row, place, hash) is shuffled to the templates, and matches are confirmed
against the written rows.

Defined results: null and empty texts have no words and no spans; very long texts are taken whole; a template of fewer
than SHORT_K words is refused; repeated rows each get a result; a place that two templates cover counts for both; columns
of ``docs`` other than doc_id are dropped.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import cut, with_columns, words

SHORT_K, LONG_K, LONG_WORDS = 2, 5, 20
KS = (SHORT_K, LONG_K)
#: Fixed phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed wording of license notices and grants, and the labels that the method adds.
NOTICES = {
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}
#: Folder of public license texts and notices; a file's name is its label.
TEXTS = Path(__file__).parent / "licence_texts"
#: Share of a notice's or text's grams that a span must confirm.
MIN_COVER = 0.75
#: Diagonals up to so many words apart, and matches up to so many words on, are one span.
MAX_SHIFT, MAX_GAP = 3, 12
#: Template grams that may be broadcast; an argument of ``scan``.
MAX_BROADCAST_GRAMS = 100_000
#: Bytes of words whose hashes a Python worker keeps.
CACHE_BYTES = 16 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    size = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.size += len(word) + 100
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = len(word) + 100
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def gram_hashes(found: list[bytes], store: dict, k: int) -> np.ndarray:
    """Rolling hashes of every k consecutive words."""
    h = np.fromiter(map(store.__getitem__, found), np.uint64, len(found))
    if len(h) < k:
        return np.empty(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * MULTIPLIER + h[i : i + len(out)]
    return out.view(np.int64)


def default_templates() -> list[tuple[str, str, str]]:
    """(kind, words, label) of the base phrases, the notices and the license texts."""
    texts = [("text", f.read_text(), f.stem) for f in sorted(TEXTS.glob("*.txt"))]
    return [("phrase", p, label) for p, label in BASE.items()] + [("notice", p, label) for p, label in NOTICES.items()] + texts


def templates(spark: SparkSession, phrases: list[tuple[str, str, str]]) -> DataFrame:
    """(template, kind, label, n_words, n_grams, place, hash, gram) of (kind, words, label) rows."""
    store, rows = _WordHashes(), []
    for i, (kind, phrase, label) in enumerate(phrases):
        found = words(phrase.encode())
        if len(found) < SHORT_K:
            raise ValueError(f"{phrase!r} has fewer than {SHORT_K} words")
        k = SHORT_K if kind == "phrase" or len(found) < LONG_WORDS else LONG_K
        for place, h in enumerate(gram_hashes(found, store, k).tolist()):
            rows.append((i, kind, label, k, len(found) - k + 1, place, h, " ".join(w.decode() for w in found[place : place + k])))
    return spark.createDataFrame(rows, "template int, kind string, label string, k int, n_grams int, place int, hash long, gram string")


def grams(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with row (its number), n_words, its words, and the hash and place of every gram of KS words."""

    def work(texts):
        from pyspark import TaskContext

        store = work.store = getattr(work, "store", None) or _WordHashes()
        base = work.rows = getattr(work, "rows", TaskContext.get().partitionId() << 40)
        work.rows += len(texts)
        found = [words(text or b"") for text in texts]
        hashes = [[gram_hashes(f, store, k) for k in KS] for f in found]
        offsets = pa.array(np.cumsum([0, *(sum(map(len, h)) for h in hashes)]), pa.int32())
        flat = [np.concatenate([np.empty(0, t), *x]) for t, x in ((np.int64, [h for each in hashes for h in each]), (np.int32, [np.arange(len(h), dtype=np.int32) for each in hashes for h in each]))]
        spoken = pa.array([w for f in found for w in f], pa.binary()).cast(pa.string())
        by_doc = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), spoken)
        return [pa.array(range(base, base + len(texts)), pa.int64()), pa.array(list(map(len, found)), pa.int64()), by_doc, *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat)]

    fields = [T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]
    fields += [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    return with_columns(docs.select("doc_id", "text"), "text", work, fields).drop("text")


def _is_gram(at: Column) -> Column:
    """Whether the words from place ``at`` on are those of the template's gram. Words are looked up, the text is not cut again."""
    return F.array_join(F.slice("words", at + 1, F.col("k")), " ") == F.col("gram")


MATCH = ["row", "doc_id", "n_words", "template", "kind", "label", "k", "n_grams", "place", "at"]


def matches(docs: DataFrame, table: DataFrame, broadcast_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """MATCH columns of every confirmed gram, and one row of template -1 for each document."""
    found = grams(docs)
    if table.count() > broadcast_grams:
        return _matches_by_shuffle(cut(found, "grams"), table)
    begin = table.limit(1).select(F.lit(-1).alias("template"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("k"), F.lit(0).alias("n_grams"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("hash"), F.lit("").alias("gram"))
    every = F.broadcast(table.unionByName(begin).withColumn("hash", F.coalesce("hash", F.lit(0))))
    rolled = found.select("row", "doc_id", "n_words", "words", "places", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "hashes")).alias("pos", "hash"))
    at = F.get("places", F.col("pos") - 1)
    hit = rolled.join(every, "hash").where(((F.col("pos") == 0) & (F.col("template") == -1)) | ((F.col("pos") > 0) & (F.col("template") >= 0) & _is_gram(at)))
    return hit.withColumn("at", at).select(*MATCH)


def _matches_by_shuffle(found: DataFrame, table: DataFrame) -> DataFrame:
    rolled = found.select("row", F.posexplode("hashes").alias("i", "hash"))
    met = cut(rolled.join(table, "hash").drop("hash"), "met")
    confirmed = met.join(found.drop("hashes"), "row").withColumn("at", F.get("places", F.col("i"))).where(_is_gram(F.col("at"))).select(*MATCH)
    none = {"template": F.lit(-1), "kind": F.lit(""), "label": F.lit(None).cast("string"), "k": F.lit(0), "n_grams": F.lit(0), "place": F.lit(0), "at": F.lit(None).cast("int")}
    return confirmed.unionByName(found.select("row", "doc_id", "n_words").withColumns(none))


def spans(hits: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """Standing spans: row, template, kind, label, first_word, end_word (exclusive), cover, votes."""
    diagonal = hits.where("template >= 0").withColumn("diagonal", F.col("at") - F.col("place"))
    voted = diagonal.groupBy("row", "template", "kind", "label", "k", "n_grams", "diagonal").agg(
        F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("places")
    )
    # phrases stand on one diagonal; notices on runs of neighbouring ones
    order = Window.partitionBy("row", "template").orderBy("low", "diagonal")
    far = (F.col("kind") == "phrase") | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > MAX_SHIFT) | (F.col("low") - F.lag("high").over(order) > MAX_GAP)
    run = F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order)
    merged = (
        voted.withColumn("run", run)
        .groupBy("row", "template", "kind", "label", "k", "n_grams", "run")
        .agg(F.sum("votes").alias("votes"), F.min("low").alias("first_word"), (F.max("high") + F.col("k")).alias("end_word"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"))
    )
    cover = merged.withColumn("cover", F.col("seen") / F.col("n_grams"))
    return cover.where(F.when(F.col("kind") == "phrase", F.col("cover") == 1).otherwise(F.col("cover") >= min_cover)).drop("run", "seen")


def standing_texts(first: list[int], end: list[int], cover: list[float]) -> list[bool]:
    """Whether no span that shares a place with a span covers more of its template: one sweep over the places, which compares
    a span with those only that are still open where it starts."""
    stand, open_ = [True] * len(first), []
    for i in sorted(range(len(first)), key=first.__getitem__):
        open_ = [j for j in open_ if end[j] > first[i]]
        for j in open_:
            if cover[j] > cover[i]:
                stand[i] = False
            elif cover[i] > cover[j]:
                stand[j] = False
        open_.append(i)
    return stand


def scan(docs: DataFrame, phrases: list[tuple[str, str, str]] | None = None, min_cover: float = MIN_COVER, broadcast_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """One row per document: n_words, spans (label, kind, first_word, end_word, cover), and the digest columns n_base,
    first_word, last_word, base_labels, labels and score (the best cover of a standing span, else 0).
    """
    table = templates(docs.sparkSession, default_templates() if phrases is None else phrases)
    hits = cut(matches(docs, table, broadcast_grams), "grams").repartition("row")  # numbered rows, so written once
    standing = spans(hits, min_cover)
    rows = hits.where("template = -1").select("row", "doc_id", "n_words").withColumn("span", F.lit(None).cast("struct<label:string,kind:string,first_word:int,end_word:int,cover:double>"))
    found = standing.select("row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_words"), F.struct("label", "kind", "first_word", "end_word", "cover").alias("span"))
    base = F.filter("spans", lambda s: s["kind"] == "phrase")

    def names(c):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")

    one = rows.unionByName(found).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_list("span")).alias("spans"))

    texts = F.filter("spans", lambda s: s["kind"] == "text")

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def swept(firsts: pd.Series, ends: pd.Series, covers: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else standing_texts(*x) for x in zip(firsts, ends, covers, strict=True)], dtype=object)

    stand = swept(*[texts[c] for c in ("first_word", "end_word", "cover")])
    one = one.withColumn("stand", F.when(F.size(texts) > 1, stand))
    better = F.when(F.col("stand").isNull(), texts).otherwise(F.transform(F.filter(F.arrays_zip(texts.alias("span"), "stand"), lambda z: z["stand"]), lambda z: z["span"]))
    one = one.withColumn("spans", F.sort_array(F.concat(F.filter("spans", lambda s: s["kind"] != "text"), better))).drop("stand")
    return one.select(
        "doc_id",
        "n_words",
        "spans",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
