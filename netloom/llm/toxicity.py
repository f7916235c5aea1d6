"""Toxicity by multiple-instance learning.

A document is a bag of sentences. The evidence of a sentence is the sum of its distinct words' weights; it is toxic with
probability sigmoid(bias + evidence) - sigmoid(bias), and 0 without evidence or with evidence against it. The document's
score is the noisy-or of its sentences, 1 - prod(1 - p), so sentences that say nothing add nothing however many they are.
Only documents carry labels; the weights are fitted to them through the noisy-or, and then tell which sentences offend.

Fitting takes a bounded sample of the labelled rows, ``sample_rows`` at most, chosen by hash of the id. Words are
counted over the sample in Spark; those that lean to one label by ``min_z`` standard errors, ``max_words`` at most by
strength, become features. What reaches the driver of a sample document are its distinct sets of features in a sentence,
with their numbers. Scoring reads every document.

Defined results: null and empty texts have no sentences and the score of no evidence, 0; without any usable label, or
with one kind only, all scores are 0; equal sentences are all located; repeated rows each get a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import LOWER_WORDS, slices, with_columns

SAMPLE_ROWS = 20_000
MAX_WORDS = 2_000
MIN_Z = 5.0
MIN_DOCS = 5
#: Sentence ends become line feeds; else as LOWER_WORDS.
SENTENCES = bytes(10 if b in b".!?\n" else c for b, c in enumerate(LOWER_WORDS))


def sentences(text: bytes | None) -> list[tuple[int, int, list[bytes]]]:
    """(start byte, end byte, lower-cased words) of every sentence with a word."""
    out, at = [], 0
    for line in text.translate(SENTENCES).split(b"\n") if text else ():
        if found := line.split():
            out.append((at, at + len(line), found))
        at += len(line) + 1
    return out


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float

    def sentence_scores(self, text: bytes | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Byte spans and probabilities of a text's sentences."""
        found = sentences(text)
        get = self.weights.get
        total = np.array([sum(sorted(filter(None, map(get, set(w))))) if not self.weights.keys().isdisjoint(w) else 0.0 for _, _, w in found])
        return [(a, b) for a, b, _ in found], probability(total, self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def probability(evidence: np.ndarray, bias: float) -> np.ndarray:
    return np.where(evidence > 0, sigmoid(bias + evidence) - sigmoid(np.array(bias)), 0.0)


def noisy_or(p: np.ndarray) -> float:
    return float(np.abs(np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, n): documents of each label that hold the word."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part, texts in slices(batches, "text"):
            counts = (Counter(), Counter())
            for toxic, text in zip(part.column(part.schema.get_field_index("toxic")).to_pylist(), texts, strict=True):
                counts[toxic].update(set((text or b"").translate(LOWER_WORDS).split()))
            for toxic in (0, 1):
                names = pa.array(list(counts[toxic]), pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array([toxic] * len(names), pa.int32()), pa.array(list(counts[toxic].values()), pa.int64())], names=["word", "toxic", "n"])

    return rows.select("text", "toxic").mapInArrow(run, "word binary, toxic int, n long").groupBy("word").pivot("toxic", [0, 1]).sum("n").na.fill(0)


def features(counts: DataFrame, n0: int, n1: int, min_z: float = MIN_Z, max_words: int = MAX_WORDS) -> list[bytes]:
    """Words whose share differs between the labels by ``min_z`` standard errors; the strongest ``max_words``."""
    rate = (F.col("0") + F.col("1") + 1) / (n0 + n1 + 2)
    z = (F.col("1") / n1 - F.col("0") / n0) / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1))
    strong = counts.where(F.col("0") + F.col("1") >= MIN_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= min_z)
    return [bytes(r[0]) for r in strong.orderBy(F.desc("z"), "word").limit(max_words).select("word").collect()]


def bags(rows: DataFrame, vocabulary: list[bytes]) -> list:
    """Of every sample document: its label, and the distinct sets of features of its sentences with their numbers."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]):
        for part, texts in slices(batches, "text"):
            hits = [Counter(h for _, _, w in sentences(t) if (h := tuple(sorted({number[x] for x in w if x in number})))) for t in texts]
            arrays = [
                part.column(part.schema.get_field_index("toxic")),
                pa.array([list(h) for h in hits], pa.list_(pa.list_(pa.int32()))),
                pa.array([list(h.values()) for h in hits], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "hits", "times"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, hits array<array<int>>, times array<int>").collect()


class Likelihood:
    """The noisy-or's mean log likelihood of a sample and its gradient, with a floor for mislabelled documents."""

    def __init__(self, sample: list, n_words: int, noise: float = 0.02):
        self.n_words, self.noise = n_words, noise
        self.label = np.array([r[0] for r in sample], float)
        self.doc = np.array([d for d, r in enumerate(sample) for _ in r[1]], np.int64)
        self.times = np.array([t for r in sample for t in r[2]], float)
        self.term = np.array([t for r in sample for h in r[1] for t in h], np.int64)
        self.owner = np.repeat(np.arange(len(self.doc)), [len(h) for r in sample for h in r[1]])

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The value, and its slope by the weights and, last, the bias. At no evidence the slope is that from above."""
        evidence = np.bincount(self.owner, w[self.term], len(self.doc))
        live, p1, p0 = evidence >= 0, sigmoid(b + evidence), sigmoid(np.array(b))
        p = np.where(live, p1 - p0, 0.0)
        clean = np.exp(np.bincount(self.doc, self.times * np.log1p(-p), len(self.label)))
        toxic = self.noise + (1 - 2 * self.noise) * (1 - clean)
        value = np.mean(np.where(self.label > 0, np.log(toxic), np.log(1 - toxic)))
        by_doc = (self.label / toxic - (1 - self.label) / (1 - toxic)) * (1 - 2 * self.noise) * clean  # by -log(clean)
        by_p = np.where(live, by_doc[self.doc] * self.times / (1 - p), 0.0)
        by_evidence = by_p * p1 * (1 - p1)
        by_bias = (by_evidence - by_p * p0 * (1 - p0)).sum()
        return float(value), np.r_[np.bincount(self.term, by_evidence[self.owner], self.n_words), by_bias] / len(self.label)


def fit(sample: list, n_words: int, steps: int = 400, rate: float = 0.1, l1: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that make the likelihood great, by Adam's steps with shrinkage; the bias stays at -4 or under."""
    likelihood = Likelihood(sample, n_words)
    w, b = np.zeros(n_words), -4.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, steps + 1):
        _, grad = likelihood(w, b)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w + move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 * 10, 0)
        b = min(b + move[-1], -4.0)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` of the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers."""
    picked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic").cache()
    try:
        n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
        if not n.get(0) or not n.get(1):
            return ToxicityModel({}, -40.0)
        vocabulary = features(word_counts(rows), n[0], n[1])
        w, b = fit(bags(rows, vocabulary), len(vocabulary))
    finally:
        rows.unpersist()
    return ToxicityModel({t: float(x) for t, x in zip(vocabulary, w, strict=True) if x}, b)


SPANS = T.ArrayType(T.StructType([T.StructField("sentence", T.IntegerType()), T.StructField("probability", T.DoubleType()), T.StructField("text", T.StringType())]))
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("offending", SPANS)]


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score, predicted, n_sentences and the offending sentences: those of at least ``threshold``, or the
    likeliest one of a document that only reaches it by many.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        out = [[], [], [], []]
        for text in texts:
            spans, p = shared.value.sentence_scores(text)
            total = noisy_or(p) if len(p) else 0.0
            predicted = int(total >= threshold)
            at = np.flatnonzero(p >= threshold)
            if predicted and not len(at):
                at = [int(p.argmax())]
            located = [{"sentence": int(i), "probability": float(p[i]), "text": text[spans[i][0] : spans[i][1]].decode("utf-8", "replace")} for i in at]
            for column, x in zip(out, (total, predicted, len(p), located), strict=True):
                column.append(x)
        return out

    return with_columns(docs, "text", work, FIELDS)
