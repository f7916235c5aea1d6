"""Toxicity against brute force, held-out accuracy, and the cases that its docstring defines."""

import math
import random
import re
import zlib

import numpy as np

from netloom.llm import registry, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, predicted string, offending string, n_sentences string, held_out string"
ODD = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "word", "en"), (4, "word", "en"), (None, "no id here", None), (5, "Ünïcode ŁÓ 🙂 " * 3, "de"), (6, "long text " * 60_000, "en")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, *"ccccc") for i, t, lang in rows], DOCS)


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        body = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(6)]
        if toxic:
            body[rng.randrange(6)] += " vile"
        rows.append((i, ". ".join(body) + ".", "en"))
        labels.append((i, int(toxic) if i % 50 else 0))
    docs = docs_of(spark, rows)
    model = toxicity.train(docs.where("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([out[i].predicted == int(i % 5 == 0) for i in range(300, 400)]) > 0.95
    assert all("vile" in out[i].offending[0].text for i in range(305, 400, 5) if out[i].predicted)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, ODD), labels)
    rows = toxicity.score(docs_of(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in rows)
    model = toxicity.ToxicityModel({b"bad": 9.0}, -4.0)
    out = {r.doc_id: r for r in toxicity.score(docs_of(spark, [(1, None, "en"), (2, "Fine. Bad bad! ok\nbad", "en")]), model).collect()}
    assert [s.sentence for s in out[2].offending] == [1, 3] and out[1].score == 0


def plain_sentences(text):
    """Distinct lower-cased words of each sentence."""
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [set(found) for x in re.split(r"[.!?\n]", lower) if (found := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x))]


def plain_score(text, weights, bias):
    clean = 1.0
    for words in plain_sentences(text):
        evidence = sum(weights.get(w, 0.0) for w in words)
        if evidence > 0:
            clean *= 1 - (1 / (1 + math.exp(-bias - evidence)) - 1 / (1 + math.exp(-bias)))
    return 1 - clean


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_query_matches_brute_force_and_ranks_held_out_documents(spark):
    """Features, likelihood and scores of the whole query by plain Python over all rows."""
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learned = {i: t for i, t in labels.items() if i in documents and not held_out(i)}
    n = [sum(t == k for t in learned.values()) for k in (0, 1)]
    counts = {}
    for i, t in learned.items():
        for w in set().union(*plain_sentences(documents[i])):
            counts.setdefault(w, [0, 0])[t] += 1
    strength = {}
    for w, (c0, c1) in counts.items():
        rate = (c0 + c1 + 1) / (n[0] + n[1] + 2)
        z = abs(c1 / n[1] - c0 / n[0]) / math.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
        if c0 + c1 >= toxicity.MIN_DOCS and z >= toxicity.MIN_Z:
            strength[w] = z
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))), spark.read.parquet(f"{SF}/labels.parquet"))
    weights = {w.decode(): x for w, x in model.weights.items()}
    assert weights and set(weights) <= set(strength)

    def likelihood(weights, bias):
        out = 0.0
        for i, t in learned.items():
            p = 0.02 + 0.96 * plain_score(documents[i], weights, bias)
            out += math.log(p if t else 1 - p)
        return out / len(learned)

    best = likelihood(weights, model.bias)
    assert best > likelihood({}, -4.0) + 0.1
    for w in weights:  # no single weight can be moved to gain much
        assert all(likelihood(weights | {w: weights[w] + by}, model.bias) < best + 2e-3 for by in (-0.5, 0.5))
    rows = registry.op9_toxicity(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert math.isclose(r.score, plain_score(documents[r.doc_id], weights, model.bias), abs_tol=1e-9)
        assert r.predicted == (r.score >= 0.5) and r.held_out == held_out(r.doc_id)
    tested = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, t in tested if not t], [s for s, t in tested if t]
    assert np.mean([(b > g) + (b == g) / 2 for g in good for b in bad]) > 0.8  # the labels are noisy, a toxic one in six has no such word


def test_length_alone_is_no_evidence():
    model = toxicity.ToxicityModel({b"vile": 8.0, b"kind": -3.0}, -4.0)
    for text in (b"the sun was warm today. ", b"so kind of you. "):
        for n in (1, 1000, 20_000):
            assert toxicity.noisy_or(model.sentence_scores(text * n)[1]) == 0
    assert toxicity.noisy_or(model.sentence_scores(b"the sun. " * 20_000 + b"vile.")[1]) > 0.9


def test_slope_of_the_likelihood():
    rng = np.random.default_rng(3)
    sample = [(int(rng.random() < 0.5), [sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(k)], rng.integers(1, 5, k).tolist()) for k in rng.integers(0, 5, 40)]
    likelihood, w, b = toxicity.Likelihood(sample, 6), rng.normal(0.5, 1, 6), -4.3
    grad = likelihood(w, b)[1]
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (likelihood(w + step[:6], b + step[6])[0] - likelihood(w - step[:6], b - step[6])[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6


def test_empty_tables(spark):
    none = docs_of(spark, ODD).where("false")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for docs, marks in ((none, labels), (none, labels.where("false")), (docs_of(spark, ODD), labels.where("false"))):
        model = toxicity.train(docs, marks)
        assert model.weights == {} and {r.score for r in toxicity.score(docs, model).collect()} <= {0.0}
