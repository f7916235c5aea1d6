"""Language identification by multilingual mixture inference.

Training counts character n-grams (of the UTF-8 bytes of lower-cased words, hashed to ``BUCKETS``) for each language
over every training row, in Spark. The model is those counts smoothed to likelihoods, of a size that does not grow with
the input. A word's likelihood under a language is the product over its n-grams.

Inference takes each document as a mixture of languages: expectation-maximisation over its words estimates the
proportions. The language set grows from the single best language while the likelihood, less ``penalty`` log(words) for
each language more, improves. A language whose gradient bound cannot pay the penalty is not tried; that is exact,
because the likelihood is concave in the proportions.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no languages; without any training
row every document is ``und``; equal scores go to the language that sorts first; repeated rows each get a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import slices, with_columns

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
PENALTY = 1.5
EM_STEPS = 30
#: Words kept with their likelihoods in a Python worker; beyond it the store starts anew.
CACHE_WORDS = 200_000
#: A word speaks against a language by so much at most, next to its best language.
FLOOR = -12.0
UNDETERMINED = "und"
#: Every ASCII byte that is not a letter becomes a space; A-Z are lower-cased by ``str.lower`` before.
SPLIT = bytes(32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if text.translate(None, bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)) + bytes(range(128, 256))):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def text_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII bytes."""
    return text.decode("utf-8", "replace").lower().encode().translate(SPLIT).split() if text else []


def gram_buckets(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words with a boundary mark on both sides, and each gram's word."""
    joined = np.frombuffer(b" " + b" ".join(found) + b" ", np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, found), np.int64, len(found)) + 2
    word_of = np.repeat(np.arange(len(found)), n - 1)  # by the byte that a gram starts at; a boundary belongs to the next word
    out, owner = [], []
    last = np.cumsum(n - 1)
    value = joined.copy()
    for size in range(1, max(GRAMS) + 1):
        if size > 1:
            value = value[: len(joined) - size + 1] * np.uint64(257) + joined[size - 1 :]
        if size in GRAMS:
            at = np.arange(min(len(word_of), len(value)))
            inside = at + size - 1 <= last[word_of[at]]
            mixed = (value[at] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS)
            owner.append(word_of[at][inside])
    return np.concatenate(out), np.concatenate(owner)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all ``rows`` (text, lang): counted in each task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def settle(lang):
            times = seen.pop(lang)
            grams, owner = gram_buckets(list(times))
            weight = np.fromiter(times.values(), np.int64, len(times))
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            counts[lang] += np.bincount(grams, weight[owner], BUCKETS).astype(np.int64)

        for part, texts in slices(batches, "text"):
            for lang, text in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
                if found := text_words(text):
                    seen.setdefault(lang, Counter()).update(found)
                    if len(seen[lang]) > CACHE_WORDS:
                        settle(lang)
        for lang in list(seen):
            settle(lang)
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used])], names=["lang", "bucket", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """Word -> row; an unseen word gets the next row."""

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        return row


class LanguageModel:
    """Log-likelihoods of n-gram buckets: (BUCKETS, languages)."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p
        self.store = _Numbers()
        self.table = np.zeros((len(langs), 0))

    def __reduce__(self):
        return LanguageModel, (self.langs, self.log_p)

    def word_scores(self, found: list[bytes]) -> np.ndarray:
        """(languages, words) log-likelihoods, each word's best language at 0."""
        if len(self.store) > CACHE_WORDS:
            self.store, self.table = _Numbers(), self.table[:, :0]
        rows = np.fromiter(map(self.store.__getitem__, found), np.int64, len(found))
        known = self.table.shape[1]
        if len(self.store) > known:
            new = list(islice(reversed(self.store), len(self.store) - known))[::-1]
            grams, owner = gram_buckets(new)
            scores = np.stack([np.bincount(owner, self.log_p[grams, j], len(new)) for j in range(len(self.langs))])
            self.table = np.concatenate([self.table, np.maximum(scores - scores.max(0), FLOOR)], 1)
        return self.table[:, rows]


def train(rows: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Fit on every row with text and lang. What reaches the driver is languages x BUCKETS numbers at most."""
    counted = gram_counts(rows.where("text IS NOT NULL AND lang IS NOT NULL")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    n = np.zeros((BUCKETS, len(langs)))
    for j, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        n[own["bucket"].to_numpy(), j] = own["n"].to_numpy()
    n += smoothing
    return LanguageModel(langs, np.log(n / n.sum(0, keepdims=True)))


def em(likelihood: np.ndarray, n: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int = EM_STEPS, tolerance: float = 1e-3) -> np.ndarray:
    """Proportions (languages, documents) from the start ``share``; zeros stay zeros. ``n`` words from ``first`` a document."""
    used = np.flatnonzero(share.any(1))
    for _ in range(steps):
        joint = [np.repeat(share[j], n) * likelihood[j] for j in used]
        total = sum(joint)
        new = np.zeros_like(share)
        for j, x in zip(used, joint, strict=True):
            new[j] = np.add.reduceat(x / total, first) / n
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < tolerance:
            break
    return share


def mixed(likelihood: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each word's likelihood under its document's mixture."""
    return sum(np.repeat(share[j], n) * likelihood[j] for j in np.flatnonzero(share.any(1)))


def em_one_more(ratio: np.ndarray, n: np.ndarray, first: np.ndarray, steps: int = EM_STEPS, tolerance: float = 1e-3) -> np.ndarray:
    """Each document's proportion of a language that joins a fixed mixture; ``ratio``: its likelihood over the mixture's."""
    share = np.full(len(n), 0.1)
    for _ in range(steps):
        own = np.repeat(share, n)
        joint = own * ratio
        new = np.add.reduceat(joint / (joint + (1 - own)), first) / n
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < tolerance:
            break
    return share


def infer(log_p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Penalised-likelihood mixture proportions (languages, documents); ``log_p`` (languages, words), ``n`` words each."""
    n_langs, n_docs = len(log_p), len(n)
    first = np.cumsum(np.r_[0, n])[:-1]
    single = np.stack([np.add.reduceat(x, first) for x in log_p])
    share = np.zeros((n_langs, n_docs))
    share[single.argmax(0), np.arange(n_docs)] = 1
    likelihood, active, cost = np.exp(log_p), np.arange(n_docs), penalty * np.log(n + 1.0)
    for _ in range(n_langs - 1):
        own = share[:, active]
        mix = mixed(likelihood, n, own)
        gain, grown = np.zeros(len(active)), own.copy()
        for j in range(n_langs):
            ratio = likelihood[j] / mix
            log_ratio = np.log(ratio)
            # concavity bounds the gain by the gradient; each word gains at most its positive log ratio
            bound = np.minimum(np.add.reduceat(ratio, first) - n, np.add.reduceat(np.maximum(log_ratio, 0), first))
            pick = np.flatnonzero((bound > cost) & (own[j] == 0))
            if not len(pick):
                continue
            words_of = np.repeat((own[j] == 0) & (bound > cost), n)
            width = n[pick]
            begin, ratio = np.cumsum(np.r_[0, width])[:-1], ratio[words_of]
            part = em_one_more(ratio, width, begin)
            more = np.add.reduceat(np.log1p(np.repeat(part, width) * (ratio - 1)), begin) - cost[pick]
            better = more > gain[pick]
            gain[pick[better]] = more[better]
            grown[:, pick[better]] = own[:, pick[better]] * (1 - part[better])
            grown[j, pick[better]] = part[better]
        go = gain > 0
        if not go.any():
            break
        likelihood = likelihood[:, np.repeat(go, n)]
        active, n, cost = active[go], n[go], cost[go]
        first = np.cumsum(np.r_[0, n])[:-1]
        share[:, active] = em(likelihood, n, first, grown[:, go])
    return share


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("proportions", T.ArrayType(T.DoubleType())),
]


def predict_texts(model: LanguageModel, texts: list[bytes | None], penalty: float = PENALTY) -> list[list]:
    """Columns lang_pred, score, langs, proportions of a slice of texts."""
    n_docs = len(texts)
    out = [[UNDETERMINED] * n_docs, [0.0] * n_docs, [[] for _ in texts], [[] for _ in texts]]
    found = [text_words(t) if has_letter(t) else [] for t in texts]
    live = [i for i, w in enumerate(found) if w]
    if not live or not model.langs:
        return out
    n = np.array([len(found[i]) for i in live], np.int64)
    share = infer(model.word_scores([w for i in live for w in found[i]]), n, penalty)
    for i, p in zip(live, share.T, strict=True):
        order = [j for j in np.argsort(-p, kind="stable") if p[j] > 0]
        out[0][i], out[1][i] = model.langs[order[0]], float(min(1.0, p[order[0]]))
        out[2][i], out[3][i] = [model.langs[j] for j in order], [float(p[j]) for j in order]
    return out


def identify(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score (the proportion of lang_pred), langs and proportions (largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, "text", lambda texts: predict_texts(shared.value, texts, penalty), FIELDS)
