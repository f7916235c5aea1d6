"""Whole queries against plain Python that shares no code with them: language ID and SimHash groups."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from netloom.llm import langid, registry

SF = "/root/testdata/sf0.001"


def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()


def buckets(word):
    """Hashed n-grams of a word with a mark on both sides."""
    marked = b" " + word + b" "
    for size in langid.GRAMS:
        for i in range(len(marked) - size + 1):
            value = 0
            for byte in marked[i : i + size]:
                value = (value * 257 + byte) % 2**64
            yield (((value + size) * 0x9E3779B97F4A7C15) % 2**64 >> 48) % langid.BUCKETS


def spoken(text):
    return [w.encode() for w in re.findall(r"(?:[a-z]|[^\x00-\x7f])+", (text or "").lower())]


def mixture(columns):
    """Proportions (start, steps) of languages by plain EM; ``columns``: likelihoods of each word by language."""

    def run(share, steps=2000):
        for _ in range(steps):
            new = dict.fromkeys(share, 0.0)
            for word in columns:
                total = sum(share[j] * word[j] for j in share)
                for j in share:
                    new[j] += share[j] * word[j] / total / len(columns)
            if max(abs(new[j] - share[j]) for j in share) < 1e-6:
                return new
            share = new
        return share

    n_langs, cost = len(columns[0]), langid.PENALTY * math.log(len(columns) + 1)
    best = max(range(n_langs), key=lambda j: (sum(math.log(w[j]) for w in columns), -j))
    share = {best: 1.0}
    while len(share) < n_langs:
        grown = []
        for j in set(range(n_langs)) - set(share):
            ratio = [w[j] / sum(p * w[k] for k, p in share.items()) for w in columns]
            part = 0.1
            for _ in range(2000):
                new = sum(part * r / (part * r + 1 - part) for r in ratio) / len(ratio)
                if abs(new - part) < 1e-6:
                    break
                part = new
            grown.append((sum(math.log1p(part * (r - 1)) for r in ratio) - cost, j, part))
        gain, j, part = max(grown)
        if gain <= 0:
            break
        share = run({k: p * (1 - part) for k, p in share.items()} | {j: part})
    return share


def test_language_query_matches_plain_counts_and_em(spark):
    docs = rows(spark)
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs}
    counts, seen = defaultdict(Counter), {}
    grams = lambda w: seen.setdefault(w, list(buckets(w)))
    for d in docs:
        if not held[d.doc_id] and d.lang is not None:
            for word, n in Counter(spoken(d.text)).items():
                for b in grams(word):
                    counts[d.lang][b] += n
    langs = sorted(counts)
    totals = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    scored = {}

    def score(word):
        if word not in scored:
            raw = [sum(math.log((counts[lang][b] + 0.5) / totals[lang]) for b in grams(word)) for lang in langs]
            scored[word] = [math.exp(max(x - max(raw), langid.FLOOR)) for x in raw]
        return scored[word]

    found = {r.doc_id: r for r in registry.op3_langid(spark, SF).collect()}
    assert len(found) == len(docs)
    off = 0
    for d in docs:
        got = found[d.doc_id]
        assert got.held_out == held[d.doc_id]
        words = spoken(d.text)
        if not any(c.isalpha() for c in d.text or ""):
            assert (got.lang_pred, got.score) == (langid.UNDETERMINED, 0.0)
            continue
        share = mixture([score(w) for w in words])
        top = max(share, key=lambda j: (share[j], -j))
        assert got.lang_pred == langs[top], d.doc_id
        off += abs(got.score - share[top]) > 0.05
    assert off <= len(docs) // 50  # the operator's EM stops earlier


def test_simhash_query_matches_all_pairs(spark):
    docs = rows(spark)
    codes = {}
    for d in docs:
        words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        codes[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in codes}
    array = np.array(list(codes.values()), np.uint64)
    near = [(a, b) for a, row in zip(codes, np.bitwise_count(array[:, None] ^ array) <= 3, strict=True) for b, x in zip(codes, row, strict=True) if x]
    while True:
        new = dict(label)
        for a, b in near:
            new[a] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert len(set(label.values())) < len(docs)
    got = registry.op8_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{c:016x}", label[i]) for i, c in codes.items())
