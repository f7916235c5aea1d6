"""Quality rules against brute force and planted texts."""

import base64
import math
import random
import re
from collections import Counter

import pytest
import zstandard

from netloom.llm import quality, registry

SF = "/root/testdata/sf0.001"
COMPRESS = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress


def plain_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def plain_chunks(data):
    n = quality.CHUNK_BYTES
    return [] if len(data) < n else [len(COMPRESS(data[i : i + n])) / n for i in dict.fromkeys([*range(0, len(data) - n + 1, n), len(data) - n])]


def plain_verdicts(texts):
    """Base counts, base_failed and why the bands reject, by plain Python over all texts."""
    counts = [plain_counts(t) for t in texts]
    bad = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    data = [(t or "").encode() for t in texts]
    band = [sum(len(d) > e for e in quality.EDGES) for d in data]
    ratio = [len(COMPRESS(d)) / len(d) if d else None for d in data]
    chunks = [plain_chunks(d) for d in data]
    seen = {}
    for b, k, r, c in zip(bad, band, ratio, chunks):
        if not b:
            seen.setdefault(k, []).append(r)
            seen.setdefault(quality.CHUNKS, []).extend(c)
    bands = dict(quality.DEFAULTS)
    for k, found in seen.items():
        if len(found) >= quality.MIN_FIT:
            found = sorted(min(math.floor(float(f"{r:.17g}") * quality.STEPS), 2 * quality.STEPS) for r in found)
            at = [(found[max(0, math.ceil(q * len(found)) - 1)] + 0.5) / quality.STEPS for q in (quality.TAIL, 0.5, 1 - quality.TAIL)]
            bands[k] = at[1] - max(quality.SPREAD * (at[1] - at[0]), quality.LEAST_MARGIN), at[1] + max(quality.SPREAD * (at[2] - at[1]), quality.LEAST_MARGIN)
    why = []
    for k, r, c in zip(band, ratio, chunks):
        low, high = bands[quality.CHUNKS]
        if r is not None and (r < bands[k][0] or sum(x < low for x in c) > len(c) / 2):
            why.append("repetitive")
        else:
            why.append("incompressible" if r is not None and (r > bands[k][1] or sum(x > high for x in c) > len(c) / 2) else None)
    return counts, bad, why


def held(rows, texts):
    counts, bad, why = plain_verdicts(texts)
    assert len(rows) == len(texts)
    for r in rows:
        i = r.doc_id
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts[i]
        assert (r.base_failed, r.band_failed, r.kept) == (bad[i], why[i], not bad[i] and why[i] is None), i


def test_query_matches_brute_force(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    numbers = {d: i for i, d in enumerate(documents)}
    rows = registry.op10_quality(spark, SF).replace(numbers, subset=["doc_id"]) if list(numbers) != list(numbers.values()) else registry.op10_quality(spark, SF)
    held(rows.collect(), list(documents.values()))


def planted(seed=3):
    """Clean prose, and texts that the base rules let pass: repetitive ones without repeated word windows, base64, hex."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    weights = [1 / (i + 3) for i in range(3000)]
    clean = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(60, 1500))) for _ in range(900)]
    repetitive = [" ".join("ab" * (i % 60 + 1) + "x" * (i // 60) for i in range(rng.randint(200, 900))) for _ in range(20)]
    repetitive += ["".join(f"{x}{x}{x}{x} {x} " for x in ("." * (i + 1) for i in range(60))) for _ in range(5)]
    dense = [" ".join(base64.b64encode(rng.randbytes(rng.randint(6, 24))).decode() for _ in range(rng.randint(60, 900))) for _ in range(20)]
    return clean, repetitive, dense


def test_bands_reject_what_the_base_rules_let_pass(spark):
    clean, repetitive, dense = planted()
    texts = clean + repetitive + dense
    rows = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    held(rows, texts)
    assert not any(r.base_failed for r in rows)
    why = {r.doc_id: r.band_failed for r in rows}
    n, m = len(clean), len(clean) + len(repetitive)
    assert Counter(why[i] for i in range(n)) == {None: n}  # no clean text is lost
    assert {why[i] for i in range(n, m)} == {"repetitive"}
    assert {why[i] for i in range(m, len(texts))} == {"incompressible"}


def test_chunks_see_the_tail(spark):
    """A text whose whole ratio is ordinary fails if most of its chunks don't: a long head of one kind, the rest of the other."""
    clean, _, dense = planted(5)
    data = (" ".join(clean[:3])[:900] + " ".join(dense)[:1300]).encode()
    assert len(quality.compression(data, COMPRESS)[1]) == 3 and quality.compression(data[:1100], COMPRESS)[1] == plain_chunks(data[:1100])
    assert quality.compression(data, COMPRESS)[1][-1] == len(COMPRESS(data[-1024:])) / 1024
    assert quality.compression(b"short", COMPRESS)[1] == [] and quality.compression(b"", COMPRESS) == (None, None)


@pytest.mark.parametrize("rows", [0, 1])
def test_odd_rows(spark, rows):
    schema = "doc_id long, text string, n_words string, kept string, band_failed string, length_band string, zstd_ratio string, zstd_chunk_ratio string"
    odd = [(i, t, *"cccccc") for i, t in [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id"), (5, "Ünïcode ŁÓ 🙂 " * 3), (6, "long text " * 60_000)]] * rows
    found = quality.quality(spark.createDataFrame(odd, schema)).collect()
    assert len(found) == len(odd)
    for r in found:
        assert not r.kept and r.base_failed and (r.zstd_ratio is None) == (not r.text)
    if rows:
        assert {r.band_failed for r in found if r.doc_id == 6} == {"repetitive"}
