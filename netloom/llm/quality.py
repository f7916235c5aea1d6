"""Quality rules by compression bands.

Zstandard ratios (compressed / raw bytes) of the whole text and of its fixed chunks are held against limits: a ratio under
the lower limit is repetitive text, one over the upper limit incompressible text. Short texts compress badly because of
the frame and an empty window, so each length band has limits of its own, and chunks, all of one length, have theirs.

Limits are fitted to the corpus (``fit_bands``): in each band, over all texts that pass the base rules, the median and
the quantiles TAIL and 1 - TAIL of the ratio; a limit lies SPREAD times as far from the median as its quantile, and at
least LEAST_MARGIN. Up to a share TAIL of junk on either side moves no limit far. Bands with fewer than MIN_FIT such texts
take DEFAULTS. The quantiles come from counts of ratios by steps of 1 / STEPS, so they are the same however the rows lie.

A text's last chunk ends with the text and overlaps the one before, so all of it is seen; a text shorter than a chunk is
judged whole only. A text fails by its chunks if over MAX_BAD_CHUNKS of them are out of the limits on one side.

Defined results: a null or empty text has no words, ratios of null, and fails the base rules; repeated rows each get
their own result; extra columns stay, but a column with the name of a result is replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import CONTINUATION, with_columns

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CHUNK_BYTES = 1024
MAX_BAD_CHUNKS = 0.5
TAIL, SPREAD, LEAST_MARGIN = 0.05, 4.0, 0.15
MIN_FIT = 100
STEPS = 200
#: Greatest length in bytes of each band; longer texts are in one more, and chunks are the band CHUNKS.
EDGES = (256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
CHUNKS = -1
#: Limits (low, high) of bands that can't be fitted: of chunks, then by length.
DEFAULTS = {CHUNKS: (0.20, 0.90)} | dict(enumerate([(0.35, 1.10), (0.30, 0.95), (0.25, 0.90), (0.20, 0.85), (0.20, 0.80), (0.15, 0.75), (0.15, 0.75), (0.12, 0.75), (0.12, 0.70), (0.10, 0.70)]))


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    found = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(found),
        len(b"".join(found).translate(None, CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(found),
    )


def repeated_words(found: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    windows = list(zip(found, found[1:], found[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    covered = np.zeros(len(found) + 3, bool)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i] = covered[j] = True
    covered[2:] |= covered[1:-1] | covered[:-2]
    covered[1] |= covered[0]
    return int(covered.sum())


def compression(text: bytes | None, compress, chunk_bytes: int = CHUNK_BYTES) -> tuple[float | None, list[float] | None]:
    """Ratios of the whole text and of its chunks."""
    if not text:
        return None, None
    n = len(text)
    starts = [*range(0, n - chunk_bytes + 1, chunk_bytes)]
    if starts and n % chunk_bytes:
        starts.append(n - chunk_bytes)
    return len(compress(text)) / n, [len(compress(text[i : i + chunk_bytes])) / chunk_bytes for i in starts]


FIELDS = [
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("length_band", T.IntegerType()),
    T.StructField("zstd_ratio", T.DoubleType()),
    T.StructField("zstd_chunk_ratios", T.ArrayType(T.DoubleType())),
]


def measure(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, level: int = 3) -> DataFrame:
    """``docs`` (with text) with the base counts, ``base_failed``, the length band and the ratios."""

    def work(texts):
        import zstandard

        compress = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        counts = [base_counts(t) for t in texts]
        ratios = [compression(t, compress, chunk_bytes) for t in texts]
        bands = [bisect_left(EDGES, len(t or b"")) for t in texts]
        return [*map(list, zip(*counts, strict=True)), bands, *map(list, zip(*ratios, strict=True))]

    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return with_columns(docs, "text", work, FIELDS).withColumn("base_failed", base_failed)


def limits(steps: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Lower and upper limit from how many ratios lie in each step, steps in order."""
    below = np.cumsum(counts)
    low, mid, high = ((steps[np.searchsorted(below, q * below[-1])] + 0.5) / STEPS for q in (TAIL, 0.5, 1 - TAIL))
    return float(mid - max(SPREAD * (mid - low), LEAST_MARGIN)), float(mid + max(SPREAD * (high - mid), LEAST_MARGIN))


def fit_bands(measured: DataFrame) -> dict[int, tuple[float, float]]:
    """(low, high) of every band over all rows of ``measured`` that pass the base rules."""
    clean = measured.where("NOT base_failed AND zstd_ratio IS NOT NULL")
    own = F.array(F.struct(F.col("length_band").alias("band"), F.col("zstd_ratio").alias("ratio")))
    chunks = F.transform("zstd_chunk_ratios", lambda c: F.struct(F.lit(CHUNKS).alias("band"), c.alias("ratio")))
    ratios = clean.select(F.explode(F.concat(own, chunks)).alias("x")).select("x.*")
    step = F.least(F.floor(F.col("ratio") * STEPS), F.lit(2 * STEPS)).cast("int")  # bounds what is collected
    found: dict[int, list] = {}
    for band, at, n in ratios.groupBy("band", step.alias("step")).count().orderBy("band", "step").collect():
        found.setdefault(band, []).append((at, n))
    fitted = {band: np.array(rows).T for band, rows in found.items()}
    return DEFAULTS | {band: limits(steps, counts) for band, (steps, counts) in fitted.items() if counts.sum() >= MIN_FIT}


def judge(measured: DataFrame, bands: dict[int, tuple[float, float]]) -> DataFrame:
    """``measured`` with ``band_failed`` (repetitive, incompressible or null) and ``kept``; ratios of chunks become the one
    farthest from the chunk limits' middle, ``zstd_chunk_ratio``."""

    def limit(side: int) -> Column:
        out = F.lit(bands[len(EDGES)][side])
        for band in range(len(EDGES)):
            out = F.when(F.col("length_band") == band, bands[band][side]).otherwise(out)
        return out

    ratio, chunks, (low, high) = F.col("zstd_ratio"), F.col("zstd_chunk_ratios"), bands[CHUNKS]
    most = MAX_BAD_CHUNKS * F.size(chunks)
    repetitive = (ratio < limit(0)) | (F.size(F.filter(chunks, lambda c: c < low)) > most)
    dense = (ratio > limit(1)) | (F.size(F.filter(chunks, lambda c: c > high)) > most)
    middle = (low + high) / 2
    worst = F.array_max(F.transform(chunks, lambda c: F.struct(F.abs(c - middle).alias("far"), c.alias("ratio"))))["ratio"]
    failed = F.when(repetitive, "repetitive").when(dense, "incompressible")
    out = measured.withColumns({"zstd_chunk_ratio": worst, "band_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("band_failed").isNull()).drop("zstd_chunk_ratios", "length_band")


def quality(docs: DataFrame, bands: dict[int, tuple[float, float]] | None = None, chunk_bytes: int = CHUNK_BYTES, level: int = 3) -> DataFrame:
    """``measure`` and ``judge``; bands that aren't given are fitted to ``docs``, which is then read twice."""
    measured = measure(docs, chunk_bytes, level)
    return judge(measured, bands or fit_bands(measured))
