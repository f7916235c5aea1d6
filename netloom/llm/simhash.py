"""SimHash near-duplicates through Gray-ordered hierarchical indexes.

1. Fingerprint: 64 majority bits over the XXH64 (seed 42) of all word shingles, one pass, no shuffle.
2. Distinct fingerprints only. Two of them within ``radius`` bits agree on at least one of radius + 1 bit blocks, so
   each goes to radius + 1 buckets (block, value). A bucket over ``max_bucket`` is dealt anew by blocks of its other bits.
3. In a bucket, fingerprints are sorted by Gray rank. Runs of them become tree nodes that hold the bits on which all
   members agree and the node above has not settled (mask, pattern). A search adds up differing masked bits on the way
   down and drops a node's whole group when the sum passes ``radius``, or when the group is already linked to the query.
4. Each bucket sends a star per linked set, and connected components join the stars.

Links inside a bucket are found for every pair that may differ in component; pairs already linked through others are
skipped, so a group of thousands of copies costs no square. Nothing is capped, sampled or collected.

``first_rows`` is the same search for a similarity of shingle sets (Jaccard, 0.8 by default) that 3 of 64 bits can't reach:

1. Rows of one set of five-word shingles are taken together. A set that shares too few of its BOTTOM smallest shingle hashes
   with other sets has no partner and is not searched (``may_have_partners``). A set has a fingerprint of 256 bits. At 0.8
   two sets agree on about 85 % of them (the angle between them), at no similarity on half.
2. Each of ``tables`` picks some bits, as many as the number of sets asks for, and two sets that agree on all of them
   meet in its bucket. There are so many tables that a pair at the threshold meets in none in 1 % of cases.
3. A bucket is searched by the Gray-ordered tree. It gives a spanning forest of the pairs within the radius; sets known
   to be linked are skipped. Each pair is confirmed by the exact similarity of the two texts' sets. One table goes
   first and a few next, so that large groups are linked before the many tables are searched.
4. A forest skips pairs that others stand for. Among sets that forests link to a pair which was not confirmed, all pairs
   within the radius and not linked are looked at, each in the first table where it meets. There the sets carry 1,024 bits
   and their sizes, which tell most pairs under the threshold apart on the spot; the others are confirmed as before.
   Components join the links.
5. A bucket over ``max_bucket`` is cut into parts, and every two parts are searched together, so no task holds a group.

Defined results: null and empty texts (and those of white space) have fingerprint zero and link like any other;
repeated rows each get a result; a null doc_id gets its group's smallest id, or null if the group has no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import LOWER, cut, with_columns
from netloom.llm.components import connected_components
from netloom.shared import scratch

SEED = 42
SHINGLE = 3
RADIUS = 3
FANOUT = 8
MAX_BUCKET = 1 << 18
CHUNK, MEETINGS = 1 << 13, 1 << 20
#: Of the search by similarity: words of a shingle, least similarity, words of 64 bits of a fingerprint.
SET_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 4
#: Words of a fingerprint that the last search carries.
WIDEST = 16
#: Smallest hashes of a set that are looked for in other sets, and how many have to be found there. Each of the smallest of
#: two sets' union is in both with the chance of their similarity, so a pair at 0.8 shares fewer in 0.06 % of cases.
BOTTOM, LEAST_SHARED = 12, 5
#: Pairs that may be broadcast to the texts; more are joined by shuffle.
BROADCAST_PAIRS = 1 << 20
#: Share of pairs at the threshold that meet in no table, and standard deviations of the radius over their mean distance.
MISSED, MARGIN = 0.01, 2.4
#: Bits of a table at least, and how many tables go first, and then.
LEAST_BITS, EARLY = 12, (1, 4)
#: Bytes of texts and sets that a Python worker keeps while it confirms pairs.
KEPT_BYTES = 64 << 20


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 of every shingle of ``size`` words, repeats included; the whole sequence if there are fewer words."""
    import xxhash

    found = (text or b"").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp`` (long, the 64 bits)."""

    def work(texts):
        return [np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)]

    return with_columns(docs, "text", lambda texts: [pa.array(work(texts)[0])], [T.StructField("fp", T.LongType())])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(bucket: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Order of rows by (bucket, Gray rank of codes of one or more words, the first word highest)."""
    keys, odd = [bucket], np.zeros(len(codes), bool)
    for word in codes.T:
        rank = gray_rank(word)
        keys.append(np.where(odd, ~rank, rank))
        odd = odd ^ (np.bitwise_count(word) % 2 == 1)
    return np.lexsort(keys[::-1])


def _count(x: np.ndarray) -> np.ndarray:
    """Set bits of each row of words."""
    return np.bitwise_count(x[:, 0]) if x.shape[1] == 1 else np.bitwise_count(x).sum(1, dtype=np.uint16)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (each the smallest row of its set) after linking rows a with b, and which of the pairs joined two sets."""
    pairs, at = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])], 1), axis=0, return_index=True)
    up: dict[int, int] = {}
    joined = []

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for i, (x, y) in zip(at.tolist(), pairs.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            joined.append(i)
    if not up:
        return label, np.array(joined, np.int64)
    moved = np.arange(len(label))
    for x in up:
        moved[x] = top(x)
    return moved[label], np.array(joined, np.int64)


class GrayIndex:
    """Hierarchical index over the rows of one or more buckets, sorted by ``gray_order``; codes are rows of 64-bit words."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        self.codes, self.fanout = codes, fanout
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        self.levels = []  # from the leaves up: first row of each node, first child, mask and pattern of agreed bits
        start, group, agree, value = np.arange(len(codes)), np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)])), np.full(codes.shape, ~np.uint64(0)), codes
        self.group_of_row = group
        self.levels.append({"row": start, "agree": agree, "value": value})
        while len(start) > len(first):
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(start)) - begin[group]
            child = np.flatnonzero(place % fanout == 0)
            every, some = np.bitwise_and.reduceat(value | ~agree, child), np.bitwise_or.reduceat(value & agree, child)
            agree = np.bitwise_and.reduceat(agree, child) & ~(every ^ some)
            value, start, group = some & agree, start[child], group[child]
            self.levels.append({"row": start, "agree": agree, "value": value, "child": np.r_[child, len(place)]})
        for low, high in zip(self.levels, self.levels[1:], strict=False):  # what the node above has not settled
            parent = np.repeat(np.arange(len(high["row"])), np.diff(high["child"]))
            low["mask"] = low["agree"] & ~high["agree"][parent]
        self.levels[-1]["mask"] = self.levels[-1]["agree"]
        # Rows that are looked for at a time: so many that they meet no more than MEETINGS rows of the largest bucket.
        self.chunk = max(16, min(CHUNK, MEETINGS // max(1, int(np.diff(np.r_[first, len(codes)]).max(initial=1)))))
        self.ends = [np.r_[x["row"][1:], len(codes)] for x in self.levels]

    def components(self, radius: int = RADIUS, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every row the first row of its linked set in its bucket, and the pairs of rows that joined sets.

        ``label``: the first row of each row's set as known so far; without it each row is a set."""
        n = len(self.codes)
        near = np.flatnonzero(np.r_[False, (self.group_of_row[1:] == self.group_of_row[:-1]) & (_count(self.codes[1:] ^ self.codes[:-1]) <= radius)])
        if label is None:  # neighbours in Gray order are linked at once
            label = np.arange(n)
            label[near] = 0
            label, joined = np.maximum.accumulate(label), [(near - 1, near)]
        else:
            label, used = _union(label, near - 1, near)
            joined = [(near[used] - 1, near[used])]
        for at in range(0, n, self.chunk):
            a, b = self.search(np.arange(at, min(n, at + self.chunk)), label, radius)
            if len(a):
                label, used = _union(label, a, b)
                joined.append((a[used], b[used]))
        return label, *(np.concatenate([x[i] for x in joined]) for i in (0, 1))

    def apart(self, radius: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows within ``radius`` that have different labels."""
        for at in range(0, len(self.codes), self.chunk):
            yield self.search(np.arange(at, min(len(self.codes), at + self.chunk)), label, radius)

    def search(self, query: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Later rows within ``radius`` of the query rows and not yet of their set."""
        node, far = self.group_of_row[query], np.zeros(len(query), np.uint16)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            least, most = np.minimum.reduceat(label, level["row"]), np.maximum.reduceat(label, level["row"])
            far = far + _count((self.codes[query] ^ level["value"][node]) & level["mask"][node])
            mine = label[query]
            keep = (far <= radius) & (self.ends[depth][node] > query + 1) & ~((least[node] == mine) & (most[node] == mine))
            query, node, far = query[keep], node[keep], far[keep]
            if depth and len(query):
                child = level["child"]
                width = child[node + 1] - child[node]
                base = np.repeat(child[node] - np.r_[0, np.cumsum(width)[:-1]], width)
                query, far = np.repeat(query, width), np.repeat(far, width)
                node = base + np.arange(len(query))
        return query, node


def stars(bucket: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code of its set's root) over whole buckets in any order."""
    order = gray_order(bucket, codes[:, None])
    bucket, codes = bucket[order], codes[order]
    root, _, _ = GrayIndex(bucket, codes[:, None]).components(radius)
    linked = root != np.arange(len(codes))
    return codes[linked], codes[root[linked]]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by bucket, the first column: whole buckets, as few as fill a few batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held[0][0][0] == held[-1][0][-1]:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = np.searchsorted(columns[0], columns[0][-1])
        held = [[c[last:] for c in columns]]
        yield [c[:last] for c in columns]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _link_partition(batches, radius: int):
    """Rows (bucket, fp) sorted by bucket in; stars out."""
    for keys, codes in _whole_buckets(batches):
        a, b = stars(keys, codes.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in n runs of nearly equal length."""
    edge = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def buckets(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(bucket, fp): every two codes within ``radius`` bits meet in at least one bucket.

    Buckets over ``max_bucket`` are replaced by radius + 1 buckets each over blocks of the bits that they leave open, up
    to twice; a bucket's width is then over half of the bits.
    """

    def value(bits):
        mask = sum(1 << b for b in bits)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))

    first = _blocks(list(range(64)), radius + 1)
    level = fps.select("fp", F.posexplode(F.array(*[value(b) for b in first]))).select("fp", F.col("pos").alias("path"), F.xxhash64("pos", "col").alias("bucket"))
    paths, done = [b for b in first], []
    for _ in range(2):
        hot = level.groupBy("bucket").count().where(F.col("count") > max_bucket).select("bucket")
        if hot.isEmpty():
            break
        done.append(level.join(hot, "bucket", "left_anti").select("bucket", "fp"))
        rest, split, names = level.join(hot, "bucket"), [], []
        for i, used in enumerate(paths):
            for block in _blocks([b for b in range(64) if b not in used], radius + 1):
                split.append(F.when(F.col("path") == i, F.struct(F.lit(len(names)).alias("path"), value(block).alias("v"))))
                names.append(used + block)
        level = rest.select("fp", "bucket", F.explode(F.filter(F.array(*split), lambda x: x.isNotNull())).alias("x")).select("fp", F.col("x.path").alias("path"), F.xxhash64("bucket", "x.path", "x.v").alias("bucket"))
        paths = names
    out = level.select("bucket", "fp")
    for d in done:
        out = out.unionAll(d)
    return out


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (u, v) between distinct codes ``fp`` that make the same components as all pairs within ``radius`` bits."""
    placed = buckets(fps, radius, max_bucket).repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(lambda batches: _link_partition(batches, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp, fingerprint hex, component_id, group_size) for each row of ``docs``; component_id is the smallest doc_id reachable over links."""
    marked = cut(fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"), "simhash")
    codes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    component = connected_components(links(codes.select("fp"), radius, max_bucket))
    rooted = codes.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    by_code = rooted.select("fp", "root").join(whole, "root").select("fp", "component_id", "group_size")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(by_code, "fp").select("doc_id", "fp", shown, "component_id", "group_size")


# by similarity


def agreement(similarity: float) -> float:
    """Share of bits on which the fingerprints of two sets of one size agree on average."""
    return 1 - acos(2 * similarity / (1 + similarity)) / pi


def radius_of(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits up to which a pair is looked at: the mean at ``similarity`` and MARGIN standard deviations."""
    p = 1 - agreement(similarity)
    return min(bits, int(bits * p + MARGIN * sqrt(bits * p * (1 - p))))


def tables(n: int, similarity: float = SIMILARITY, missed: float = MISSED) -> np.ndarray:
    """The bits that each table picks (a row a table): log2(n) - 8 of them, LEAST_BITS at least, so that a bucket holds some
    hundred unlike sets at every ``n``, and as many tables as ``missed`` asks for at that length."""
    width = 64 * WIDE
    bits, p = min(48, max(LEAST_BITS, ceil(log2(max(n, 2))) - 8)), 1 - agreement(similarity)
    differ = np.arange(width + 1)
    share = np.array([comb(width, int(d)) * p ** int(d) * (1 - p) ** (width - int(d)) for d in differ])
    meet = np.prod([np.maximum(width - differ - i, 0) / (width - i) for i in range(bits)], axis=0)
    count = next(c for c in range(1, 1 << 20) if share @ (1 - meet) ** c <= missed)
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(width, bits, replace=False) for _ in range(count)])


def shingle_set(text: bytes | None, size: int = SET_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets' union; two empty sets are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def wide_fingerprint(found: np.ndarray, width: int = WIDE) -> np.ndarray:
    """``width`` words of majority bits over the hashes of a set, each word by another mixing of them."""
    counts = np.zeros(64 * width, np.int64)
    for i in range(0, len(found), 1 << 13):
        part = found[i : i + (1 << 13), None] + np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")


WORDS = [f"f{i}" for i in range(WIDE)]
MORE = [f"f{i}" for i in range(WIDE, WIDEST)]


def sketches(rows: DataFrame, size: int = SET_SHINGLE) -> DataFrame:
    """``rows`` with ``set`` (128-bit digest of the shingle set), its ``size``, its ``bottom`` hashes and the WIDEST words of
    its fingerprint."""

    def work(texts):
        import xxhash

        sets = [shingle_set(t, size) for t in texts]
        marks = np.array([wide_fingerprint(s, WIDEST) for s in sets], np.uint64).reshape(-1, WIDEST).view(np.int64)
        bottom = pa.array([s[:BOTTOM].view(np.int64) for s in sets], pa.list_(pa.int64()))
        return [[xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], [len(s) for s in sets], bottom, *(pa.array(c) for c in marks.T.copy())]

    fields = [T.StructField("set", T.StringType()), T.StructField("size", T.LongType()), T.StructField("bottom", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in WORDS + MORE)]
    return with_columns(rows, "text", work, fields)


def may_have_partners(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``sets`` (key, size, bottom, ...) that share enough of their smallest hashes with others to be as similar to one.

    Only hashes and keys are shuffled; a hash that many sets have is counted before, and its join's rows may be split."""
    values = sets.select("key", "size", F.explode("bottom").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    found = values.join(shared, "value", "left_semi").groupBy("key", "size").agg(F.count("*").alias("n"))
    enough = found.where(F.col("n") >= F.least(F.lit(LEAST_SHARED), F.ceil(F.lit(similarity) * F.col("size") - 1e-9)))
    return sets.join(enough.select("key"), "key", "left_semi")


def dealt(sets: DataFrame, picks: np.ndarray, first: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, key, root, words and the columns of ``more``): each set of ``sets`` in its bucket of every table from the ``first``."""
    count, bits = picks.shape
    names = ["bucket", "key", "root", *WORDS, *more]

    def run(batches: Iterator[pa.RecordBatch]):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                columns = batch.slice(at, 4096).columns
                words = np.stack([c.to_numpy() for c in columns[2 : 2 + WIDE]], 1)
                flat = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                for t in range(first, count):
                    bucket = flat[:, picks[t]].astype(np.int64) @ weight + (t << bits)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], names=names)

    return sets.select("key", "root", *WORDS, *more).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def parted(placed: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``placed`` with buckets over ``max_bucket`` rows cut into parts by key: a bucket (below zero) for every two of them."""
    cell = F.pmod("bucket", F.lit(1 << 16))  # counted first by fewer, wider cells, whose partial sums are small
    wide = cut(placed.groupBy(cell.alias("cell")).count().where(F.col("count") > max_bucket).select("cell"), "cells")
    if wide.isEmpty():
        return placed
    counts = placed.join(wide, cell == F.col("cell"), "left_semi").groupBy("bucket").count().where(F.col("count") > max_bucket)
    hot = cut(counts.select("bucket", F.ceil(F.col("count") / max_bucket).alias("parts")), "hot")
    if hot.isEmpty():
        return placed
    split = placed.join(hot, "bucket").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return placed.join(hot, "bucket", "left_anti").unionByName(split.withColumn("bucket", pair.bitwiseOR(F.lit(-(1 << 63)))).select(placed.columns))


def _first_met(differ: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether no table before ``table`` picks only bits that are 0 in ``differ``; always, below zero."""
    keep = np.ones(len(differ), bool)
    for at in range(0, len(differ), 1 << 12):
        part = slice(at, at + (1 << 12))
        agree = ~(differ[part, None] & masks).any(2)
        keep[part] = (table[part] < 0) | (agree.argmax(1) == table[part])
    return keep


def close_pairs(placed: DataFrame, picks: np.ndarray, similarity: float = SIMILARITY, every: bool = False) -> DataFrame:
    """(u, v), keys within the radius of ``similarity`` and of different roots: a spanning forest of each bucket, or all pairs
    that their further words and sizes (MORE and size in ``placed``) don't rule out."""
    bits, radius, far = picks.shape[1], radius_of(similarity), radius_of(similarity, 64 * WIDEST)
    masks = np.zeros((len(picks), 64 * WIDE), np.uint8)
    np.put_along_axis(masks, picks, 1, 1)
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")

    def pairs(index, label, bucket, words, size):
        for a, b in index.apart(radius, label):
            keep = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            a, b = a[keep], b[keep]
            keep = _count(words[a] ^ words[b]) <= far
            a, b = a[keep], b[keep]
            keep = _first_met(words[a, :WIDE] ^ words[b, :WIDE], bucket[a] >> bits, masks)
            yield a[keep], b[keep]

    def run(batches: Iterator[pa.RecordBatch]):
        for bucket, key, root, *rest in _whole_buckets(batches):
            words = np.stack(rest[:WIDEST] if every else rest, 1).view(np.uint64)
            order = gray_order(bucket, words[:, :WIDE])
            bucket, key, root, words = bucket[order], key[order], root[order], words[order]
            index = GrayIndex(bucket, words[:, :WIDE])
            _, first, which = np.unique(np.stack([bucket, root], 1), axis=0, return_index=True, return_inverse=True)
            label = first[which.ravel()]
            if every:
                found = pairs(index, label, bucket, words, rest[WIDEST][order])
            else:
                found = [index.components(radius, None if len(first) == len(key) else label)[1:]]
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[a], key[b])), pa.array(np.maximum(key[a], key[b]))], names=["u", "v"])

    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


class _Sets(dict):
    """Shingle sets by text; emptied at KEPT_BYTES."""

    def __init__(self, size: int):
        self.size, self.bytes = size, 0

    def __missing__(self, text: bytes) -> np.ndarray:
        found = shingle_set(text, self.size)
        self.bytes += len(text) + found.nbytes
        if self.bytes > KEPT_BYTES:
            self.clear()
            self.bytes = len(text) + found.nbytes
        self[text] = found
        return found


def confirmed(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, size: int = SET_SHINGLE, least: float = SIMILARITY, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The ``pairs`` (u, v; written) of keys whose ``texts`` (key, text) have a similarity of ``least`` or more; ``sizes``
    (key, size) rule out most of the others without the texts. Only texts of pairs are shuffled, unless there are so many
    pairs that they can't be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, pair, other = _Sets(size), None, None
        for batch in batches:
            us, vs = [], []
            for u, v, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if pair != (u, v):
                    pair, other = (u, v), text
                elif jaccard(known[other], known[text]) >= least:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    alike = F.least("m", "n") >= F.greatest("m", "n") * F.lit(least)
    few = pairs.count() <= broadcast_pairs
    pairs = pairs.join(sizes.toDF("u", "m"), "u").join(sizes.toDF("v", "n"), "v").where(alike)
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("key"))
    both = texts.join(F.broadcast(ends) if few else ends, "key").select("u", "v", "text")
    return both.repartition("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long")


def similar_links(sets: DataFrame, texts: DataFrame, size: int = SET_SHINGLE, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Confirmed edges (u, v) that make the same components as all pairs of ``sets`` (key, size, words) which meet in a table,
    lie within the radius and are alike."""
    picks = tables(sets.count(), similarity)
    sizes, none = sets.select("key", "size"), sets.sparkSession.createDataFrame([], "u long, v long")
    edges = tested = none

    def rooted(found: DataFrame):
        return cut(sets.join(connected_components(edges).toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted") if found is not none else sets.withColumn("root", F.col("key"))

    def search(rows: DataFrame, start: int, end: int, every: bool = False):
        placed = parted(dealt(rows, picks[:end], start, (*MORE, "size") if every else ()), max_bucket)
        found = cut(close_pairs(placed, picks[:end], similarity, every), "found")  # apart from the join, whose sides may be dealt anew
        pairs = cut(found.distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
        good = cut(confirmed(pairs, texts, sizes, size, similarity), "links")
        return tested.unionByName(pairs), edges.unionByName(good)

    ends = [*EARLY, len(picks)]
    for start, end in zip([0, *ends], ends, strict=False):
        tested, edges = search(rooted(edges), start, end)
    failed = tested.join(edges, ["u", "v"], "left_anti")
    group = cut(connected_components(tested), "groups")
    doubtful = group.join(failed.select(F.col("u").alias("node")), "node", "left_semi").select("root").distinct()
    again = group.join(doubtful, "root", "left_semi").select(F.col("node").alias("key"))
    return search(rooted(edges).join(again, "key", "left_semi"), 0, len(picks), every=True)[1]


def first_rows(rows: DataFrame, size: int = SET_SHINGLE, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(row) of one row of ``rows`` (row, doc_id, text) for each group of near copies: that of the smallest doc_id (null
    ids last), then of the smallest hash of its text, then of the smallest row number.

    Texts without words are one group; repeated rows, null ids and reused ids are rows like any other."""
    with scratch(rows.sparkSession):
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row")
        marked = cut(sketches(rows.select("row", "text", order.alias("rank")), size).drop("text"), "sketches")
        sets = cut(marked.groupBy("set").agg(F.min("row").alias("key"), F.min("rank").alias("rank")), "sets")
        heads = marked.join(sets.select(F.col("key").alias("row")), "row", "left_semi").where("size > 0")
        heads = cut(heads.select(F.col("row").alias("key"), "size", "bottom", *WORDS, *MORE), "heads")
        heads = cut(may_have_partners(heads, similarity).drop("bottom"), "searched")
        texts = rows.select(F.col("row").alias("key"), "text")
        root = connected_components(similar_links(heads, texts, size, similarity, max_bucket)).toDF("key", "root")
        groups = sets.join(root, "key", "left").groupBy(F.coalesce("root", "key")).agg(F.min("rank").alias("rank"))
        return cut(groups.select("rank.row"), "firsts")
