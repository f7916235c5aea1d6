"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments, each made in one task from about ``SEGMENT_WORDS`` words of whole documents: all its
terms, their sorted postings (places in the segment) and the documents' places. It can be kept for later benchmarks
(``search``). Segments are disjoint, so a search
reads each once, without a shuffle. A phrase is searched from its rarest term in the segment: that term's postings,
less the term's offset, are the candidate starts, which the other terms' offset-adjusted postings then thin out, from
rare to common. Exact matches need every term at its offset; a proximity match is a start from which every term stands
at most ``slack`` places off its offset. Documents are set apart by a gap, so no match crosses from one to the next.

The phrase set travels to the tasks in blocks of about ``BLOCK_WORDS`` words, so its size is bounded; further blocks
are further passes over the index, and hits are united per document. Long items are cut into pieces of ``PIECE_WORDS``
windows, so one item may fill many blocks.

Defined results: columns of the documents other than doc_id are dropped; very long texts are taken whole, in a segment of
their own; null or empty texts have no words and no hits; a null phrase id or text makes no phrase; repeated
rows each get a result; an empty phrase table leaves every document clean.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, slices, words
from netloom.shared import SMALL_GROUPS

WINDOW = 10
SLACK = 2
SEGMENT_WORDS = 1 << 18
BLOCK_WORDS = 1 << 20
PIECE_WORDS = 1 << 14
#: Candidate places of a segment that are held at a time.
CANDIDATES = 1 << 19
#: How an index is written. A segment is a row of megabytes, and Parquet looks at the size of what it holds after 100 rows
#: only: a task would write, and read back, a partition as one page. Here sizes are looked at row by row.
WRITTEN = SMALL_GROUPS | {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def _schema(docs_or_index: DataFrame, text: str) -> str:
    """A schema text in which ID stands for the type of the documents' ids."""
    kind = docs_or_index.schema["doc_id"].dataType if "doc_id" in docs_or_index.columns else docs_or_index.schema["doc_ids"].dataType.elementType
    return text.replace("ID", kind.simpleString())


SEGMENT_SCHEMA = "segment string, doc_ids array<ID>, doc_starts array<int>, n_words array<int>, terms array<string>, term_starts array<int>, gaps array<int>"
HIT_SCHEMA = (
    "segment string, ordinal int, doc_id ID, n_words bigint, n_hit bigint, items array<string>, near_items array<string>, "
    "spans array<struct<item_id:string,start:int,length:int>>"
)


def _segment(ids: list, tokens: list[list[bytes]], gap: int) -> list:
    """One index row: documents are laid end to end with ``gap`` free places after each."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(np.r_[0, lengths + gap])[:-1]
    number: dict[bytes, int] = {}
    code = np.array([number.setdefault(w, len(number)) for doc in tokens for w in doc], np.int32)
    place = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(code))
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    used, first = np.unique(code, return_index=True)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    names = np.array(list(number), object)
    return [ids, starts, lengths, [w.decode("utf-8", "replace") for w in names[used]], np.r_[first, len(code)], gaps]


def build_index(docs: DataFrame, gap: int = WINDOW + 2 * SLACK, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of ``docs`` (doc_id, text), with free places of ``gap``, at least a window and two slacks, between documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]):
        kinds = [pa.string(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["segment", "doc_ids", "doc_starts", "n_words", "terms", "term_starts", "gaps"]

        def emit():
            row = [uuid.uuid4().hex, *_segment(ids, tokens, gap)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        ids, tokens, total = [], [], 0
        for part, texts in slices(batches, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                found = words(text or b"")
                ids.append(doc_id)
                tokens.append(found)
                total += len(found) + gap
                if total >= segment_words:
                    yield emit()
                    ids, tokens, total = [], [], 0
        if ids:
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, SEGMENT_SCHEMA))


def windows(items: list[tuple[str, str]], size: int = WINDOW) -> tuple[list[str], list[tuple[bytes, ...]]]:
    """Item and words of every window: ``size`` consecutive words, or all words of a shorter item."""
    seen: dict[tuple, None] = {}
    for item, text in items:
        found = words((text or "").encode()) if item is not None else []
        seen.update(((item, tuple(found[i : i + size])), None) for i in range(max(1, len(found) - size + 1)) if found)
    return [item for item, _ in seen], [w for _, w in seen]


class PhraseSet:
    """Phrases as padded arrays of term numbers."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.owner, phrases = windows(items, size)
        self.items = sorted(set(self.owner))
        number = {item: i for i, item in enumerate(self.items)}
        self.item = np.array([number[x] for x in self.owner], np.int64)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for p in phrases for w in p}))}
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.terms = np.full((len(phrases), size), -1, np.int64)
        for i, p in enumerate(phrases):
            self.terms[i, : len(p)] = [self.vocabulary[w] for w in p]


class Postings:
    """A segment's postings of a phrase set's terms as one sorted array of (term, place) keys."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        starts = np.asarray(row["term_starts"])
        number = np.array([vocabulary.get(t.encode(), -1) for t in row["terms"]], np.int64)
        sums = np.cumsum(row["gaps"], dtype=np.int64)
        before = np.r_[0, sums][starts[:-1]]
        counts = np.diff(starts)
        place = sums - np.repeat(before, counts)
        term = np.repeat(number, counts)
        keep = term >= 0
        self.span = int(place.max(initial=0)) + 1 + 4 * (WINDOW + SLACK)
        key = term[keep] * self.span + place[keep]
        self.key = np.sort(key)
        self.first = np.searchsorted(self.key, np.arange(len(vocabulary) + 1) * self.span)

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a posting of ``term`` lies in low..high."""
        low = np.maximum(low, 0)
        at = np.searchsorted(self.key, term * self.span + low)
        found = self.key[np.minimum(at, len(self.key) - 1)] if len(self.key) else np.full(len(at), -1)
        return (at < len(self.key)) & (found <= term * self.span + high)


def search_segment(row: dict, phrases: PhraseSet, slack: int, candidates: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, start, exact) of places from which every term lies within ``slack`` of its offset, and whether all lie at it;
    a place may come several times. Candidate places are looked at by ``candidates`` at a time, however common the terms are."""
    index = Postings(row, phrases.vocabulary)
    count = np.diff(index.first)
    size = np.where(phrases.terms >= 0, count[phrases.terms], np.iinfo(np.int64).max)
    rank = np.argsort(size, axis=1, kind="stable")
    rarest = rank[:, 0]
    live = np.flatnonzero(np.min(size, axis=1) > 0)
    term = phrases.terms[live, rarest[live]]
    before = np.r_[0, np.cumsum(count[term])]
    shift = np.arange(-slack, slack + 1)  # the rarest term may be off as well
    step = max(1, candidates // len(shift))
    for at in range(0, int(before[-1]), step):
        flat = np.arange(at, min(at + step, int(before[-1])))
        which = np.searchsorted(before, flat, side="right") - 1
        phrase = live[which]
        start = index.key[index.first[term[which]] + flat - before[which]] - term[which] * index.span - rarest[phrase]
        phrase, start = np.repeat(phrase, len(shift)), (start[:, None] + shift).ravel()
        for k in range(1, rank.shape[1]):
            place = rank[phrase, k]
            other = phrases.terms[phrase, place]
            need = start + place
            keep = (other < 0) | index.holds(np.maximum(other, 0), need - slack, need + slack)
            phrase, start = phrase[keep], start[keep]
        exact = np.ones(len(phrase), bool)
        for place in range(rank.shape[1]) if slack else ():
            other = phrases.terms[phrase, place]
            exact &= (other < 0) | index.holds(np.maximum(other, 0), start + place, start + place)
        yield phrase, start, exact


def _covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Marks of the places in any span."""
    marks = np.zeros(total + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0


def search_row(row: dict, phrases: PhraseSet, slack: int) -> list[list]:
    """The hit columns of every document of a segment."""
    starts, n = np.asarray(row["doc_starts"], np.int64), np.asarray(row["n_words"], np.int64)
    out = [row["doc_ids"], n, np.zeros(len(n), np.int64), [[] for _ in n], [[] for _ in n], [[] for _ in n]]
    if not len(phrases.lengths) or not len(row["gaps"]):
        return out
    none, end, n_items = np.empty(0, np.int64), int(starts[-1] + n[-1]) + 1, len(phrases.items)
    found, near = [none], [none]
    for phrase, start, exact in search_segment(row, phrases, slack):
        found.append(np.unique(phrase[exact] * end + start[exact]))
        if slack:  # of the places, only the documents are told
            near.append(np.unique((np.searchsorted(starts, start + slack, side="right") - 1) * n_items + phrases.item[phrase]))
    phrase, start = np.divmod(np.unique(np.concatenate(found)), end)
    doc = np.searchsorted(starts, start, side="right") - 1
    order = np.lexsort((phrase, start))
    phrase, start, doc = phrase[order], start[order], doc[order]
    marks = _covered(start, phrases.lengths[phrase], int(starts[-1] + n[-1]))
    hit = np.add.reduceat(np.r_[marks, False], np.minimum(starts, len(marks)), dtype=np.int64) if len(marks) else out[2]
    hit[n == 0] = 0
    out[2] = hit
    for d, p, s in zip(doc.tolist(), phrase.tolist(), (start - starts[doc]).tolist(), strict=True):
        out[5][d].append({"item_id": phrases.owner[p], "start": s, "length": int(phrases.lengths[p])})
    for d in np.unique(doc).tolist():
        out[3][d] = sorted({x["item_id"] for x in out[5][d]})
    for d, i in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(near)), n_items)), strict=True):
        out[4][d].append(phrases.items[i])
    return out


def search_block(index: DataFrame, phrases: PhraseSet, slack: int = SLACK) -> DataFrame:
    """Hits of one bounded block of phrases: one row per document of the index."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = index.sparkSession.sparkContext.broadcast(phrases)
    id_type = to_arrow_type(index.schema["doc_ids"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
        kinds = [pa.string(), pa.int32(), id_type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(kind)]
        names = ["segment", "ordinal", "doc_id", "n_words", "n_hit", "items", "near_items", "spans"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) if c in ("doc_starts", "n_words", "term_starts", "gaps") else batch.column(c)[i].as_py() for c in batch.schema.names}
                out = search_row(row, shared.value, slack)
                out = [[row["segment"]] * len(out[0]), range(len(out[0])), *out]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return index.mapInArrow(run, _schema(index, HIT_SCHEMA))


def pieces(items: DataFrame, size: int = WINDOW, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item_id, piece, n, text): texts of ``items`` in pieces of ``piece_words`` windows; every window is in a piece."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text.encode())
                starts = range(0, max(1, len(found) - size + 1) if found else 0, piece_words)
                cuts = [found[i : i + piece_words + size - 1] for i in starts]
                columns = [item] * len(cuts), range(len(cuts)), [len(c) for c in cuts], [b" ".join(c).decode("utf-8", "replace") for c in cuts]
                kinds = pa.string(), pa.int32(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "piece", "n", "text"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "item_id string, piece int, n long, text string")


def phrase_blocks(items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[PhraseSet]]:
    """How many blocks of about ``block_words`` window words ``items`` (item_id, text) makes, and the blocks one by one."""
    rows = cut(pieces(items, size, min(PIECE_WORDS, max(1, block_words // size))), "pieces")
    n = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) * size // block_words))
    block = F.pmod(F.xxhash64("item_id", "piece"), F.lit(n))
    return n, (PhraseSet([tuple(r) for r in rows.where(block == i).select("item_id", "text").distinct().collect()], size) for i in range(n))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: n_words, n_hit (words in an exact window), items (ids with an exact window), near_items (ids
    with a window within ``slack``), spans of the exact windows, contaminated.
    """
    return search(cut(build_index(docs, size + 2 * slack), "postings", WRITTEN), items, size, slack, block_words)


def search(index: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``decontaminate`` over a written index whose gap is ``size`` + 2 ``slack`` at least."""
    n, blocks = phrase_blocks(items, size, block_words)
    if n == 1:
        return search_block(index, next(blocks), slack).drop("segment", "ordinal").withColumn("contaminated", F.col("n_hit") > 0)
    out = search_block(index, next(blocks), slack)
    for phrases in blocks:
        more = search_block(index, phrases, slack).where("n_hit > 0 OR size(near_items) > 0")
        out = out.unionByName(cut(more, "hits"))
    kept = out.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    out = kept.select("doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), "items", "near_items", "spans")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def digest(hits: DataFrame) -> DataFrame:
    """The per-document figures of ``decontaminate``; the last two are those of proximity matches."""

    def sha(names):
        return F.sha2(F.array_join(names, ",").cast("binary"), 256)

    exact = ["doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha("items").alias("items_sha256"), "contaminated"]
    return hits.select(*exact, F.size("near_items").cast("long").alias("n_near_items"), sha("near_items").alias("near_items_sha256"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: ``digest`` of documents and benchmark in DuckDB.
SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT DISTINCT doc_id, i, n, item FROM grams JOIN windows USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id),
numbered AS (SELECT item, gram, n, row_number() OVER () AS number FROM windows),
terms AS (SELECT item, number, n, j, string_split(gram, ' ')[j + 1] AS word FROM (SELECT *, unnest(range(n)) AS j FROM numbered)),
places AS (SELECT doc_id, p, w[p + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM docs)),
likely AS (SELECT doc_id, number FROM (SELECT DISTINCT doc_id, word FROM places) JOIN terms USING (word) GROUP BY doc_id, number, n HAVING count(DISTINCT j) = n),
near AS (SELECT DISTINCT doc_id, item FROM (SELECT doc_id, item, number, n, j, p - j + shift.range AS start FROM likely JOIN terms USING (number) JOIN places USING (doc_id, word), range(-{SLACK}, {SLACK} + 1) AS shift)
  GROUP BY doc_id, item, number, n, start HAVING count(DISTINCT j) = n),
near_named AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_names FROM near GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near_names, '')) AS near_items_sha256
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near_named USING (doc_id)
"""


def brute_force(text: str | None, items: list[tuple[str, str]], size: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """What ``digest`` says of one document, by plain comparison; for tests."""
    found = words((text or "").encode())
    owner, phrases = windows(items, size)
    hit, names = set(), set()
    for item, p in zip(owner, phrases, strict=True):
        for i in range(len(found) - len(p) + 1):
            if tuple(found[i : i + len(p)]) == p:
                hit |= set(range(i, i + len(p)))
                names.add(item)
    return len(found), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)
