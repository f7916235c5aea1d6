"""Byte-level BPE encoding and decoding by forced boundaries.

A merge never makes what is not inside some vocabulary token, so two neighbouring bytes that no token holds side by side
are never merged: a cut there is certain. The table of these pairs is made once from the vocabulary (``Vocabulary.cuts``).
A text is split at special tokens, then into the words of the vocabulary's pattern, then at the certain cuts; the
fragments are encoded independently by the merges and their ids concatenated. The fragments of all new words of some texts
are merged side by side in arrays; a long one goes through a heap of candidate merges, n log n in its length. Words
repeat and are kept with their ids in a store bounded in bytes.

Ids travel as ``tokens``, little-endian unsigned 32-bit integers, the layout of training shards. No shuffle; a worker
holds a slice of the batch, the store, and about 100 bytes a byte of the longest fragment.

Defined results: a null text counts as empty and has no tokens; a special token's string in a text is that token, as the
tokenizers library has it with its default settings; very long texts and words are taken whole; repeated rows each get
their own, equal result; extra columns stay, but a column with the name of a result is replaced; an empty table stays
empty. ``decode`` gives null for null; ids that the vocabulary does not have fail; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from netloom.llm.common import with_columns

#: Code points that are letters or numbers in later versions of Unicode than 16, the version of the library.
#: For it they are signs.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
#: Fixed pattern of the byte-level vocabularies; WORD_LATER is it with LATER among the signs.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LATER = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_LATER}]]+| ?[\p{{N}}--[{_LATER}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{_LATER}])+|\s+(?!\S)|\s+", flags=regex.V1
)
HAS_LATER = regex.compile(f"[{_LATER}]")


def has_later(text: str) -> bool:
    """Whether a text holds one of LATER; texts of the first 256 code points are told at once."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return HAS_LATER.search(text) is not None
    return False


#: Bytes of a Python worker's store, and what an entry is taken to cost besides its text and ids.
STORE_BYTES, ENTRY_BYTES = 80 << 20, 200
#: Fragments longer than this are merged through the heap, and longer words are not kept; characters of the texts whose words
#: are held at a time; a rank beyond all.
LONG, HELD_CHARACTERS, NONE = 64, 1 << 20, 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary's file: itself if it prints, else one from U+0100 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    shown = set(prints)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """``tokens``: bytes by id; ``merges``: (left id, right id) to (rank, id of both); ``special``: string to id."""

    tokens: dict[int, bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]

    def cuts(self) -> np.ndarray:
        """True at 256 * a + b if no token holds byte a right before byte b."""
        certain = np.ones(1 << 16, bool)
        for token in self.tokens.values():
            held = np.frombuffer(token, np.uint8).astype(np.int32)
            certain[held[:-1] * 256 + held[1:]] = False
        return certain


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE of the tokenizers library's JSON files; other settings than the ones read here are refused."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, split = data["model"], data["pre_tokenizer"]
    plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if not plain or odd or data["normalizer"] or data["post_processor"]:
        raise ValueError(f"{path} is no plain byte-level BPE {odd}")
    byte = {c: b for b, c in enumerate(byte_characters())}
    ids = model["vocab"]
    tokens = {i: bytes(map(byte.__getitem__, t)) for t, i in ids.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
    special = {}
    for added in data["added_tokens"]:
        if added["lstrip"] or added["rstrip"] or added["single_word"] or added["normalized"]:
            raise ValueError(f"{path}: settings of {added['content']} are not supported")
        special[added["content"]] = added["id"]
    return Vocabulary(tokens, merges, special)


class Store:
    """Values by word in two generations of ``limit`` bytes together; the elder one goes when the younger is full."""

    def __init__(self, limit: int):
        self.limit, self.recent, self.elder, self.size = limit // 2, {}, {}, 0

    def known(self, words: set[str]) -> dict[str, bytes]:
        """Those of ``words`` that are held; they count as used."""
        found = {w: self.recent[w] for w in words & self.recent.keys()}
        older = {w: self.elder[w] for w in (words - found.keys()) & self.elder.keys()}
        self.add(older)
        return found | older

    def add(self, values: dict[str, bytes]) -> None:
        for word, value in values.items():
            self.size += ENTRY_BYTES + 4 * len(word) + len(value)
            if self.size > self.limit:
                self.elder, self.recent, self.size = self.recent, {}, ENTRY_BYTES + 4 * len(word) + len(value)
            self.recent[word] = value


class Codec:
    """Encoder and decoder of a vocabulary, with what tasks of one worker share."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cuts = vocabulary, vocabulary.cuts()
        self.byte_id = np.zeros(256, np.int64)
        for i, token in vocabulary.tokens.items():
            if len(token) == 1:
                self.byte_id[token[0]] = i
        self.surface = vocabulary.tokens | {i: s.encode() for s, i in vocabulary.special.items()}
        # A pair of ids as one number, to its rank and the id of both as one number; lower is earlier.
        self.size = max(self.surface, default=0) + 1
        self.pairs = {a * self.size + b: rank * self.size + made for (a, b), (rank, made) in vocabulary.merges.items()}
        self.keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        found = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(f"({found})") if found else None
        self.store = Store(STORE_BYTES)

    def __reduce__(self):
        return Codec, (self.vocabulary,)

    def fragments(self, held: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The fragment of each byte: a fragment begins at each of ``starts`` and at every certain cut."""
        begins = np.zeros(len(held), bool)
        begins[1:] = self.cuts[held[:-1] * 256 + held[1:]]
        begins[starts] = True
        return np.cumsum(begins) - 1

    def _rank(self, ids: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and outcome of the pairs at ``at``; NONE for those that don't merge and for a fragment's last id."""
        following = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * self.size + ids[following]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        merges = (self.keys[place] == key) & (part[at] == part[following]) & (at + 1 < len(ids)) if len(self.keys) else np.zeros(len(at), bool)
        return np.where(merges, self.ranks[place] if len(self.keys) else NONE, NONE)

    def merge(self, ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments merged side by side: in a round each merges its pair of the lowest rank, the leftmost of
        equals, until it has none; what is finished is laid aside."""
        done, ranks = [(ids[:0], part[:0])], self._rank(ids, part, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.r_[first, len(ids)]))
            open_ = least != NONE
            done.append((ids[~open_], part[~open_]))
            ids, part, ranks, least = ids[open_], part[open_], ranks[open_], least[open_]
            at = np.flatnonzero(ranks == least)
            at = at[np.r_[True, part[at[1:]] != part[at[:-1]]]] if len(at) else at
            ids[at] = ranks[at] % self.size
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, part, ranks = ids[left], part[left], ranks[left]
            at -= np.arange(len(at))
            changed = np.r_[at, at[at > 0] - 1]
            ranks[changed] = self._rank(ids, part, changed)
        ids, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return ids[order], part[order]

    def merge_long(self, fragment: bytes) -> list[int]:
        """As ``merge`` for one fragment, with a heap of candidates and links to the neighbours that are left."""
        n, get, size = len(fragment), self.pairs.get, self.size
        ids = array("i", self.byte_id[np.frombuffer(fragment, np.uint8)].tolist())
        before, after = array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        heap = [m // size << 40 | i for i, m in enumerate(get(a * size + b) for a, b in zip(ids, ids[1:], strict=False)) if m is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, at = top >> 40, top & (1 << 40) - 1
            right = after[at]
            if ids[at] < 0 or right >= n or (m := get(ids[at] * size + ids[right])) is None or m // size != rank:
                continue  # one of the two has been merged since
            ids[at], ids[right], after[at] = m % size, -1, after[right]
            if after[at] < n:
                before[after[at]] = at
                if (m := get(ids[at] * size + ids[after[at]])) is not None:
                    heapq.heappush(heap, m // size << 40 | at)
            if (left := before[at]) >= 0 and (m := get(ids[left] * size + ids[at])) is not None:
                heapq.heappush(heap, m // size << 40 | left)
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of words, of all their fragments at once; long fragments one by one."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        held = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        part = self.fragments(held, starts)
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        length = np.diff(np.r_[begin, len(held)])
        short = length[part] <= LONG
        ids, of = self.merge(self.byte_id[held[short]], part[short])
        more = [(np.array(self.merge_long(held[begin[p] : begin[p] + length[p]].astype(np.uint8).tobytes()), np.int64), p) for p in np.flatnonzero(length > LONG).tolist()]
        if more:
            ids, of = np.concatenate([ids, *(x for x, _ in more)]), np.concatenate([of, *(np.full(len(x), p) for x, p in more)])
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        word = np.searchsorted(starts, begin[of], side="right") - 1
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode_some(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts that are held at a time."""
        special = {s: i.to_bytes(4, "little") for s, i in self.vocabulary.special.items()}
        split = [self.special.split(t) if self.special and any(s in t for s in special) else [t] for t in texts]
        spoken = [[x if k % 2 else (WORD_LATER if has_later(x) else WORD).findall(x) for k, x in enumerate(parts)] for parts in split]
        wanted = set().union(*(words for parts in spoken for words in parts[::2]))
        values = self.store.known(wanted)
        new = list(wanted - values.keys())
        made = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        self.store.add({w: v for w, v in made.items() if len(w) <= LONG})
        values |= made
        return [b"".join([special[x] if k % 2 else b"".join(map(values.__getitem__, x)) for k, x in enumerate(parts)]) for parts in spoken]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts, HELD_CHARACTERS or one text at a time."""
        out, start, total = [], 0, 0
        for i, text in enumerate(texts):
            total += len(text)
            if total >= HELD_CHARACTERS or i + 1 == len(texts):
                out += self.encode_some(texts[start : i + 1])
                start, total = i + 1, 0
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (packed ids of ``column``) and ``n_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(vocabulary))

    def work(texts):
        made = shared.value.encode([(t or b"").decode("utf-8", "replace") for t in texts])
        return [made, [len(m) // 4 for m in made]]

    return with_columns(docs, column, work, [T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``tokens``."""
    shared = rows.sparkSession.sparkContext.broadcast(Codec(vocabulary))

    def work(packed):
        return [pa.array([None if p is None else shared.value.decode(p) for p in packed], pa.string())]

    return with_columns(rows, "tokens", work, [T.StructField("decoded", T.StringType())])


def unpack(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids``, the numbers in ``tokens`` as an array."""

    def work(packed):
        return [pa.array([None if p is None else np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))]

    return with_columns(rows, "tokens", work, [T.StructField("ids", T.ArrayType(T.IntegerType()))])
