"""SentencePiece encoding and decoding with weighted finite-state transducers over the tropical semiring.

Compiled from the model file, on the driver:

* the normaliser N = R o W: R rewrites by the model's character map, a trie whose final states emit the replacement, the
  longest match at each place and any other character as it is (user-defined pieces go before it); W turns spaces into
  space marks, squeezes runs of them and adds the dummy prefix, as the model says;
* the piece transducer P: a trie of the pieces, each final state emitting its id. A unigram piece weighs minus its score.
  The pieces of a merge (BPE) model have no additive scores: there P is composed with an acceptor M over neighbouring
  pieces that gives weight 0 to a pair which merging leaves apart and infinity to one which it would join across;
* byte fallback B: a character outside P is rewritten to its UTF-8 byte pieces, at a weight below every piece.

Each input is composed with N o P o M o B lazily, and the single-source shortest path in the (min, +) semiring is its
encoding. Under M every prefix has one finite state, so a merge model's path is unique and equals what merging by rank
yields. Where no piece spans two neighbouring characters (before a run of space marks, around a line break) every path
passes through one state; the composition is cut there and the shortest paths of the parts are kept, as the bytes of their
ids, in one store that is bounded in bytes.

Defined results: very long texts are taken whole; extra columns stay, but those named as a result are replaced; null text has null ids and decodes to null; empty text has no ids; repeated rows each get a result.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from dataclasses import dataclass, field
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import with_columns

SPACE = "▁"
INFINITY = float("inf")
#: Bytes of whole texts (where pieces span spaces, so that nothing is cut) or else of their parts, with their ids, and
#: neighbouring pieces that a Python worker keeps.
STORE_SEGMENTS, STORE_PARTS, STORE_PAIRS = 32 << 20, 72 << 20, 250_000
#: Bytes of an entry besides its text and its ids: the dict's, and what is rounded up.
ENTRY_BYTES = 80
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


@dataclass
class Model:
    """What a model file says: pieces in id order with scores and kinds, and the normaliser's switches."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int
    dummy_prefix: bool = True
    squeeze: bool = False
    escape: bool = True
    byte_fallback: bool = True
    unknown_surface: str = " ⁇ "
    rewrites: dict[str, str] = field(default_factory=dict)


def read_model(path: str) -> Model:
    """Read a .model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are compiled")
    return Model(
        [p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type,
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, m.trainer_spec.byte_fallback, m.trainer_spec.unk_surface, character_map(spec.precompiled_charsmap),
    )


def character_map(blob: bytes) -> dict[str, str]:
    """Source and replacement strings of a compiled character map: the size of a double-array trie, its 32-bit units, and
    the replacements, each ended by a zero byte. Of a unit, bits 10-30 (shifted by 8 more if bit 9 is set) lead to its
    children, who lie at that place xor their byte; bit 8 tells of a value in the child 0."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, pool = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    found, open_ = {}, [(0, b"")]
    while open_:
        at, source = open_.pop()
        unit = units[at]
        base = at ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if unit & 0x100 and source:
            start = units[base] & 0x7FFFFFFF
            found[source] = pool[start : pool.index(0, start)]
        for byte in range(1, 256):
            child = base ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                open_.append((child, source + bytes([byte])))
    return {k.decode(): v.decode() for k, v in found.items()}


class Normaliser:
    """N: a text as the symbols that pieces are made of."""

    def __init__(self, model: Model):
        self.model, self.trie = model, {}
        own = [(p, p) for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER_DEFINED and p] if model.rewrites else []
        for source, target in [*model.rewrites.items(), *own]:
            state = self.trie
            for c in source:
                state = state.setdefault(c, {})
            state[None] = target
        self.firsts = frozenset(self.trie)

    def rewrite(self, text: str) -> str:
        """R: output of the longest match at each place."""
        if self.firsts.isdisjoint(text):
            return text
        out, at, n = [], 0, len(text)
        while at < n:
            state, end, best, to = self.trie.get(text[at]), at + 1, text[at], at + 1
            while state is not None:
                if None in state:
                    best, to = state[None], end
                if end == n:
                    break
                state = state.get(text[end])
                end += 1
            out.append(best)
            at = to
        return "".join(out)

    def spaced(self, text: str) -> str:
        """N before spaces turn into space marks: most texts and their parts then take a byte a character."""
        m = self.model
        text = self.rewrite(text)
        if m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return " " + text if m.dummy_prefix and text else text

    def marked(self, text: str) -> str:
        return text.replace(" ", SPACE) if self.model.escape else text

    def __call__(self, text: str) -> str:
        return self.marked(self.spaced(text))


class PieceTransducer:
    """P o M o B, composed lazily with one part of a text at a time."""

    def __init__(self, model: Model):
        self.model = model
        usable = [(i, p) for i, p in enumerate(model.pieces) if p and model.kinds[i] in (NORMAL, USER_DEFINED, UNUSED)]
        self.id_of = {p: i for i, p in usable if model.kinds[i] != UNUSED}
        self.rank = {p: -model.scores[i] for i, p in usable}
        self.longest = max((len(p) for p in self.id_of), default=1)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.floor = max((-s for i, s in enumerate(model.scores) if model.kinds[i] == NORMAL), default=0.0) + UNKNOWN_PENALTY
        self.trie: dict = {}
        self.reachable: set[str] = set()
        self.reach: dict[str, int] = {}  # longest piece by its first three characters
        for p, i in self.id_of.items():
            if model.algorithm == BPE and len(p) > 1 and len(self.merged(p)) > 1:
                continue  # merging never reaches this piece
            self.reachable.add(p)
            if len(p) > 2:
                self.reach[p[:3]] = max(self.reach.get(p[:3], 3), len(p))
            if model.algorithm == BPE:
                continue  # its path looks pieces up whole
            state = self.trie
            for c in p:
                state = state.setdefault(c, {})
            state[None] = i
        self.spanned = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.cut, self.part = self._parts()
        self.shared = {p: p for p in self.rank}  # each to itself, so that kept steps share the pieces' strings
        self.apart_store: dict[str, dict[str, bool]] = {}
        self.apart_size = 0
        self.step_store: dict[str, tuple[tuple[float, ...], tuple[str, ...], tuple[str, ...]]] = {}

    def _parts(self) -> tuple[bool, re.Pattern]:
        """Parts of a text between places that no piece spans: before space marks (or the spaces that turn into them) and signs,
        around line breaks. False, and whole texts, if there are none."""
        before: dict[str, set[str]] = {}
        for a, b in self.spanned:
            before.setdefault(b, set()).add(a)
        lone = "".join(c for c in "\n\t\r" if not any(c in pair for pair in self.spanned))
        signs = {c for p in self.id_of for c in p if c != SPACE and unicodedata.category(c)[0] not in "LMC" and unicodedata.category(c) != "Nd"}
        while bad := {c for c in signs if before.get(c, set()) - signs - {SPACE}}:
            signs -= bad
        if before.get(SPACE, set()) - {SPACE}:
            return False, re.compile("(?s).+")
        lone, sign = re.escape(lone), self._ranges(signs, {SPACE, " ", *lone})
        space = f" {SPACE}" if self.model.escape else SPACE
        other = f"[^{space}{lone}{sign}]"
        some = f"[{sign}]*" if sign else ""
        fine = [f"[{space}]+{some}{other}*", f"{other}+"] + [f"[{sign}]+{other}*"] * bool(sign) + [f"[{lone}]"] * bool(lone)
        return True, re.compile("|".join(fine))

    def _ranges(self, signs: set[str], others: set[str]) -> str:
        """Inside of a character class of ``signs``: few ranges, since classes of single characters beyond U+FFFF are searched
        one by one. With byte fallback a range may hold characters of no piece, which no piece spans either."""
        known = sorted({c for p in self.id_of for c in p} | signs | others)
        runs, last = [], ""
        for c in known:
            if c in signs:
                if last in signs and (self.model.byte_fallback or ord(c) == ord(last) + 1):
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
            last = c
        return "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in runs)

    def steps(self, piece: str) -> tuple[tuple[float, ...], tuple[str, ...], tuple[str, ...]]:
        """Merging the piece alone: the rank of each step, infinity at the end, and the first and the last symbol before it."""
        found = self.step_store.get(piece)
        if found is None:
            ranks, firsts, lasts = [], [], []

            def watch(symbols, least):
                ranks.append(least)
                firsts.append(self.shared.get(symbols[0], symbols[0]))
                lasts.append(self.shared.get(symbols[-1], symbols[-1]))

            self.merged(piece, watch)
            found = self.step_store[self.shared.get(piece, piece)] = tuple(ranks), tuple(firsts), tuple(lasts)
        return found

    def merged(self, text: str, watch=None) -> list[str]:
        """Symbols left when the neighbours that make the lowest-ranked piece are joined, leftmost first, until none is left.
        ``watch`` sees the symbols before each step, and its rank; and the end, at infinity."""
        symbols, rank = list(text), self.rank.get
        costs = [rank(a + b, INFINITY) for a, b in zip(symbols, symbols[1:], strict=False)]
        while (least := min(costs, default=INFINITY)) < INFINITY:
            if watch:
                watch(symbols, least)
            at = costs.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank(symbols[at - 1] + symbols[at], INFINITY)
            if at < len(costs):
                costs[at] = rank(symbols[at] + symbols[at + 1], INFINITY)
        if watch:
            watch(symbols, INFINITY)
        return symbols

    def apart(self, left: str, right: str) -> bool:
        """M: weight 0 (True) if merging leaves the neighbours apart."""
        if left[-1] + right[0] not in self.spanned:
            return True
        known = self.apart_store.get(left)
        if known is None:
            known = self.apart_store[self.shared.get(left, left)] = {}
        found = known.get(right)
        if found is None:
            self.apart_size += 1
            if self.apart_size > STORE_PAIRS:
                self.apart_store, self.apart_size, known = {}, 0, {}
            found = known[self.shared.get(right, right)] = self.stays_apart(left, right)
        return found

    def stays_apart(self, left: str, right: str) -> bool:
        """Until a step joins across the boundary, merging both is the steps of either alone, in the order of their ranks and
        of equals the leftmost; so what stands at the boundary is known at each step, and is looked up there."""
        before, _, lasts = self.steps(left)
        after, firsts, _ = self.steps(right)
        rank, i, j = self.rank.get, 0, 0
        while True:
            across = rank(lasts[i] + firsts[j], INFINITY)
            if before[i] <= after[j]:
                if across < before[i]:
                    return False
                if before[i] == INFINITY:
                    return True
                i += 1
            elif across <= after[j]:
                return False
            else:
                j += 1

    def arcs(self, text: str, at: int) -> list[tuple[int, int | None]]:
        """(end, piece id or None) of P's paths from ``at``, short ones first; a character of no piece is a path of its own."""
        state, end, out = self.trie.get(text[at]), at + 1, []
        while state is not None:
            piece = state.get(None)
            if piece is not None:
                out.append((end, piece))
            if end == len(text):
                break
            state = state.get(text[end])
            end += 1
        return out if out and out[0][0] == at + 1 else [(at + 1, None), *out]

    def shortest_path(self, text: str) -> list[str]:
        """Pieces and lone characters on the tropical shortest path through ``text``."""
        return self._merge_path(text) if self.model.algorithm == BPE else self._weighted_path(text)

    def _weighted_path(self, text: str) -> list[str]:
        """Relaxation in order of place: the lattice has no cycle. Of equal paths to a place, the longest last piece stays."""
        n = len(text)
        cost, back = [0.0] + [INFINITY] * n, [0] * (n + 1)
        for at in range(n):
            for end, piece in self.arcs(text, at):
                weight = self.floor if piece is None else -self.model.scores[piece]
                if cost[at] + weight < cost[end]:
                    cost[end], back[end] = cost[at] + weight, at
        path, at = [], n
        while at:
            path.append(text[back[at] : at])
            at = back[at]
        return path[::-1]

    def _merge_path(self, text: str) -> list[str]:
        """Best-first search where weights are 0 or infinity, long arcs first: the first path to the end is the shortest.

        Each place has one finite state, so a place that led nowhere is not entered again.
        """
        n, pieces, reach, apart = len(text), self.reachable, self.reach, self.apart
        path: list[str] = []
        before: list[tuple[int, int]] = []  # place and arc end of each step taken
        seen = bytearray(n + 1)
        at, left, known = 0, "", {}  # known: the store's neighbours of left
        end = min(n, reach.get(text[:3]) or (2 if text[:2] in pieces else 1))
        while True:
            while end > at:
                if not seen[end]:
                    own = text[at:end]
                    if own in pieces or end == at + 1:
                        fits = known.get(own) if left else True
                        if fits or fits is None and apart(left, own):
                            break
                end -= 1
            if end > at:
                path.append(own)
                if end == n:
                    return path
                seen[end] = 1
                before.append((at, end))
                at, left = end, own
                end = min(n, at + (reach.get(text[at : at + 3]) or (2 if text[at : at + 2] in pieces else 1)))
            else:
                at, end = before.pop()
                path.pop()
                left, end = path[-1] if path else "", end - 1
            known = self.apart_store.get(left, {})

    def encode_part(self, text: str) -> list[int]:
        out: list[int] = []
        lone = False
        for piece in self.shortest_path(text):
            i = self.id_of.get(piece)
            if i is None and self.model.byte_fallback:
                out.extend(self.byte_id[b] for b in piece.encode("utf-8", "replace"))
            elif i is not None or not lone:  # neighbouring unknown characters share one unknown id
                out.append(self.unknown if i is None else i)
            lone = i is None
        return out


class Codec:
    """Encoder and decoder of whole texts; made anew in every Python worker from the model's pieces."""

    def __init__(self, model: Model):
        self.model, self.normalise, self.transducer = model, Normaliser(model), PieceTransducer(model)
        transducer, marked = self.transducer, self.normalise.marked

        class Store(dict):
            """Bytes of ids by text; at half of ``limit`` bytes it becomes the elder generation, and what is still used moves on."""

            def __init__(self, encode, limit):
                self.encode, self.limit, self.elder, self.size = encode, limit // 2, {}, 0

            def __missing__(self, text):
                ids = self.elder.pop(text, None)
                if ids is None:
                    ids = array("i", self.encode(text)).tobytes()
                self.size += (own := ENTRY_BYTES + getsizeof(text) + getsizeof(ids))
                if self.size > self.limit:
                    self.elder = dict(self)
                    self.clear()
                    self.size = own
                self[text] = ids
                return ids

        self.store = Store(lambda text: transducer.encode_part(marked(text)), STORE_PARTS if transducer.cut else STORE_SEGMENTS)
        kinds = model.kinds
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else model.unknown_surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(model.pieces, kinds, strict=True)
        ]

    def __reduce__(self):
        return Codec, (self.model,)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers side by side, so that no object is made for each."""
        return b"".join(map(self.store.__getitem__, self.transducer.part.findall(self.normalise.spaced(text))))

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else memoryview(self.encode_bytes(text)).cast("i").tolist()

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


ENCODED = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_ids", T.IntegerType()),
    T.StructField("n_byte_ids", T.IntegerType()),
    T.StructField("round_trip", T.BooleanType()),
]


def encode(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with ids, n_ids, n_byte_ids (byte pieces) and round_trip (whether the ids decode to the text), and without
    text if not ``keep_text``: then texts don't come back from the Python workers.

    A model that squeezes spaces or has no byte fallback does not give back every text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(model))

    def work(texts):
        codec = shared.value
        is_byte = np.array(codec.model.kinds) == BYTE
        strings = [None if t is None else t.decode("utf-8", "replace") for t in texts]
        coded = [None if s is None else codec.encode_bytes(s) for s in strings]
        flat = np.frombuffer(b"".join(c for c in coded if c), np.int32)
        offsets = np.cumsum([0, *(len(c or b"") // flat.itemsize for c in coded)])
        null = pa.array([c is None for c in coded])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=null)
        n_bytes = np.diff(np.r_[0, np.cumsum(is_byte[flat])][offsets]) if len(flat) else np.zeros(len(coded), int)
        return [
            ids,
            pa.array(np.diff(offsets), pa.int32(), mask=null.to_numpy(zero_copy_only=False)),
            pa.array(n_bytes, pa.int32(), mask=null.to_numpy(zero_copy_only=False)),
            pa.array([None if c is None else codec.decode(memoryview(c).cast("i")) == s for c, s in zip(coded, strings, strict=True)], pa.bool_()),
        ]

    return with_columns(docs, "text", work, ENCODED, keep_text)


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``decoded``, the text of the column ``ids``; null ids decode to null, ids out of range fail."""
    shared = rows.sparkSession.sparkContext.broadcast(Codec(model))

    import pandas as pd  # here, so that workers which encode don't load it

    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(shared.value.decode, na_action="ignore")

    text_of.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    text_of = F.pandas_udf(text_of, "string")
    return rows.withColumn("decoded", text_of("ids"))
