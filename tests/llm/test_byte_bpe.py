"""Byte-level BPE against the tokenizers library, over real texts, odd rows and every code point's class."""

import hashlib
import random
import struct

import numpy as np
import pytest

from netloom.llm import byte_bpe, registry

PATH = f"{registry.TOKENIZERS}/byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_vocabulary(PATH))


def ids_of(codec, text):
    (packed,) = codec.encode([text])
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_cuts_are_certain(codec):
    """A cut's byte pair is in no token; every other pair is in one."""
    inside = {t[i : i + 2] for t in codec.vocabulary.tokens.values() for i in range(len(t) - 1)}
    cuts = codec.cuts
    assert 0 < cuts.sum() < 1 << 16
    assert {bytes(divmod(int(i), 256)) for i in (~cuts).nonzero()[0]} == inside
    a, b = divmod(int(cuts.nonzero()[0][0]), 256)
    (other,) = [x for x in (b"th",) if x in inside]
    held = np.array([a, b, *other], np.int64)
    assert codec.fragments(held, np.array([0, 2])).tolist() == [0, 1, 2, 2]


@pytest.mark.parametrize("text", ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "it's  we'll\n\n\t x'S", "漢字かな交じり文 🙂🙂 ‍", "\x00\x1c\x85\xa0 　 a", "aaaa" * 500 + "b", "ab" * 3000, "ſ ﬁ ½ ² Ⅳ ٣", "�\U0010ffff"])
def test_texts_match_the_library(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(codec, text) == want
    assert codec.decode(codec.encode([text])[0]) == library.decode(want, skip_special_tokens=False) == text


def test_random_texts_match_the_library(codec, library):
    rng = random.Random(11)
    pools = ["abcdefgh'st ", " \t\n\r\x0b", "0123456789.,;", "äöüßéè", "漢字仮名交", "́‍🙂👩🏽", "".join(chr(a) for a, _ in byte_bpe.LATER)]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 90)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == want, text
        assert codec.decode(codec.encode([text])[0]) == text


def test_every_code_point_has_the_librarys_class(library):
    """Words of each code point between a letter, a number, a sign and spaces."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    step = 97  # and all where versions of Unicode differ
    probed = set(every[::step]) | {c for a, b in byte_bpe.LATER for c in (a - 1, a, b, b + 1)} | set(range(0x3100))
    for c in probed:
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}  "
        word = byte_bpe.WORD_LATER if byte_bpe.HAS_LATER.search(text) else byte_bpe.WORD
        assert [m.span() for m in word.finditer(text)] == [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)
        assert byte_bpe.WORD_LATER.findall(text) == word.findall(text)


def plain_merge(codec, fragment):
    ids = [int(codec.byte_id[b]) for b in fragment]
    while found := [(codec.vocabulary.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in codec.vocabulary.merges]:
        (_, made), at = min(found)
        ids[at : at + 2] = [made]
    return ids


def test_ways_of_merging_agree(codec):
    """Side by side, by the heap, and one pair after the other."""
    rng = random.Random(5)
    fragments = [bytes(rng.choice(b"etaoinshrdlu" if rng.random() < 0.8 else range(256)) for _ in range(rng.randint(1, 120))) for _ in range(400)] + [b"aaaaaaa", b"x"]
    want = [plain_merge(codec, f) for f in fragments]
    assert [codec.merge_long(f) for f in fragments] == want
    part = np.repeat(np.arange(len(fragments)), [len(f) for f in fragments])
    ids, of = codec.merge(codec.byte_id[np.frombuffer(b"".join(fragments), np.uint8)], part)
    assert [ids[of == i].tolist() for i in range(len(fragments))] == want
    assert [len(x) for x in codec.merge(ids[:0], of[:0])] == [0, 0]


def test_long_fragments_take_no_square(codec, library):
    text = "e" * 300_000 + " " + "th" * 100_000
    assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_store_is_bounded(codec, library, monkeypatch):
    store = byte_bpe.Store(4000)
    for i in range(5000):
        assert store.known({str(i)}) == {}
        store.add({str(i): b"1234"})
        assert store.known({str(i), "none"}) == {str(i): b"1234"}
        assert len(store.recent) + len(store.elder) <= 2 + 2 * 4000 // byte_bpe.ENTRY_BYTES
    monkeypatch.setattr(codec, "store", byte_bpe.Store(2000))
    monkeypatch.setattr(byte_bpe, "HELD_CHARACTERS", 50)
    texts = [f"word{i} and <|endoftext|>word{i % 7} {'long' * i}" for i in range(120)] + [""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in codec.encode(texts)] == want


def test_query_matches_the_library(spark, library):
    rows = registry.op11_byte_bpe(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows)) == sorted(want)


def test_odd_rows(spark):
    vocabulary = byte_bpe.read_vocabulary(PATH)
    rows = [(1, None, "x"), (None, "", "x"), (2, "same", "x"), (2, "same", "x"), (3, "long word " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    coded = byte_bpe.encode(docs, vocabulary)
    assert coded.columns == ["doc_id", "text", "tokens", "n_tokens"]
    found = byte_bpe.decode(byte_bpe.unpack(coded), vocabulary).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 100_001)]
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in found)
    assert [r.ids for r in found if r.doc_id == 2] == [[31642]] * 2
    assert byte_bpe.encode(docs.limit(0), vocabulary).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "tokens binary"), vocabulary).first().decoded is None


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.read_vocabulary(f"{registry.TOKENIZERS}/word_bpe_49k.json")
