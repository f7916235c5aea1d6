"""Memory of the piece encoder in a Python worker. The first and the last failed when segments and their parts were kept apart
and texts came back; the one between held before, too."""

import itertools
import tracemalloc

from netloom.llm import registry, sentencepiece_wfst

MODEL = f"{registry.TOKENIZERS}/piece_bpe_32k.model"
SYLLABLES = ["ka", "lo", "mi", "ren", "sto", "va", "pu", "tis"]


def test_a_kept_word_takes_one_small_entry():
    codec = sentencepiece_wfst.Codec(sentencepiece_wfst.read_model(MODEL))
    words = ["".join(x) for x in itertools.product(SYLLABLES, repeat=5)]
    codec.encode(" ".join(words[::20]))  # most pairs of pieces are known then
    tracemalloc.start()
    for i in range(0, len(words), 100):
        codec.encode(" ".join(words[i : i + 100]))
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 240 * len(words)


def test_what_a_store_drops_is_encoded_alike(monkeypatch):
    words = ["".join(x) for x in itertools.product(SYLLABLES, repeat=3)] * 2
    text = " ".join(f"{w}, ({w})" for w in words)
    model = sentencepiece_wfst.read_model(MODEL)
    want = sentencepiece_wfst.Codec(model).encode(text)
    for name in ("STORE_SEGMENTS", "STORE_PARTS"):
        monkeypatch.setattr(sentencepiece_wfst, name, 50_000)
    codec = sentencepiece_wfst.Codec(model)
    assert codec.encode(text) == want and codec.decode(want) == text
    assert not codec.store.keys() & codec.store.elder.keys()  # what moves on is kept once


def test_texts_need_not_come_back(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    model = sentencepiece_wfst.read_model(MODEL)
    rows = sentencepiece_wfst.encode(docs, model, keep_text=False)
    assert rows.columns == ["doc_id", "ids", "n_ids", "n_byte_ids", "round_trip"]
    assert sorted(rows.collect()) == sorted(sentencepiece_wfst.encode(docs, model).drop("text").collect())
