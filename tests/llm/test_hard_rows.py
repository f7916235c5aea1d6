"""Rows that cost memory, time or calls before: common words, thousands of phrases, odd call messages, empty tables."""

import json
import random
import subprocess
import sys
import time

from netloom.llm import decontaminate, licences, tool_calls

CHAT = "conv_id long, turn long, role string, text string"


def test_common_words_take_bounded_memory():
    """1,000 phrases over a vocabulary of five words, in a process of its own."""
    code = """
import random, resource
from netloom.llm import decontaminate as d
rng = random.Random(1)
text = [bytes([97 + rng.randrange(5)]) for _ in range(20_000)]
segment = dict(zip(("doc_ids", "doc_starts", "n_words", "terms", "term_starts", "gaps"), d._segment([1, 2], [text[:12_000], text[12_000:]], 14)))
items = [(str(i), " ".join(rng.choice("abcde") for _ in range(10))) for i in range(1000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = d.search_row(segment, d.PhraseSet(items), 2)
print(len(out[4][0]), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    near, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=240).stdout.split())
    assert near > 900 and mb < 500


def brute(words, items, slack):
    """Exact (item, start) and near items of one document."""
    exact, near = set(), set()
    for item, text in items:
        want = text.split()
        for s in range(-slack, len(words)):
            if s >= 0 and words[s : s + len(want)] == want:
                exact.add((item, s))
            if all(any(0 <= p < len(words) and words[p] == w for p in range(s + k - slack, s + k + slack + 1)) for k, w in enumerate(want)):
                near.add(item)
    return exact, near


def test_chunks_of_candidates_lose_nothing(monkeypatch):
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") for _ in range(400)]
    items = [(str(i), " ".join(words[at : at + 10])) for i, at in enumerate(rng.sample(range(390), 12))]
    items += [(f"x{i}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 10)))) for i in range(40)]
    columns = ("doc_ids", "doc_starts", "n_words", "terms", "term_starts", "gaps")
    row = dict(zip(columns, decontaminate._segment([7], [[w.encode() for w in words]], 14), strict=True))
    want = brute(words, items, 2)
    for candidates in (5, 64, 1 << 19):
        monkeypatch.setattr(decontaminate.search_segment, "__defaults__", (candidates,))
        out = decontaminate.search_row(row, decontaminate.PhraseSet(items), 2)
        assert {(x["item_id"], x["start"]) for x in out[5][0]} == want[0] and len(out[5][0]) == len(want[0])
        assert set(out[4][0]) == want[1] and out[4][0] == sorted(out[4][0])
        assert set(out[3][0]) == {i for i, _ in want[0]}
        none = decontaminate.search_row(row, decontaminate.PhraseSet(items), 0)
        assert {(x["item_id"], x["start"]) for x in none[5][0]} == want[0] and none[4] == [[]]


def test_thousands_of_phrases_in_a_text_take_no_square(spark):
    docs = spark.createDataFrame([(1, "mit license " * 100_000), (2, None), (3, "cc by")], "doc_id long, text string")
    licences.scan(docs.where("doc_id = 3")).collect()
    began = time.time()
    rows = {r.doc_id: r for r in licences.scan(docs).select("doc_id", "n_base", "first_word", "last_word", "base_labels").collect()}
    assert time.time() - began < 30
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (100_000, 0, 199_998, "mit")
    assert (rows[2].n_base, rows[3].base_labels) == (0, "cc-by")


def test_the_sweep_equals_all_pairs():
    rng = random.Random(3)
    spans = [sorted(rng.sample(range(40), 2)) + [rng.randrange(5)] for _ in range(60)]
    want = [not any(c < b and a < d and f > e for c, d, f in spans) for a, b, e in spans]
    assert licences.standing_texts(*zip(*spans, strict=True)) == want and licences.standing_texts([], [], []) == []


def statuses(spark, rows):
    return sorted((r.conv_id, r.call_id, r.turn, r.result_turn, r.name, r.status) for r in tool_calls.link_messages(spark.createDataFrame(rows, CHAT)).collect())


def test_texts_that_only_look_like_calls_stay_turns(spark):
    call = json.dumps({"tool_calls": [{"id": "c", "name": "respond", "arguments": {"prompt": "x"}}]})
    texts = [call + " and more", '{"tool_calls": []}', '{"tool_calls": "none"}', '[{"tool_calls": 1}]', "tool_calls", '{"tool_calls": {"id": "c"}}']
    rows = [(i, t, role, text) for i, odd in enumerate(texts) for t, role, text in ((0, "user", "hello"), (1, "assistant", odd))]
    assert statuses(spark, rows) == [(i, "turn-0", 0, 1, "respond", "linked") for i in range(len(texts))]
    marked = [(9, 0, "user", "hello"), (9, 1, "assistant", call), (9, 2, "tool", '{"tool_call_id": "c", "content": "y"}'), (9, 3, None, "tool_calls"), (9, 4, "assistant", None)]
    assert statuses(spark, marked) == [(9, "c", 1, 2, "respond", "linked"), (9, "turn-0", 0, None, "respond", "missing_result"), (9, "turn-3", None, 4, None, "orphan_result")]


def test_no_messages(spark):
    empty = spark.createDataFrame([], CHAT + ", name string, status string")
    assert tool_calls.link_messages(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", "y"), (1, 1, "assistant", "b", "x", "y")], CHAT + ", name string, status string")
    assert [(r.name, r.status) for r in tool_calls.link_messages(rows).collect()] == [("respond", "linked")]
