"""The operators against brute force, exact round trips and the cases that their docstrings define."""

import hashlib
import json
import os
import random
import re

import numpy as np
import pytest

from netloom.llm import components, decontaminate, langid, licences, registry, sentencepiece_wfst, simhash, token_rollups, tool_calls
from netloom.llm.common import words

SF = "/root/testdata/sf0.001"
MODEL = f"{registry.TOKENIZERS}/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, ids string, score string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "x", "x", "x") for i, t, lang in rows], DOCS)


ODD = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "word", "en"), (4, "word", "en"), (None, "no id here", None), (5, "Ünïcode ŁÓ 🙂 " * 3, "de"), (6, "long text " * 60_000, "en")]


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# simhash


def test_shingle_hash_is_sparks(spark):
    text = "One two  THREE four é"
    want = {r[0] & (1 << 64) - 1 for r in spark.sql("SELECT explode(array(xxhash64('one two three'), xxhash64('two three four'), xxhash64('three four é')))").collect()}
    assert set(simhash.shingle_hashes(text.encode()).tolist()) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == 0


def brute_components(codes, radius=3):
    label = list(range(len(codes)))
    while True:
        new = [min(label[j] for j in range(len(codes)) if bin(codes[i] ^ codes[j]).count("1") <= radius) for i in range(len(codes))]
        if new == label:
            return label
        label = new


def clustered_codes(rng, n=300):
    codes = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(codes) < n:
        code = rng.choice(codes)
        for _ in range(rng.randint(1, 5)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    return codes


def test_gray_index_links_like_brute_force():
    for seed in range(4):
        codes = list(dict.fromkeys(clustered_codes(random.Random(seed))))
        bucket = np.zeros(len(codes), np.int64)
        u, v = simhash.stars(bucket, np.array(codes, np.uint64))
        root = dict(zip(u.tolist(), v.tolist()))
        mine = [root.get(c, c) for c in codes]
        want = brute_components(codes)
        assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_links_through_buckets_and_hot_buckets(spark):
    codes = list(dict.fromkeys(clustered_codes(random.Random(9), 240)))
    fps = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    want = brute_components(codes)
    for limit in (1 << 18, 3):
        found = {r.node & (1 << 64) - 1: r.root for r in components.connected_components(simhash.links(fps, max_bucket=limit)).collect()}
        mine = [found.get(c, ("own", c)) for c in codes]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert by[None] == {(next(iter(by[None]))[0], None)}
    assert simhash.near_duplicates(docs_of(spark, []).where("false")).count() == 0


# decontamination


def test_decontamination_matches_brute_force(spark):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in real(spark).collect()}
    for block in (decontaminate.BLOCK_WORDS, 500):
        found = decontaminate.digest(decontaminate.decontaminate(real(spark), spark.read.parquet(f"{SF}/benchmark.parquet"), block_words=block)).collect()
        assert len(found) == len(texts)
        for r in [x for x in found if x.n_hit or x.doc_id % 9 == 0]:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == decontaminate.brute_force(texts[r.doc_id], items)
    assert any(r.contaminated for r in found)


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "no id HERE"), (2, None), (None, "word"), (3, ""), (4, "no id"), (5, "here word")], "item_id long, text string")
    rows = decontaminate.digest(decontaminate.decontaminate(docs_of(spark, ODD), items)).collect()
    assert len(rows) == len(ODD)
    none = next(r for r in rows if r.doc_id is None)
    assert (none.n_words, none.n_hit, none.n_items) == (3, 3, 2)
    assert none.items_sha256 == hashlib.sha256(b"1,4").hexdigest()
    assert all(not r.contaminated for r in rows if r.doc_id is not None)
    assert decontaminate.decontaminate(docs_of(spark, ODD), items.where("false")).where("contaminated").isEmpty()


def test_long_items_text_ids_and_an_index_kept(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(40)}" for _ in range(500)]
    items = [("long", " ".join(long)), ("short", "w1 w2"), ("twice", " ".join(long[:30] * 2))]
    docs = [(f"d{i}", " ".join(long[s : s + 30] + ["none"])) for i, s in enumerate(range(0, 470, 13))] + [("all", " ".join(long)), (None, "w1 w2"), ("empty", "")]
    frame, table = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.cut(decontaminate.build_index(frame), "index")
    for block in (decontaminate.BLOCK_WORDS, 300):
        got = {r.doc_id: r for r in decontaminate.digest(decontaminate.search(index, table, block_words=block)).collect()}
        for i, text in docs:
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == decontaminate.brute_force(text, items)
    assert decontaminate.decontaminate(frame.where("false"), table).count() == 0
    clash = frame.selectExpr("*", "'x' AS near_items", "1 AS segment", "2 AS n_hit", "3 AS spans")
    assert decontaminate.decontaminate(clash, table).count() == len(docs)


def test_proximity(spark):
    rng = random.Random(8)
    texts = ["a b x c d e", "a b c d e", "e d c b a q q q", "a b x y z c d e"] + [" ".join(rng.choice("abcde") for _ in range(9)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")

    def near(text, slack):
        w = text.split()
        return any(all(any(w[p] == x for p in range(max(0, s + j - slack), min(len(w), s + j + slack + 1))) for j, x in enumerate("abcde")) for s in range(-slack, len(w)))

    for slack in (0, 1, 2):
        found = {r.doc_id: (r.items, r.near_items) for r in decontaminate.decontaminate(docs, items, slack=slack).collect()}
        for i, text in enumerate(texts):
            assert found[i][0] == (["7"] if "a b c d e" in text else [])
            assert not slack or found[i][1] == (["7"] if near(text, slack) else [])
    assert found[1] == (["7"], ["7"]) and found[0][0] == []


# language


def test_language_held_out_accuracy(spark):
    from netloom.llm.common import held_out

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", held_out())
    model = langid.train(docs.where("NOT held_out"))
    rows = langid.identify(docs.where("held_out"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and abs(sum(r.proportions) - 1) < 1e-6 for r in rows)


def test_language_mixture_and_odd_rows(spark):
    train = docs_of(spark, [(i, "the cat and the dog with the house", "en") for i in range(3)] + [(i, "der hund und die katze mit dem haus", "de") for i in range(3, 6)])
    model = langid.train(train)
    mixed = docs_of(spark, ODD + [(7, "the cat and the dog " * 30 + "der hund und die katze " * 30, "en"), (8, "12 34 !", "en")])
    rows = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert set(rows[7].langs) == {"en", "de"} and rows[7].score < 0.7
    assert {rows[i].lang_pred for i in (1, 2, 3, 8)} == {"und"} and rows[1].score == 0
    assert langid.identify(mixed, langid.train(train.where("false"))).where("lang_pred <> 'und'").isEmpty()


def test_em_never_falls():
    rng = np.random.default_rng(0)
    n = np.array([40, 25])
    log_p = np.log(rng.random((3, n.sum())))
    first = np.array([0, 40])
    share = np.full((3, 2), 1 / 3)
    last = -np.inf
    for _ in range(8):
        share = langid.em(np.exp(log_p), n, first, share, steps=1, tolerance=0)
        now = np.log(langid.mixed(np.exp(log_p), n, share)).sum()
        assert now >= last - 1e-9
        last = now


# sentencepiece


def test_pieces_match_the_library(spark):
    spm = pytest.importorskip("sentencepiece")
    library, codec = spm.SentencePieceProcessor(model_file=MODEL), sentencepiece_wfst.Codec(sentencepiece_wfst.read_model(MODEL))
    cases = ["", "a", " ", "  a  b ", "Hello  world 日本 \n\t x\n\n y", "▁a", "é̂ 🙂🙂 x", "    def f(x):\n\t\treturn x+1  ", "a" * 50, "https://www.example.com/?a=b&c=d.", "<s> </s> <0x41> <unk>", "的的的 मानक العربية"]
    rng = random.Random(3)
    cases += ["".join(rng.choice("ab c.,é\n日1") for _ in range(rng.randrange(60))) for _ in range(200)]
    for text in cases + [r.text for r in real(spark).limit(100).collect()]:
        assert codec.encode(text) == library.encode(text)
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text))


def test_unigram_path_is_the_cheapest():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁ab"]
    model = sentencepiece_wfst.Model(pieces, [0, -2.0, -1.5, -1.6, -2.0, -2.2, -4.0, -3.0], [2] + [1] * 7, sentencepiece_wfst.UNIGRAM, byte_fallback=False)
    machine = sentencepiece_wfst.PieceTransducer(model)

    def cheapest(text):
        if not text:
            return 0.0
        return min((-model.scores[i] + cheapest(text[len(p) :]) for i, p in enumerate(pieces) if i and text.startswith(p)), default=float("inf"))

    for text in ("▁abab", "▁aba", "▁bbaab"):
        path = machine.shortest_path(text)
        assert "".join(path) == text
        assert sum(-model.scores[pieces.index(p)] for p in path) == pytest.approx(cheapest(text))


def normal_spec(rule):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return m.normalizer_spec


def test_normaliser_matches_the_library():
    import sentencepiece as spm

    rng = random.Random(4)
    pool = "aé ﬁ①ＡＢ½…\t\n\u3000\u200bİßÅ한ガﾊﾞ e\u0301\u0327x  ²ǅ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(300)]
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        spec = normal_spec(rule)
        rewrites = sentencepiece_wfst.character_map(spec.precompiled_charsmap)
        assert bool(rewrites) == (rule != "identity")
        model = sentencepiece_wfst.Model([], [], [], sentencepiece_wfst.UNIGRAM, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, rewrites=rewrites)
        mine, library = sentencepiece_wfst.Normaliser(model), spm.SentencePieceNormalizer(rule_name=rule)
        assert [mine(t) for t in texts] == [library.normalize(t) for t in texts]


def test_weighted_path_matches_the_library_on_whole_texts(spark, tmp_path):
    """A unigram model of the same pieces, with made weights and a character map: whole texts through N o P o B."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    rng = random.Random(7)
    for i, p in enumerate(m.pieces):
        p.score = -6 - 8 * i / len(m.pieces) - rng.random() if p.type == sentencepiece_wfst.NORMAL else 0
    m.trainer_spec.model_type = sentencepiece_wfst.UNIGRAM
    m.normalizer_spec.CopyFrom(normal_spec("nmt_nfkc"))
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    library, docs = spm.SentencePieceProcessor(model_file=path), docs_of(spark, [(i, t, "en") for i, t in enumerate([None, "", "  ﬁne  ① 的 ", "x" * 500, *(r.text for r in real(spark).limit(60).collect())])])
    rows = sentencepiece_wfst.decode(sentencepiece_wfst.encode(docs, sentencepiece_wfst.read_model(path)), sentencepiece_wfst.read_model(path)).collect()
    assert sum(len(r.text or "") for r in rows) > 50_000
    weight = {i: p.score if p.type == sentencepiece_wfst.NORMAL else -100.0 for i, p in enumerate(m.pieces)}
    same = 0
    for r in rows:
        if r.text is None:
            assert r.ids is r.decoded is None
            continue
        want = library.encode(r.text)
        same += r.ids == want
        assert sum(weight[i] for i in r.ids) == pytest.approx(sum(weight[i] for i in want), abs=1e-6) and r.decoded == library.decode(want)
    assert same >= 0.7 * len(rows)  # the others have several paths of one weight


def test_stores_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_wfst, "STORE_SEGMENTS", 20_000)
    monkeypatch.setattr(sentencepiece_wfst, "STORE_PARTS", 20_000)
    codec = sentencepiece_wfst.Codec(sentencepiece_wfst.read_model(MODEL))
    for i in range(300):
        codec.encode("的" * (i % 40) + str(i) + "x" * (i % 7))
        assert sum(len(k) + 240 for k in codec.store) <= 10_000 and sum(len(k) + 240 for k in codec.store.elder) <= 10_000


def test_encode_decode_odd_rows(spark):
    model = sentencepiece_wfst.read_model(MODEL)
    coded = sentencepiece_wfst.encode(docs_of(spark, ODD), model)
    rows = sentencepiece_wfst.decode(coded, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.decoded == r.text
        assert r.ids is None if r.text is None else (r.round_trip and len(r.ids) == r.n_ids)
    assert sentencepiece_wfst.encode(docs_of(spark, []).where("false"), model).count() == 0


# tool calls


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_tool_calls(spark):
    call = json.dumps({"tool_calls": [{"id": "b", "name": "add", "arguments": {"y": {"$ref": "a"}, "x": 1.0}}, {"id": "a", "name": "get", "arguments": {}}, {"id": "c", "name": "nope", "arguments": [1]}, {"id": None, "name": "get", "arguments": {}}]})
    rows = [(1, 0, "assistant", call), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "7"})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "é\n"})), (1, 3, "tool", json.dumps({"tool_call_id": "z", "content": "?"})), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "again"}))]
    schemas = {"add": {"type": "object", "required": ["x", "z"], "properties": {"x": {"type": "integer"}}}, "get": {"type": "object", "additionalProperties": False}}
    for limit in (10_000, 1):
        found = {r.call_id: r for r in tool_calls.link(*tool_calls.extract(chat(spark, rows)), schemas, limit).collect()}
        assert {k: r.status for k, r in found.items()} == {"a": "linked", "b": "linked", "c": "missing_result", "z": "orphan_result", None: "no_id"}
        assert (found["a"].level, found["b"].level, found["a"].duplicates, found["b"].result_turn) == (0, 1, 1, 2)
        assert found["b"].json == '{"arguments":{"x":1,"y":{"$ref":"a"}},"id":"b","name":"add","result":"é\\n"}'
        assert found["b"].errors == ["$.z: missing"] and set(found["c"].errors) == {"arguments: no JSON object", "unknown tool"}


def test_cycles_have_no_level(spark):
    refs = spark.createDataFrame([(1, "a", ["b"]), (1, "b", ["a"]), (1, "c", ["b"]), (1, "d", []), (1, "e", ["d", "gone"])], "conv_id long, call_id string, refs array<string>")
    for limit in (100, 1):
        assert {r.call_id: r.level for r in tool_calls.order(refs, limit).collect()} == {"a": None, "b": None, "c": None, "d": 0, "e": 1}


def test_conversations_as_calls(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", None), (2, 0, "system", "x"), (2, 1, "assistant", "alone"), (None, 0, "user", "q"), (3, 0, "user", "hi"), (3, 0, "user", "hi")]
    found = {(r.conv_id, r.call_id): r for r in tool_calls.link_messages(chat(spark, rows)).collect()}
    assert found[1, "turn-0"].status == found[1, "turn-2"].status == "linked"
    assert found[1, "turn-2"].level == 1 and "$.prompt: missing" in found[1, "turn-2"].errors
    assert found[2, "turn-0"].status == "orphan_result" and found[None, "turn-0"].status == "no_id"
    assert found[3, "turn-0"].duplicates == 1 and found[3, "turn-0"].status == "missing_result"
    assert tool_calls.link_messages(chat(spark, [])).count() == 0


def test_tool_calls_with_odd_arguments(spark):
    texts = {
        "half": '{"a": "\\ud800", "\\udfff": 1}', "huge": '{"a": 1e999}', "nan": '{"a": NaN}', "deep": '{"a": ' + "[" * 3000 + "]" * 3000 + "}", "brackets": '{"a": "' + "[" * 3000 + '"}',
        "long": json.dumps({"a": "x" * 2_000_000}), "digits": '{"a": ' + "9" * 400 + "}", "float": '{"a": 1e2, "b": -0.0}', "text": "not json", "empty": "", "none": None,
    }
    calls = spark.createDataFrame([(1, k, 0, "get", v) for k, v in texts.items()], tool_calls.CALLS)
    results = spark.createDataFrame([(1, k, 1, "\u2028 é") for k in texts], tool_calls.RESULTS)
    found = {r.call_id: r for r in tool_calls.link(calls, results, {"get": {"type": "object"}}).collect()}
    assert {k for k, r in found.items() if r.errors} == {"huge", "nan", "deep", "text", "empty", "none"}
    assert '"arguments":{"a":"\\ud800","\\udfff":1}' in found["half"].json and '"arguments":{"a":100,"b":0}' in found["float"].json
    assert '"arguments":null' in found["huge"].json and "9" * 400 in found["digits"].json and len(found["long"].json) > 2_000_000
    assert all(json.loads(r.json)["result"] == "\u2028 é" for r in found.values())
    marked = '{"tool_calls": [{"id": "x", "name": "get", "arguments": {"n": 1e999}}, {"id": "y", "name": "get", "arguments": {"s": "\\ud800"}}, 5]}'
    rows = {r.call_id: r for r in tool_calls.link_messages(chat(spark, [(1, 0, "assistant", marked), (1, 1, "assistant", '{"tool_calls": ["'), (1, 2, "tool", '{"tool_call_id": "x", "content": "1"}')])).collect() if r.turn == 0}
    assert rows["x"].errors == ["arguments: no JSON object", "unknown tool"] and '"arguments":null' in rows["x"].json and rows[None].status == "no_id" and "y" in rows


def test_schemas(spark):
    schema = {
        "type": "object", "title": "t", "additionalProperties": {"type": "integer", "minimum": 3},
        "properties": {"c": {"const": 1}, "e": {"enum": [1, "a"]}, "s": {"type": "string", "pattern": "^a+$", "maxLength": 3}, "l": {"type": "array", "minItems": 1, "items": {"anyOf": [{"type": "string"}, {"type": "null"}]}}, "o": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "n": {"not": {"type": "null"}}},
    }
    tool_calls.check_schema(schema)
    good = {"c": 1.0, "e": "a", "s": "aaa", "l": ["x", None], "o": 1.5, "n": 0, "more": 3}
    assert tool_calls.violations(good, schema) == []
    for k, bad in {"c": True, "e": True, "s": "aaaa", "l": [], "o": 1, "n": None, "more": 2.5}.items():
        assert tool_calls.violations(good | {k: bad}, schema), k
    for wrong in ({"type": "any"}, {"properties": {"x": {"dependentRequired": {}}}}, {"pattern": "("}, 5):
        with pytest.raises((ValueError, re.error)):
            tool_calls.check_schema(wrong)
    table = spark.createDataFrame([("get", json.dumps(schema))], "name string, schema string")
    calls = spark.createDataFrame([(1, "a", 0, "get", '{"c": 2}'), (1, "b", 0, None, "{}")], tool_calls.CALLS)
    assert {r.call_id: r.errors for r in tool_calls.parse_calls(calls, table).collect()} == {"a": ["$.c: not the constant"], "b": ["unknown tool"]}


def test_long_chains_and_several_references_are_ordered_alike(spark):
    rng = random.Random(2)
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(70)]
    rows += [(2, f"n{i:02d}", rng.sample([f"n{j:02d}" for j in range(i)], min(i, rng.choice([0, 1, 1, 1, 2, 3])))) for i in range(40)] + [(2, "loop", ["loop", "n00"]), (2, "behind", ["loop"])]
    refs = spark.createDataFrame(rows, "conv_id long, call_id string, refs array<string>")
    small, large = ({(r.conv_id, r.call_id): r.level for r in tool_calls.order(refs, limit).collect()} for limit in (1000, 1))
    assert small == large and small[1, "c69"] == 69 and small[2, "loop"] is None and small[2, "behind"] is None and max(v for v in small.values() if v) > 3


# token rollups


CHANGES = "source string, lang string, version string, kind string, n_tokens long, old_tokens long"


def test_rollup_commits_once(spark, tmp_path):
    rollup = token_rollups.Rollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([("a", "en", "v", "insert", 5, None), ("a", "en", "v", "insert", 7, None), (None, None, "v", "insert", None, None)], CHANGES)
    two = spark.createDataFrame([("a", "en", "v", "revise", 4, 7), ("a", "en", "v", "delete", 5, None)], CHANGES)
    assert rollup.commit("1", one) and not rollup.commit("1", one) and rollup.commit("2", two)
    want = {("a", "en", "v"): (1, 4), (None, None, "v"): (1, 0)}

    def totals():
        return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}

    assert totals() == want
    rollup.compact()
    assert totals() == want and not rollup.commit("2", two) and rollup.commit("3", one.where("false"))
    rollup.compact()
    assert totals() == want
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("4", one.withColumn("kind", one.source))
    assert totals() == want


def test_rollup_of_documents_equals_a_recount(spark):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = token_rollups.read_ranks(f"{registry.TOKENIZERS}/byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    first = {}
    for r in real(spark).orderBy("doc_id").collect():
        first.setdefault(r.text, r)
    want = {}
    for text, r in first.items():
        n, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = n + 1, t + len(encoding.encode_ordinary(token_rollups.unique_lines(text)))
    got = token_rollups.roll_up_documents(real(spark), ranks, PATTERN, "v").totals().collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == want
    odd = token_rollups.roll_up_documents(docs_of(spark, ODD[:6]), ranks, PATTERN, "v").totals().collect()
    assert sum(r.n_docs for r in odd) == 5  # all rows but one of two that are equal
    copies = docs_of(spark, [(None, "same text", "en"), (3, "same text", "en"), (None, "same text", "en"), (1, None, "en"), (2, None, "en")])
    assert [r.n_docs for r in token_rollups.roll_up_documents(copies, ranks, PATTERN, "v").totals().collect()] == [3]
    assert token_rollups.roll_up_documents(copies.where("false"), ranks, PATTERN, "v").totals().count() == 0
    long = docs_of(spark, [(1, "word " * 300_000, "en")])
    assert [r.n_tokens for r in token_rollups.roll_up_documents(long, ranks, PATTERN, "v").totals().collect()] == [len(encoding.encode_ordinary("word " * 300_000))]


def test_rollup_batches_that_come_in_while_it_compacts(spark, tmp_path):
    def batch(n):
        return spark.createDataFrame([("a", "en", "v", "insert", n, None)], CHANGES)

    rollup = token_rollups.Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("1", batch(1))
    rollup.commit("2", batch(10))
    live = rollup.live

    def late():
        found = live()
        token_rollups.Rollup.commit(rollup, "3", batch(100))
        return found

    rollup.live = late
    rollup.compact()
    rollup.live = live
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(3, 111)]
    rollup._add("2", f"{rollup.folder}/deltas/late", [], [])  # a second writer of a batch in the snapshot
    old, seen = rollup.live(), [(b, p, c) for b, p, c in rollup.live()]
    rollup.compact()
    rollup._add("snapshot-late", old[0][1] + "-late", [b for b, _, _ in seen[:1]], [seen[0][1]])  # a narrower snapshot at the same time
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(3, 111)]
    assert not any(rollup.commit(x, batch(5)) for x in "123")


# licences


def brute_licences(text):
    found = [w.decode() for w in words((text or "").encode())]
    hits = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    return len(found), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def brute_cover(found, template, k):
    """Distinct template grams in any order that the text has: the most that a span can cover."""
    grams = [tuple(template[i : i + k]) for i in range(len(template) - k + 1)]
    have = {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}
    return sum(g in have for g in grams) / len(grams)


def brute_labels(text):
    """Labels of templates that stand whole in the text, and of those that may stand by their grams."""
    found = [w.decode() for w in words((text or "").encode())]
    sure, maybe = set(), set()
    for kind, phrase, label in licences.default_templates():
        template = [w.decode() for w in words(phrase.encode())]
        k = 2 if kind == "phrase" or len(template) < 20 else 5
        if any(found[i : i + len(template)] == template for i in range(len(found) - len(template) + 1)):
            sure.add(label)
        if kind != "phrase" and brute_cover(found, template, k) >= 0.75:
            maybe.add(label)
    return sure, sure | maybe


def test_licences_match_brute_force(spark):
    rows = ODD + [(10, "Under CC-BY, cc BY; MIT License (the apache\nlicense) GNU general public license", "en"), (11, "cc by cc by cc by", "en"), (12, "general public license mit", "en")]
    texts = {f.stem: f.read_text() for f in sorted(licences.TEXTS.glob("*.txt"))}
    rows += [(100 + i, f"Some words before. {t}\nand after", "en") for i, t in enumerate(texts.values())]
    for docs in (docs_of(spark, rows), real(spark)):
        texts_of = [(r.doc_id, r.text) for r in docs.collect()]
        found = licences.scan(docs).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=str)
        assert got == sorted(((i, *brute_licences(t)) for i, t in texts_of), key=str)
        by_id = dict(texts_of)
        for r in found:
            sure, maybe = brute_labels(by_id[r.doc_id])
            assert sure <= set(r.labels.split(",")) | {""} and set(filter(None, r.labels.split(","))) <= maybe and r.score == max((s.cover for s in r.spans), default=0)
    assert {r.doc_id: r.labels for r in licences.scan(docs_of(spark, rows[-len(texts) :])).collect()}[100 + list(texts).index("gpl-3.0")] == "gpl,gpl-3.0"
    plain, shuffled = (sorted(map(repr, licences.scan(docs_of(spark, rows), broadcast_grams=n).collect())) for n in (10**6, 0))
    assert plain == shuffled
    assert licences.scan(docs_of(spark, rows).where("false")).count() == 0


def test_licence_notices_with_edits(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files"
    docs = docs_of(spark, [(1, "x " * 40 + grant + " y", "en"), (2, "of this software and to any person", "en"), (3, "Licensed under CC BY-NC 4.0.", "en")])
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert found[1].labels == "mit" and found[1].n_base == 0 and 0.75 <= found[1].score < 1
    assert found[1].spans[0].first_word == 40 and found[2].labels == ""
    assert found[3].base_labels == "cc-by" and found[3].labels == "cc-by,cc-by-nc-4.0"


# pipeline


def test_pipeline_matches_its_stages_by_hand(spark):
    import corpus_pipeline

    documents = real(spark)
    columns = documents.columns
    after = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = after, stage(spark, after, SF)
        assert after.columns == columns
        assert after.exceptAll(before).isEmpty()
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == {r.doc_id for r in after.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r for r in documents.collect() if len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) >= 50]
    assert {i for i in rows} <= {r.doc_id for r in kept}
    assert all(r.round_trip for r in rows.values())
    assert not any(decontaminate.brute_force(texts[i], items)[4] for i in rows)
    codes = {i: simhash.fingerprint(texts[i].encode()) for i in rows}
    assert all(bin(codes[a] ^ codes[b]).count("1") > 3 for a in codes for b in codes if a < b)


def test_pipeline_on_odd_documents(spark, tmp_path):
    import corpus_pipeline

    documents = docs_of(spark, ODD + [(20, "the quick brown fox jumps " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en")]).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of that")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {20, 6}
    os.makedirs(f"{tmp_path}/e", exist_ok=True)
    documents.where("false").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
