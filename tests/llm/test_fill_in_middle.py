"""Fill-in-middle against a plain retelling of its rules."""

import hashlib
import re

import duckdb
import pytest

from netloom.llm import fill_in_middle, registry

SF = "/root/testdata/sf0.001"


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", " ", " \n\t", "one", " one", "one ", "a\x0bb\x0cc\x1cd\x85e\xa0f", "Ünï 🙂 漢字\nzwei  drei \r\n", "tag <P> inside", "<S>", "<M> x", "word " * 100_000, "x" * 200_000, "<p> <PP> < P>"]


def test_rows_by_hand(spark):
    rows = [(i if i else None, t, "x", "x") for i in range(120) for t in (TEXTS[i % len(TEXTS)],)] + [(7, "same text here", "x", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, extra string")
    made = fill_in_middle.restore(fill_in_middle.transform(docs))
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored", "restored_sha256"]
    found = made.collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key)
    assert got == sorted(((i, t, *by_hand(i, t)) for i, t, *_ in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert r.restored == (r.text or "")
        assert (r.output_sha256, r.restored_sha256) == (hashlib.sha256(r.output.encode()).hexdigest(), hashlib.sha256(r.restored.encode()).hexdigest())
    assert fill_in_middle.restore(fill_in_middle.transform(docs.limit(0))).count() == 0


def test_other_ids_and_rates(spark):
    docs = spark.createDataFrame([("a", "b c d"), ("é", "b c d")], "name string, text string")
    assert {r.form for r in fill_in_middle.transform(docs, "name", rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r.form for r in fill_in_middle.transform(docs, "name", rate=100, spm_rate=100).collect()} == {"spm"}
    assert {r.form for r in fill_in_middle.transform(docs, "name", rate=0).collect()} == {"plain"}


def test_offsets_are_compact_and_without_gaps():
    ends = fill_in_middle.unit_ends(" a b\n")
    assert ends.tolist() == [2, 4, 5] and ends.itemsize == 8
    with pytest.raises(ValueError):
        fill_in_middle.rebuilt("<P>a<S>b<M>c", "spm")


def test_query_equals_its_sql(spark):
    rows = registry.op13_fill_in_middle(spark, SF)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        found = con.execute(fill_in_middle.SQL)
        names = [d[0] for d in found.description]
        want = found.fetchall()
    assert sorted(rows.columns) == sorted(names)
    assert sorted((tuple(map(str, r)) for r in rows.select(*names).collect())) == sorted(tuple(map(str, r)) for r in want)
