"""The filter audit against a recount of every order, row by row."""

import re
from collections import Counter
from itertools import permutations

import duckdb

from netloom.llm import filter_audit, registry

SF = "/root/testdata/sf0.001"


def by_hand(docs, labels):
    """Rows of the audit from lists of (doc_id, text, part) and (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, p in docs:
        t = t or ""
        words = re.findall(r"[^ \t-\r]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        seen.append((p or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in seen}:
        rows, shapley, lines = [r for r in seen if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = [r for r in rows if f in r[1]]
                lines.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


PROSE = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, PROSE, "web"), (2, PROSE, "web"), (3, PROSE, "book"), (3, PROSE, "book"), (4, PROSE, None), (None, PROSE, "web"), (None, PROSE, ""),
    (5, None, "web"), (6, "", "web"), (7, "  \n\t ", ""), (8, PROSE.upper(), "book"), (9, PROSE + " 100%", "web"), (10, "same " * 80, "web"),
    (11, "same " * 80, "web"), (12, "SHORT #", "book"), (13, "Ünï ÄÖ " * 30, "web"), (14, "a\x1cb " * 60, "only"), (0, "unique text", "only"), (15, "big " * 200_000, "only"),
    *[(100 + i, "copied " + PROSE, "web") for i in range(40)],
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (None, 1, 1), (6, None, 1), (12, 0, 0), (999, 1, 1), (105, 1, 0), (100, 1, 0)]


def rows_of(frame):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, frame.select(columns).collect()))


def frames(spark, docs=DOCS, labels=LABELS):
    made = spark.createDataFrame([(i, t, p, "x", "x") for i, t, p in docs], "doc_id long, text string, source string, part string, digest string")
    return made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rows_by_hand(spark):
    assert rows_of(filter_audit.audit_documents(*frames(spark))) == by_hand(DOCS, LABELS)


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert rows_of(filter_audit.audit_documents(docs, labels.limit(0))) == by_hand(DOCS, [])


def test_partitions_do_not_matter(spark):
    docs, labels = frames(spark)
    assert rows_of(filter_audit.audit_documents(docs.repartition(7), labels.repartition(3))) == by_hand(DOCS, LABELS)


def test_cube_makes_the_survivors(spark):
    counted = filter_audit.flag_counts(filter_audit.with_labels(filter_audit.text_flags(frames(spark)[0]), frames(spark)[1]))
    assert "Expand" in counted.sparkSession._jvm.PythonSQLUtils.explainString(filter_audit.survivors(counted)._jdf.queryExecution(), "simple")
    found = {(r.part, r.subset): r.n for r in filter_audit.survivors(counted).collect()}
    parts = Counter(p or "" for _, _, p in DOCS)
    assert len(found) == 32 * len(parts) and {p: found[p, 0] for p in parts} == parts


def test_query_equals_its_sql_and_a_recount(spark):
    rows = registry.op12_filter_audit(spark, SF)
    with duckdb.connect() as con:
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(filter_audit.SQL)
        names = [d[0] for d in found.description]
        want = found.fetchall()
        docs = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
        labels = con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()
    assert sorted(rows.columns) == sorted(names)
    got = rows_of(rows)
    assert got == sorted(want) == by_hand(docs, labels)
