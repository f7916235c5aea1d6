"""The whole job, where queries and stages once did less: each of these failed before its change."""

import random

import duckdb
import numpy as np

from netloom.llm import decontaminate, registry, simhash

SF = "/root/testdata/sf0.001"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
EXACT, LOOSE, CLEAN = f"so {ITEM} end", f"so {ITEM.replace('zeta', 'zeta really then')} end", "mu lambda alpha and nothing else of it"


def test_op2_and_the_pipeline_take_proximity_hits(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, EXACT), (2, LOOSE), (3, CLEAN)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in registry.op2_decontaminate(spark, str(tmp_path)).collect()}
    assert {i: (r.contaminated, r.n_items, r.n_near_items) for i, r in rows.items()} == {1: (True, 1, 1), 2: (False, 0, 1), 3: (False, 0, 0)}
    assert rows[2].near_items_sha256 == rows[1].items_sha256 != rows[3].near_items_sha256
    assert [r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()] == [3]


def test_op2_contract_columns_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(decontaminate.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, registry.op2_decontaminate(spark, SF).select(names).collect())) == sorted(want.fetchall())


def test_short_phrases_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string").coalesce(1)
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(9, "alpha beta")], "item_id long, text string"), size=2)
    assert found.where("size(near_items) > 0").isEmpty()


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """Numbers of the first text of each group, by comparing all pairs; and how many pairs are alike."""
    sets, up, n = [shingles(t) for t in texts], list(range(len(texts))), 0
    for j in range(len(texts)):
        for i in range(j):
            if not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j])):
                n += 1
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return {i for i, x in enumerate(up) if x == i}, n


def test_near_dedup_takes_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 12):
            copy = list(base)
            for at in rng.sample(range(200), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    want, n = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert n > 100 and len(want) > 30
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept >= want and len(kept - want) <= 2  # no text under 0.8 goes; one in a hundred at 0.8 may be missed
    assert sorted(r.row for r in simhash.first_rows(docs.withColumn("row", docs.doc_id), max_bucket=40).collect()) == sorted(kept)  # parts


def test_recall_of_the_tables():
    """Random sets at given similarities: the share that is searched at all, meets in a table and lies within the radius."""
    rng = np.random.default_rng(1)
    picks, radius = simhash.tables(1000), simhash.radius_of(0.8)
    for similarity, least in ((0.8, 0.97), (0.85, 0.99), (0.95, 1.0)):
        found = 0
        for _ in range(400):
            shared = rng.integers(0, 1 << 63, 400, np.uint64)
            own = round(400 * (1 - similarity) / (2 * similarity))
            a, b = (np.unique(np.r_[shared, rng.integers(0, 1 << 63, own, np.uint64)]) for _ in "ab")
            bits = [np.unpackbits(simhash.wide_fingerprint(x).view(np.uint8), bitorder="little") for x in (a, b)]
            differ = bits[0] != bits[1]
            smallest = np.intersect1d(a[: simhash.BOTTOM], b[: simhash.BOTTOM])
            found += differ.sum() <= radius and not differ[picks].any(1).all() and len(smallest) >= simhash.LEAST_SHARED
        assert found >= least * 400


def test_only_sets_that_share_their_smallest_hashes_are_searched(spark):
    rows = [
        (1, 100, list(range(12))), (2, 100, [*range(5), *range(100, 107)]), (3, 100, [*range(4), *range(200, 208)]), (4, 100, list(range(300, 312))),
        (5, 3, [1, 2, 900]), (6, 2, [7, 8]), (7, 1, [901]), (8, 100, [302, 303, 304, 305, *range(700, 708)]),
    ]
    sets = spark.createDataFrame(rows, "key long, size long, bottom array<long>")
    assert sorted(r.key for r in simhash.may_have_partners(sets).collect()) == [1, 2, 6]
    assert simhash.may_have_partners(sets.limit(0)).count() == 0


def test_pairs_apart_from_the_buckets_first_are_compared(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:300] + [f"{k}x{i}" for i in range(60)]) for k in "abc"]
    texts += [t + f" end{j}" for j in range(2) for t in texts]
    want, _ = brute_groups(texts)
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    assert want == {0, 1, 2} and {r.row for r in simhash.first_rows(rows).collect()} == want


def test_stages_keep_and_drop_by_row(spark, tmp_path):
    import corpus_pipeline

    def text(k, extra=""):
        return " ".join(f"{k}{i}" for i in range(80)) + extra

    rows = [(1, text("a")), (None, text("a", " more")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e", " more")), (8, f"{text('f')} {ITEM}"), (8, text("g")), (None, f"{text('h')} {LOOSE}"), (9, text("i")), (9, text("i"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r.text[0] for r in kept) == list("abcdefghi") and {r.doc_id for r in kept if r.text[0] == "a"} == {1}
    spark.createDataFrame([(9, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in clean) == sorted(t for _, t in rows if t[0] not in "fh")


def test_rows_go_alike_by_broadcast_and_by_shuffle(spark, monkeypatch):
    import corpus_pipeline

    rows = spark.range(100).withColumnRenamed("id", corpus_pipeline.ROW).withColumn("text", simhash.F.lit("x"))
    gone = spark.range(0, 100, 3).withColumnRenamed("id", corpus_pipeline.ROW)
    want = [i for i in range(100) if i % 3]
    for bound in (0, 1 << 20):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", bound)
        assert sorted(r[0] for r in corpus_pipeline._without(rows, gone).collect()) == want
