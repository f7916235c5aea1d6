"""An index is held by a few segments at a time, however many a partition has."""

from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq

from netloom import shared
from netloom.llm import decontaminate


def test_an_index_is_written_in_bounded_row_groups(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(2000)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(texts[7].split()[40:55]))], "item_id long, text string")
    written, cut = [], decontaminate.cut

    def watched(df, what="cut", options=None):
        out = cut(df, what, (options or {}) | {"parquet.block.size": str(1 << 16)})
        written.extend(out.inputFiles() if what == "postings" else [])
        return out

    monkeypatch.setattr(decontaminate, "cut", watched)
    monkeypatch.setattr(decontaminate.build_index, "__defaults__", (decontaminate.build_index.__defaults__[0], 1000))
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs, items).collect()}
    assert found == {i: decontaminate.brute_force(t, [("1", " ".join(texts[7].split()[40:55]))])[:2] for i, t in enumerate(texts)}
    groups = [pq.ParquetFile(Path(urlparse(f).path)).metadata for f in written]
    assert sum(g.num_rows for g in groups) == 60
    assert max(g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)) <= 20


def test_cut_takes_options_of_the_writer(spark):
    out = shared.cut(spark.range(10), "options", {"compression": "gzip"})
    assert out.count() == 10 and all(f.endswith(".gz.parquet") for f in out.inputFiles())


def test_numbered_texts_are_written_in_small_row_groups(spark):
    import corpus_pipeline

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 200), i -> hex(xxhash64(id, i))), ' ') AS text")
    files = [Path(urlparse(f).path) for f in corpus_pipeline._numbered(docs.unionAll(docs).unionAll(docs).coalesce(1)).inputFiles()]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(g.num_rows for g in groups) == 9000
    assert max(g.row_group(k).total_byte_size for g in groups for k in range(g.num_row_groups)) < 20 << 20
