"""Filter interaction audit: what each of five filters removes in every order, from one CUBE.

1. Each text gets its failure flags in one pass of built-in functions. E (a copy of a smaller id's text) needs the whole
   table: rows become (digest, part, flags, labels) with their count, their smallest id and how many rows have it, and of a
   digest only the smallest id passes. Copies are counted before they are shuffled and the join is on (digest, id), so a
   text that a third of all rows hold is no hot key.
2. Rows are added up by part and flags (32 at most a part), then GROUP BY CUBE over the five flags and part. In a grouping
   set that selects some flags, the row whose selected flags are all false holds the survivors of just those filters.
3. A step goes from a subset of the filters to that subset with one more. Both subsets' survivors are joined by part and
   subset, 80 such pairs a part; their differences are what the filter removes there. The 600 steps of the 120 orders are a
   constant that is joined to the pairs.

Text leaves the first pass as a SHA-256 digest; equal digests count as equal texts. What the first pass makes and the counts
are each used twice and so written once; texts are read once.

Defined results: a null text counts as empty, has no words and fails A. A null part is the empty string, one part with it.
Null labels mark nothing; where an id has several label rows, one that marks it is enough. A null id has no labels and is
neither smaller nor larger than another: it never fails E and makes no row fail. Rows that share id and text don't make
each other fail. Very long texts are taken whole; extra columns are dropped; an empty table gives no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 50, 65, 5
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
FLAGS = [f"fails_{f.lower()}" for f in FILTERS]
COUNTS = ["n", "good", "toxic"]
ALL = (1 << len(FILTERS)) - 1


def text_flags(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, digest and the failures of A to D of every row of ``docs`` (doc_id, text, and the part's column)."""
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    rows = rows.select("doc_id", "part", "text", F.unhex(F.sha2("text", 256)).alias("digest"), words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failures = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITALS_PERCENT * F.length("text"), F.col("text").rlike(SYMBOLS)]
    return rows.select("doc_id", "part", "digest", *[c.alias(f) for f, c in zip(FLAGS, failures, strict=False)])


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic, 1 or 0, of ``labels`` (doc_id, quality, toxic)."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def flag_counts(rows: DataFrame) -> DataFrame:
    """(part, the five flags, n, good, toxic) of ``rows`` as ``with_labels`` makes them."""
    same = ["digest", "part", *FLAGS[:4], "good", "toxic"]
    by_id = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    sets = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("no_id"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"))
    sets = cut(sets.select(*same, "n", "no_id", F.col("least.doc_id").alias("doc_id"), F.col("least.n").alias("n_least")), "sets")
    firsts = sets.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    passes = F.col("no_id") + F.when(F.col("first"), F.col("n_least")).otherwise(0)
    split = F.array(F.struct(F.lit(False).alias("e"), passes.alias("k")), F.struct(F.lit(True).alias("e"), (F.col("n") - passes).alias("k")))
    both = sets.join(firsts, ["digest", "doc_id"], "left").select(*same[1:], F.explode(split).alias("x")).where("x.k > 0")
    return both.groupBy("part", *FLAGS[:4], F.col("x.e").alias(FLAGS[4])).agg(F.sum("x.k").alias("n"), *[F.sum(F.col("x.k") * F.col(c)).alias(c) for c in COUNTS[1:]])


def survivors(counted: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): the rows of each part that pass every filter of each subset, zeros included.

    Bit i of ``subset`` says that filter i is in it.
    """
    subset = " + ".join(f"(1 - grouping({f})) * {1 << i}" for i, f in enumerate(FLAGS))
    passed = " AND ".join(f"coalesce({f}, false) = false" for f in FLAGS)
    found = counted.sparkSession.sql(
        f"""SELECT part, subset, n, good, toxic FROM (
            SELECT part, {", ".join(FLAGS)}, grouping(part) AS all_parts, {subset} AS subset, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic
            FROM {{counted}} GROUP BY CUBE ({", ".join(FLAGS)}, part))
        WHERE all_parts = 0 AND {passed}""",
        counted=counted,
    )
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").fillna(0, COUNTS)


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order and step, from ``flag_counts``: what the step's filter removes, and what it means."""
    spark = counted.sparkSession
    passed = survivors(counted)
    moves = [(f, s, s | 1 << i, factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for i, f in enumerate(FILTERS) for s in range(ALL + 1) if not s >> i & 1]
    moves = F.broadcast(spark.createDataFrame(moves, "filter string, before int, after int, orders int"))
    left = passed.join(moves, F.col("subset") == F.col("before")).select("part", "filter", "before", "after", "orders", *[F.col(c).alias(f"{c}_before") for c in COUNTS])
    pairs = left.join(passed.withColumnRenamed("subset", "after"), ["part", "after"])
    pairs = pairs.select("part", "filter", "before", "after", "orders", F.col("n").alias("kept"), *[(F.col(f"{c}_before") - F.col(c)).alias(f"{c}_lost") for c in COUNTS])
    alone, last = F.when(F.col("before") == 0, F.col("n_lost")), F.when(F.col("after") == ALL, F.col("n_lost"))
    whole = pairs.groupBy("part", "filter").agg(F.max(alone).alias("fails"), F.max(last).alias("unique_fails"), F.sum(F.col("n_lost") * F.col("orders")).alias("shapley"))
    steps = [("".join(o), k + 1, f, sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int"))
    return pairs.join(whole, ["part", "filter"]).join(steps, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"),
        "unique_fails", F.col("good_lost"), F.col("toxic_lost"), "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``audit`` of ``docs`` (doc_id, text, and the part's column) with ``labels`` (doc_id, quality, toxic)."""
    return audit(cut(flag_counts(with_labels(text_flags(docs, part), labels)), "counts"))


#: The same rows in DuckDB, by flags held against each order's filters.
SQL = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < 50 AS INT) AS A, CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT) AS B,
  CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS INT) AS C, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS D, CAST(coalesce(w.doc_id > least, false) AS INT) AS E
  FROM w JOIN first USING (text) LEFT JOIN marks ON w.doc_id = marks.doc_id),
m AS (SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) AS r(i)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
