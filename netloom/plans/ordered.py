"""Queries over rows in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import bits, names
from netloom.operators import ordered
from netloom.queries import load, query

HIGH = 20.0
BY_USER = (["user_id"], ["ts"])
_BITS = f"SELECT *, value > {HIGH} AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events"


def _bits(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("bit", F.col("value") > HIGH)


@query("popcount_pack", f"""SELECT user_id, CAST(pos // 11 AS BIGINT) AS chunk, CAST(sum(CASE WHEN bit THEN 1 << (pos % 11) ELSE 0 END) AS BIGINT) AS word,
  CAST(bit_count(CAST(sum(CASE WHEN bit THEN 1 << (pos % 11) ELSE 0 END) AS BIGINT)) AS BIGINT) AS ones FROM ({_BITS}) GROUP BY 1, 2""")
def popcount_pack(spark, sf_dir):
    rows = ordered.chunked(_bits(spark, sf_dir), *BY_USER)
    words = rows.groupBy("user_id", F.col("row").cast("long").alias("chunk")).agg(bits.packed(F.col("bit"), F.col("col")).alias("word"))
    return words.withColumn("ones", F.bit_count("word").cast("long"))


@query("natural_sort_rank", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS rank FROM customer""")
def natural_sort_rank(spark, sf_dir):
    short = load(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("U"), F.col("c_custkey").cast("string")))
    return short.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(names.natural_key(F.col("name")))).alias("rank"))


@query("predecessor_link", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def predecessor_link(spark, sf_dir):
    return ordered.predecessor(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous")


@query("sample_hold_edges", f"""SELECT event_id, user_id, click_held, error_held FROM (SELECT *, coalesce(lag(bit) OVER w, false) AS before,
  last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS click_held,
  last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS error_held
  FROM ({_BITS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE bit AND NOT before""")
def sample_hold_edges(spark, sf_dir):
    rows = _bits(spark, sf_dir).withColumns({k: F.when(F.col("event_type") == k, F.col("value")) for k in ("click", "error")})
    return ordered.rising(ordered.held(rows, *BY_USER, ["click", "error"]), *BY_USER, F.col("bit")).select("event_id", "user_id", "click_held", "error_held")


@query("hot_hold_edges", f"""SELECT event_id, click_held, error_held, CAST(edges AS BIGINT) AS edges FROM (SELECT *, sum(CAST(bit AND NOT before AS INTEGER)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS edges FROM (
  SELECT *, coalesce(lag(bit) OVER w, false) AS before, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS click_held,
  last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS error_held FROM ({_BITS}) WINDOW w AS (ORDER BY ts, event_id))) WHERE bit AND NOT before""")
def hot_hold_edges(spark, sf_dir):
    """All events as one stream: no task orders it alone."""
    by = ([], ["ts", "event_id"])
    rows = _bits(spark, sf_dir).select("event_id", "ts", "bit", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "error")])
    held = ordered.held_over(ordered.in_ranges(rows, *by), *by, ["click", "error"])
    seen = ordered.previous_over(held, *by, F.col("bit"), "before")
    rises = F.col("bit") & ~F.coalesce("before", F.lit(False))
    return ordered.sum_over(seen, *by, rises.cast("int"), "edges").where(rises).select("event_id", "click_held", "error_held", "edges")


@query("flag_sessions", """WITH f AS (SELECT *, event_type IN ('purchase', 'click') AS inside FROM events),
g AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY user_id ORDER BY ts), false) AS start FROM f),
h AS (SELECT *, sum(CAST(start AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM h WHERE inside GROUP BY 1, 2""")
def flag_sessions(spark, sf_dir):
    inside = F.col("event_type").isin("purchase", "click")
    rows = ordered.islands(load(spark, sf_dir, "events"), *BY_USER, inside)
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("fixed_chunks", f"SELECT event_id, CAST(pos // 11 AS INTEGER) AS row, CAST(pos % 11 AS INTEGER) AS col, pos >= 121 AS done FROM ({_BITS})")
def fixed_chunks(spark, sf_dir):
    return ordered.chunked(load(spark, sf_dir, "events"), *BY_USER).select("event_id", "row", "col", "done")


@query("delay_taps", f"SELECT event_id, {', '.join(f'coalesce(lag(bit, {k}) OVER (PARTITION BY user_id ORDER BY ts), false) AS tap{k}' for k in (1, 10, 11, 12))} FROM ({_BITS})")
def delay_taps(spark, sf_dir):
    return ordered.taps(_bits(spark, sf_dir), *BY_USER, "bit").select("event_id", "tap1", "tap10", "tap11", "tap12")


@query("saturating_sticky", f"""SELECT event_id, CAST(least(sum(CAST(bit AS INTEGER)) OVER w, 3) AS BIGINT) AS counter, bool_or(event_type = 'error' AND bit) OVER w AS bad
  FROM ({_BITS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def saturating_sticky(spark, sf_dir):
    bad = (F.col("event_type") == "error") & F.col("bit")
    return _bits(spark, sf_dir).select("event_id", ordered.saturating(F.col("bit"), *BY_USER).alias("counter"), ordered.sticky(bad, *BY_USER).alias("bad"))


@query("first_seen_distinct", "SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def first_seen_distinct(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return ordered.first_seen(rows, ["user_id", "event_type"], ["ts"])


@query("dedupe_suffix", """SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def dedupe_suffix(spark, sf_dir):
    return names.numbered_duplicates(load(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("topk_remainder", """SELECT o_custkey, n, (SELECT greatest(count(DISTINCT o_custkey) - 25, 0) FROM orders) AS others FROM
  (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25)""")
def topk_remainder(spark, sf_dir):
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    top, others = ordered.top_and_rest(counts, [F.desc("n"), "o_custkey"], 25)
    return top.withColumn("others", others)


@query("display_windows", f"SELECT user_id, pos // 11 AS chunk, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY pos) AS shown FROM ({_BITS}) WHERE pos // 11 IN (0, 2, 4) GROUP BY 1, 2")
def display_windows(spark, sf_dir):
    rows = ordered.chunked(_bits(spark, sf_dir), *BY_USER).where(F.col("row").isin(0, 2, 4))
    entry = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("bit"), "1").otherwise("0").alias("c"))))
    return rows.groupBy("user_id", F.col("row").cast("long").alias("chunk")).agg(F.array_join(F.transform(entry, lambda s: s["c"]), "").alias("shown"))


@query("ordered_reports", """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type <> 'SMALL', p_size DESC, p_name, p_partkey) AS place,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS first_place FROM part""")
def ordered_reports(spark, sf_dir):
    flag_first = Window.partitionBy("p_brand").orderBy(F.col("p_type") != "SMALL", F.desc("p_size"), "p_name", "p_partkey")
    plain = Window.partitionBy("p_brand").orderBy("p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", F.row_number().over(flag_first).alias("place"), (F.row_number().over(plain) - 1).alias("first_place"))


@query("char_decode", """SELECT user_id, array_to_string(list_transform(list_slice(codes, 1, CASE WHEN list_position(codes, 0) > 0 THEN list_position(codes, 0) - 1 ELSE len(codes) END), lambda c: chr(CAST(c AS INTEGER))), '') AS decoded
  FROM (SELECT user_id, list(CASE WHEN event_id % 13 = 0 THEN 0 ELSE 65 + event_id % 26 END ORDER BY ts) AS codes FROM events GROUP BY user_id)""")
def char_decode(spark, sf_dir):
    code = F.when(F.col("event_id") % 13 == 0, F.lit(0)).otherwise(65 + F.col("event_id") % 26).cast("long").alias("code")
    codes = load(spark, sf_dir, "events").select("user_id", "ts", code).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "code"))).alias("x"))
    return codes.select("user_id", bits.text_until_nul(F.transform("x", lambda s: s["code"])).alias("decoded"))


@query("constraint_check", f"""WITH b AS (SELECT user_id, pos, bit, pos // 11 AS r, pos % 11 AS c FROM ({_BITS}) WHERE pos < 121),
rows AS (SELECT user_id, bool_and(n <= 5) AS rows_ok FROM (SELECT user_id, r, count(*) FILTER (WHERE bit) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
cols AS (SELECT user_id, bool_and(n <= 5) AS cols_ok FROM (SELECT user_id, c, count(*) FILTER (WHERE bit) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
near AS (SELECT a.user_id, count(*) AS touching FROM b a JOIN b d ON a.user_id = d.user_id AND a.bit AND d.bit AND a.pos < d.pos AND d.pos - a.pos IN (1, 10, 11, 12) AND abs(a.r - d.r) <= 1 AND abs(a.c - d.c) <= 1 GROUP BY 1)
SELECT user_id, count(*) FILTER (WHERE bit) AS ones, bool_and(rows_ok) AS rows_ok, bool_and(cols_ok) AS cols_ok, coalesce(max(touching), 0) AS touching FROM b JOIN rows USING (user_id) JOIN cols USING (user_id) LEFT JOIN near USING (user_id) GROUP BY user_id""")
def constraint_check(spark, sf_dir):
    board = ordered.chunked(_bits(spark, sf_dir), *BY_USER).where("NOT done").select("user_id", "pos", "row", "col", "bit")
    ones = F.count_if("bit")

    def lines(by, out):
        return board.groupBy("user_id", by).agg(ones.alias("n")).groupBy("user_id").agg(F.bool_and(F.col("n") <= 5).alias(out))

    tapped = ordered.taps(board, ["user_id"], ["pos"], "bit", (1, 10, 11, 12))
    left, right = F.col("col") > 0, F.col("col") < 10
    beside = [F.col("tap1") & left, F.col("tap12") & left, F.col("tap11"), F.col("tap10") & right]
    touching = F.sum(sum((F.col("bit") & x).cast("long") for x in beside))
    return tapped.groupBy("user_id").agg(ones.alias("ones"), touching.alias("touching")).join(lines("row", "rows_ok"), "user_id").join(lines("col", "cols_ok"), "user_id")
