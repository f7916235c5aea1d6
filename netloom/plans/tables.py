"""Relational queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import names
from netloom.operators import motifs, relate
from netloom.queries import load, query


@query("inventory_by_type", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def inventory_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query("grouped_loads", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def grouped_loads(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("distinct_types", "SELECT p_type, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type")
def distinct_types(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_type").agg(F.count_distinct("p_brand").alias("brands"))


@query("collect_members", "SELECT n_name, string_agg(s_name, ',' ORDER BY s_name) AS members FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def collect_members(spark, sf_dir):
    joined = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("members"))


@query("having_one_driver", "SELECT l_orderkey, min(l_suppkey) AS driver FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def having_one_driver(spark, sf_dir):
    return relate.having_one(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("global_counts", """SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(DISTINCT o_custkey) AS customers FROM orders""")
def global_counts(spark, sf_dir):
    status = F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"), F.count_if(status == "O").alias("open"), F.count_if(status == "F").alias("filled"), F.count_if(status == "P").alias("partial"), F.count_distinct("o_custkey").alias("customers")
    )


@query("group_size_histogram", "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size")
def group_size_histogram(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("multiset_inventory", """SELECT types, count(*) AS n, min(p_brand) AS example FROM (SELECT p_brand, string_agg(p_type || '*' || c, ',' ORDER BY p_type) AS types
  FROM (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL) GROUP BY p_brand) GROUP BY types""")
def multiset_inventory(spark, sf_dir):
    counted = load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("c"))
    entry = F.struct("p_type", F.concat("p_type", F.lit("*"), F.col("c").cast("string")).alias("x"))
    sets = counted.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["x"]), ",").alias("types"))
    return sets.groupBy("types").agg(F.count("*").alias("n"), F.min("p_brand").alias("example"))


@query("uniform_groups", "SELECT l_orderkey, min(l_returnflag) AS flag, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT coalesce(l_returnflag, '~')) = 1")
def uniform_groups(spark, sf_dir):
    flag = F.struct("l_returnflag")  # so that null counts as a value
    found = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.count("*").alias("n"), F.count_distinct(flag).alias("kinds"))
    return found.where("kinds = 1").drop("kinds")


@query("partition_cover", """SELECT count(*) AS n, count(DISTINCT p_partkey) AS places, count(*) = count(DISTINCT p_partkey) AS disjoint,
  max(p_partkey) + 1 = count(DISTINCT p_partkey) AS cover, count(DISTINCT p_partkey % 11) AS classes FROM part""")
def partition_cover(spark, sf_dir):
    places = F.count_distinct("p_partkey")
    return load(spark, sf_dir, "part").agg(
        F.count("*").alias("n"), places.alias("places"), (F.count("*") == places).alias("disjoint"), (F.max("p_partkey") + 1 == places).alias("cover"), F.count_distinct(F.col("p_partkey") % 11).alias("classes")
    )


@query("classify_case", """SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') OR starts_with(p_name, 'hot') THEN 'via' WHEN contains(p_name, 'gear') THEN 'filler'
  WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'logic' ELSE 'other' END AS kind,
  p_type IN ('ECONOMY', 'STANDARD') AND NOT contains(p_name, 'gear') AS is_logic FROM part""")
def classify_case(spark, sf_dir):
    name, plain = F.col("p_name"), F.col("p_type").isin("ECONOMY", "STANDARD")
    kind = relate.first_match([("via", name.startswith("red") | name.startswith("hot")), ("filler", name.contains("gear")), ("logic", plain)], "other")
    return load(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), (plain & ~name.contains("gear")).alias("is_logic"))


SUFFIXES = ["ring", "large ring", "bolt", "gear", "blue bolt", "widget"]


@query("suffix_type_inference", f"""WITH dim(k) AS (VALUES {", ".join(f"('{s}')" for s in SUFFIXES)})
SELECT p_partkey, coalesce((SELECT max_by(k, length(k)) FROM dim WHERE n = replace(k, ' ', '_') OR n LIKE '%\\_' || replace(replace(k, ' ', '_'), '_', '\\_') ESCAPE '\\'), string_split(n, '_')[-1]) AS inferred
FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)""".replace("max_by(k, length(k))", "replace(max_by(k, length(k)), ' ', '_')"))
def suffix_type_inference(spark, sf_dir):
    named = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    known = spark.createDataFrame([(s.replace(" ", "_"),) for s in SUFFIXES], "known string")
    return names.infer_by_suffix(named, "name", known).select("p_partkey", "inferred")


@query("suffix_of_many", """WITH known AS (SELECT 'k_' || CAST(c_custkey AS VARCHAR) || '_' || CAST(c_nationkey AS VARCHAR) AS k FROM customer),
n AS (SELECT o_orderkey, 'U_k_' || CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey % 25 AS VARCHAR) AS name FROM orders)
SELECT o_orderkey, coalesce(k, string_split(name, '_')[-1]) AS inferred FROM n LEFT JOIN known ON name = 'U_' || k""")
def suffix_of_many(spark, sf_dir):
    """Names against as many known ones as there are customers."""
    key = lambda c, d: F.concat_ws("_", F.lit("k"), F.col(c).cast("string"), F.col(d).cast("string"))
    known = load(spark, sf_dir, "customer").select(key("c_custkey", "c_nationkey").alias("known"))
    orders = load(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 25)
    named = orders.select("o_orderkey", F.concat(F.lit("U_"), key("o_custkey", "m"), F.lit("_7")).alias("name"))
    return names.infer_by_suffix(named, "name", known).select("o_orderkey", "inferred")


@query("resolve_cascade", """SELECT k AS key, CASE WHEN p_partkey IS NOT NULL THEN 'part' WHEN s_suppkey IS NOT NULL THEN 'supplier' WHEN c_custkey IS NOT NULL THEN 'customer' END AS kind,
  CASE WHEN p_partkey IS NOT NULL THEN p_name WHEN s_suppkey IS NOT NULL THEN s_name WHEN c_custkey IS NOT NULL THEN c_name END AS value
FROM (SELECT o_custkey + o_orderkey % 3 AS k FROM orders) LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON k = p_partkey LEFT JOIN supplier ON k = s_suppkey LEFT JOIN customer ON k = c_custkey""")
def resolve_cascade(spark, sf_dir):
    asked = load(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3).alias("key"))
    dims = [("part", load(spark, sf_dir, "part").where("p_size < 10"), "p_partkey", "p_name"), ("supplier", load(spark, sf_dir, "supplier"), "s_suppkey", "s_name"), ("customer", load(spark, sf_dir, "customer"), "c_custkey", "c_name")]
    return relate.resolve_cascade(asked, "key", dims)


PREFIXES = ["Brand", "Brand#2", "Brand#25", "Brand#99", "Bran"]


@query("prefix_unique", f"""WITH names AS (SELECT DISTINCT replace(p_brand, '#', '_') AS b FROM part), asked(prefix) AS (VALUES {", ".join(f"('{p.replace('#', '_')}')" for p in PREFIXES)}),
found AS (SELECT prefix, count(b) AS n, min(b) AS lo, coalesce(bool_or(b = prefix), false) AS exact FROM asked LEFT JOIN names ON b = prefix OR starts_with(b, prefix || '_') GROUP BY prefix)
SELECT prefix, n, CASE WHEN exact THEN prefix ELSE lo END AS first, CASE WHEN exact THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM found""")
def prefix_unique(spark, sf_dir):
    brands = load(spark, sf_dir, "part").select(F.translate("p_brand", "#", "_").alias("brand")).distinct()
    return relate.resolve_prefix([p.replace("#", "_") for p in PREFIXES], brands, "brand")


@query("semi_overlap", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_overlap(spark, sf_dir):
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_hidden", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_hidden(spark, sf_dir):
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("containment_division", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)")
def containment_division(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("state", F.concat("l_returnflag", "l_linestatus"))
    return relate.covering(lines, "l_orderkey", "state", lines.select(F.col("state").alias("wanted")))


@query("set_equality_groups", """SELECT members, count(*) AS n, min(l_orderkey) AS first FROM (SELECT l_orderkey, string_agg(s, ',' ORDER BY s) AS members FROM
  (SELECT DISTINCT l_orderkey, lpad(CAST(l_suppkey % 10 AS VARCHAR), 2, '0') AS s FROM lineitem) GROUP BY l_orderkey) GROUP BY members""")
def set_equality_groups(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.lpad((F.col("l_suppkey") % 10).cast("string"), 2, "0").alias("s"))
    return relate.equal_sets(lines, "l_orderkey", "s")


@query("catalogue_diff", "SELECT coalesce(p_partkey, l_partkey) AS part, CASE WHEN p_partkey IS NULL THEN 'right' WHEN l_partkey IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT p_partkey FROM part WHERE p_size > 5) FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) ON p_partkey = l_partkey")
def catalogue_diff(spark, sf_dir):
    known = load(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("part"))
    used = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("part"))
    return relate.presence(known, used, "part")


def _nation_keys(spark, sf_dir):
    return load(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


@query("set_union", f"{_C} UNION {_S}")
def set_union(spark, sf_dir):
    a, b = _nation_keys(spark, sf_dir)
    return a.union(b).distinct()


@query("set_intersect", f"{_C} INTERSECT {_S}")
def set_intersect(spark, sf_dir):
    a, b = _nation_keys(spark, sf_dir)
    return a.intersect(b)


@query("set_except", f"{_C} EXCEPT {_S}")
def set_except(spark, sf_dir):
    a, b = _nation_keys(spark, sf_dir)
    return a.subtract(b)


@query("set_drift", f"SELECT k, 'old' AS side FROM ({_C} EXCEPT ALL {_S}) UNION ALL SELECT k, 'new' AS side FROM ({_S} EXCEPT ALL {_C})")
def set_drift(spark, sf_dir):
    return relate.drift(*_nation_keys(spark, sf_dir))


@query("self_feedback_motif", """SELECT a.l_orderkey AS flop, a.l_partkey AS d_net, min(b.l_suppkey) AS hold FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) a JOIN
  (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey AND (a.l_suppkey = b.l_suppkey OR a.l_orderkey = b.l_suppkey) GROUP BY ALL""")
def self_feedback_motif(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"))
    return motifs.self_feedback(lines).select(F.col("owner").alias("flop"), F.col("key").alias("d_net"), "hold")


@query("layer_semi", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('N', 'O'))")
def layer_semi(spark, sf_dir):
    layers = spark.createDataFrame([("R", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return load(spark, sf_dir, "lineitem").join(F.broadcast(layers), ["l_returnflag", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("enrich_terminals", """SELECT l_orderkey, l_partkey, CASE WHEN p_size IS NULL THEN 'unknown' WHEN l_linenumber = 7 THEN 'power' WHEN l_linenumber <= 2 THEN 'output' ELSE 'input' END AS direction,
  CASE WHEN p_size IS NULL THEN 'unknown' WHEN l_linenumber = 7 THEN 'power' WHEN l_linenumber = 3 THEN 'clock' WHEN l_linenumber = 4 THEN 'reset' WHEN p_size % 2 = 0 AND l_linenumber <= 2 THEN 'state' ELSE 'data' END AS role, count(*) AS n
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') ON l_partkey = p_partkey WHERE NOT (p_size IS NOT NULL AND l_linenumber = 7) GROUP BY ALL""")
def enrich_terminals(spark, sf_dir):
    cells = load(spark, sf_dir, "part").where("p_type <> 'PROMO'").select("p_partkey", "p_size")
    pin, known = F.col("l_linenumber"), F.col("p_size").isNotNull()
    direction = relate.first_match([("unknown", ~known), ("power", pin == 7), ("output", pin <= 2)], "input")
    role = relate.first_match([("unknown", ~known), ("power", pin == 7), ("clock", pin == 3), ("reset", pin == 4), ("state", (F.col("p_size") % 2 == 0) & (pin <= 2))], "data")
    found = load(spark, sf_dir, "lineitem").join(cells, F.col("l_partkey") == F.col("p_partkey"), "left")
    return found.select("l_orderkey", "l_partkey", direction.alias("direction"), role.alias("role")).where("role <> 'power'").groupBy("l_orderkey", "l_partkey", "direction", "role").agg(F.count("*").alias("n"))


@query("unknown_fallback", """SELECT p_partkey, array_to_string(list_filter(['bolt', 'ring', 'widget'], lambda x: list_contains(string_split(p_name, ' '), x)), ',') AS outputs,
  array_to_string(list_sort(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['bolt', 'ring', 'widget'], x))), ',') AS inputs FROM part""")
def unknown_fallback(spark, sf_dir):
    known, pins = F.array(*map(F.lit, ("bolt", "ring", "widget"))), F.split("p_name", " ")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_intersect(known, pins), ",").alias("outputs"), F.array_join(F.array_sort(F.array_except(pins, known)), ",").alias("inputs"))


@query("alias_explode", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, string_split(p_name, ' ')[i] AS alias FROM part, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS t(i)")
def alias_explode(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "alias"))


@query("describe_source", """SELECT n_name, CASE WHEN n_nationkey < 3 THEN 'port ' || n_name WHEN count(s_suppkey) = 0 THEN 'undriven' WHEN count(s_suppkey) = 1 THEN min(s_name)
  ELSE 'drivers: ' || string_agg(s_name, ', ' ORDER BY s_suppkey) END AS source FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 4000 GROUP BY n_nationkey, n_name""")
def describe_source(spark, sf_dir):
    drivers = load(spark, sf_dir, "supplier").where("s_acctbal > 4000").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("d"))
    listed = F.array_join(F.transform("d", lambda s: s["s_name"]), ", ")
    source = F.when(F.col("n_nationkey") < 3, F.concat(F.lit("port "), "n_name")).when(F.col("d").isNull(), "undriven").when(F.size("d") == 1, F.col("d")[0]["s_name"]).otherwise(F.concat(F.lit("drivers: "), listed))
    return load(spark, sf_dir, "nation").join(drivers, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", source.alias("source"))


@query("state_map", """SELECT e.event_id, coalesce(s.s_name, c.c_name) AS net FROM events e LEFT JOIN supplier s ON e.user_id = s.s_suppkey LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def state_map(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "user_id")
    dims = [("state", load(spark, sf_dir, "supplier"), "s_suppkey", "s_name"), ("net", load(spark, sf_dir, "customer"), "c_custkey", "c_name")]
    return relate.resolve_cascade(events, "user_id", dims).select("event_id", F.col("value").alias("net"))


@query("map_override", "SELECT event_id, CASE event_type WHEN 'error' THEN -1.0 WHEN 'signup' THEN 0.0 ELSE value END AS v, CASE WHEN event_type = 'error' THEN 'floating' ELSE 'pin' END AS origin FROM events")
def map_override(spark, sf_dir):
    base = F.create_map(F.lit("v"), F.col("value"))
    pinned = F.when(F.col("event_type") == "error", F.create_map(F.lit("v"), F.lit(-1.0))).when(F.col("event_type") == "signup", F.create_map(F.lit("v"), F.lit(0.0))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(pinned, "v")), pinned)
    origin = F.when(F.col("event_type") == "error", "floating").otherwise("pin")
    return load(spark, sf_dir, "events").select("event_id", F.element_at(merged, "v").alias("v"), origin.alias("origin"))


@query("member_parts", """SELECT p_brand, concat_ws(', ', CASE WHEN m > 0 THEN m || ' muxes' END, CASE WHEN f > 0 THEN f || ' flops' END, CASE WHEN o > 0 THEN o || ' others' END) AS summary FROM
  (SELECT p_brand, count(*) FILTER (WHERE p_size = 2) AS m, count(*) FILTER (WHERE p_size = 3) AS f, count(*) FILTER (WHERE p_size > 48) AS o FROM part GROUP BY p_brand)""")
def member_parts(spark, sf_dir):
    def part(condition, word):
        n = F.count_if(condition)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))

    size = F.col("p_size")
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat_ws(", ", part(size == 2, "muxes"), part(size == 3, "flops"), part(size > 48, "others")).alias("summary"))


@query("hidden_nets", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity < 40) AND NOT bool_or(l_linenumber = 1)")
def hidden_nets(spark, sf_dir):
    found = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") < 40).alias("inside"), F.bool_or(F.col("l_linenumber") == 1).alias("boundary"))
    return found.where("inside AND NOT boundary").select("l_orderkey")


@query("output_lookup", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'A&B' WHEN 1 THEN 'A|B' WHEN 2 THEN 'A^B' ELSE '!(A&B)' END AS expression FROM part")
def output_lookup(spark, sf_dir):
    table = F.create_map(*[F.lit(x) for kv in {0: "A&B", 1: "A|B", 2: "A^B", 3: "!(A&B)"}.items() for x in kv])
    text = F.element_at(table, F.col("p_size") % 4)
    return load(spark, sf_dir, "part").select("p_partkey", F.coalesce(text, F.raise_error(F.lit("no such output"))).alias("expression"))


@query("any_all", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_and(l_quantity > 5) AS all_q FROM lineitem GROUP BY l_orderkey")
def any_all(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_r"), F.bool_and(F.col("l_quantity") > 5).alias("all_q"))


@query("bbox_minmax", """SELECT p_brand, min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1,
  round((min(p_size) + max(p_size)) / 2.0, 3) AS cx, round((min(p_retailprice) + max(p_retailprice)) / 2.0, 3) AS cy FROM part GROUP BY p_brand""")
def bbox_minmax(spark, sf_dir):
    x, y = F.col("p_size"), F.col("p_retailprice")
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.round((F.min(x) + F.max(x)) / 2.0, 3).alias("cx"), F.round((F.min(y) + F.max(y)) / 2.0, 3).alias("cy"))


@query("union_of_sets", "SELECT l_suppkey // 2 AS pair, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def union_of_sets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.expr("l_suppkey div 2").alias("pair")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("string_kit", r"""SELECT c_custkey, regexp_extract(replace(c_name, '#', '.'), '^(.*)\.([^.]*)$', 1) AS owner, regexp_extract(replace(c_name, '#', '.'), '^(.*)\.([^.]*)$', 2) AS pin,
  regexp_replace(c_mktsegment, '[AEIOU]+', '_', 'g') AS thin, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, ends_with(c_name, '7') AS seven, trim('  ' || c_mktsegment || ' ') AS trimmed FROM customer""")
def string_kit(spark, sf_dir):
    owner, pin = names.owner_and_pin(F.translate("c_name", "#", "."))
    return load(spark, sf_dir, "customer").select(
        "c_custkey", owner.alias("owner"), pin.alias("pin"), F.regexp_replace("c_mktsegment", "[AEIOU]+", "_").alias("thin"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"),
        F.col("c_name").endswith("7").alias("seven"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
    )


@query("json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_number FROM events")
def json_field(spark, sf_dir):
    parsed = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    return load(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.k").rlike(r"^-?\d+$").alias("is_number"))


@query("sanitised_names", "SELECT p_partkey, trim(regexp_replace(p_name || '-' || p_brand || '!', '[^A-Za-z0-9_]+', '_', 'g'), '_') AS safe FROM part")
def sanitised_names(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", names.sanitised(F.concat("p_name", F.lit("-"), "p_brand", F.lit("!"))).alias("safe"))


@query("containment_pattern", """SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_suppkey % 5) AS deps FROM lineitem GROUP BY l_orderkey)
  WHERE list_has_all(deps, [0, 1]) AND list_has_all([0, 1, 2], deps)""")
def containment_pattern(spark, sf_dir):
    """Orders whose supplier classes hold both taps and nothing beyond the taps and the counter."""
    taps, allowed = F.array(F.lit(0), F.lit(1)).cast("array<bigint>"), F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>")
    deps = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 5).alias("deps"))
    return deps.where((F.size(F.array_except(taps, "deps")) == 0) & (F.size(F.array_except("deps", allowed)) == 0)).select("l_orderkey")
