"""Host reputation against its SQL, by outcomes, and the cases that its docstring defines."""

import duckdb
from pyspark.sql import functions as F

from netloom.llm import registry, reputation

SF = "/root/testdata/sf0.001"


def test_reputation(spark):
    urls = [(i, f"http://good.example.net/{i}") for i in range(30)] + [(i, f"http://bad.example.net/{i}") for i in range(30, 60)]
    urls += [(100, "http://good.example.net/x"), (101, "http://bad.example.net/x"), (102, "HTTP://A.Org/b?c#d"), (103, None), (104, "nonsense"), (105, "http://x.example.org/es/1"), (106, "https://org"), (107, "http://forg/"), (108, "a://b://c/d"), (109, "http://EXAMPLE.org/en/12?x"), (109, "http://EXAMPLE.org/en/12?x")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    good = F.when(F.col("page_id") < 60, F.col("page_id") < 30)
    rows = reputation.judge(pages, good=good).collect()
    found = {r.page_id: r for r in rows}
    assert len(rows) == len(urls)
    assert found[100].verdict == "allow" and found[101].verdict == "block" and found[100].bound > found[101].bound
    assert (found[102].host, found[102].path, found[102].rule, found[102].verdict) == ("a.org", "/b", "org/", "allow")
    assert (found[103].host, found[103].path, found[103].rule) == (found[104].host, found[104].path, found[104].rule) == ("", "", None)
    assert (found[105].rule, found[105].verdict) == ("example.org/es/", "block") and found[106].rule is None and found[107].rule is None
    assert (found[108].host, found[108].path) == ("b:", "//c/d") and found[109].rule == "example.org/en/1"
    assert reputation.judge(pages.where("false")).count() == 0
    assert reputation.judge(pages, rules=()).where("verdict NOT IN ('allow', 'block')").isEmpty()


def test_registered_domain(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.com": ("com", "b.com"), "com": ("com", "com"), "": ("", ""), "x.y.z.com": ("com", "z.com"), "a.com:8080": ("com", "a.com"), "co.uk": ("co.uk", "co.uk"),
        "me@a.b.net:1": ("net", "b.net"), "a.b.org.": ("org", "b.org"), "10.0.0.1:80": ("ip", "10.0.0.1"), "[::1]": ("ip", "[::1]"), "a.b.github.io": ("io", "github.io"), "x.city.kobe.jp": ("jp", "kobe.jp"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.suffix, r.domain) for r in reputation.with_domains(hosts).collect()} == want
    listed = spark.createDataFrame([("github.io",), ("io",), ("kobe.jp",)], "suffix string")
    found = {r.host: (r.suffix, r.domain) for r in reputation.with_domains(hosts, listed).collect()}
    assert found == want | {"a.b.github.io": ("github.io", "b.github.io"), "x.city.kobe.jp": ("kobe.jp", "city.kobe.jp")}


def test_a_table_of_rules_says_the_same(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    names = ["page_id", "host", "path", "rule", "verdict", "bound"]
    plain = sorted(map(repr, reputation.judge(pages).select(names).collect()))
    for rules in (spark.createDataFrame(list(reputation.RULES), "verdict string, rule string"), list(reputation.RULES) + [("block", f"h{i}.example.com/") for i in range(300)]):
        assert sorted(map(repr, reputation.judge(pages, rules=rules).select(names).collect())) == plain


def test_sql_says_the_same_of_odd_urls(spark, tmp_path):
    urls = [None, "", "no", "http://", "http://a.com:80/fr/1", "http://a.com/de/2", "http://b.co.uk/de/", "http://u@b.co.uk", "http://10.1.2.3/x", "HTTP://X.ORG/y", "http://c.com./en", "http://a.com/" + "z" * 200_000, "http://a.com/fr/1"]
    spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)] + [(3, "no")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}/pages.parquet{'/*.parquet' if folder == str(tmp_path) else ''}'")
        want = con.execute(reputation.SQL)
        names = [d[0] for d in want.description]
        assert sorted(map(repr, map(tuple, registry.op7_reputation(spark, folder).select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_the_method_blocks_and_allows_pages_without_a_rule(spark):
    verdicts = {r[0]: r[1] for r in registry.op7_reputation(spark, "/root/testdata/sf0.1").where("rule IS NULL").groupBy("verdict").count().collect()}
    assert set(verdicts) == {"allow", "block"}


def test_a_young_host_leans_on_its_domain(spark):
    """Two hosts without outcomes of their own: one in a domain of bad hosts, one in a domain of good ones."""
    rows = [(f"http://h{i}.{d}.com/{j}", d == "good") for d in ("good", "bad") for i in range(5) for j in range(20)] + [("http://new.good.com/", None), ("http://new.bad.com/", None)]
    pages = spark.createDataFrame(rows, "url string, outcome boolean")
    found = {r.host: r for r in reputation.judge(pages, rules=(), good=F.col("outcome")).collect()}
    assert found["new.good.com"].verdict == "allow" and found["new.bad.com"].verdict == "block"
    assert found["h0.bad.com"].bound < found["new.bad.com"].bound < found["new.good.com"].bound < found["h0.good.com"].bound
