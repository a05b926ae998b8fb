import pytest
from pyspark.sql import functions as F

from contamgraph.llm.queries import URL_RULES
from contamgraph.llm.url_rules import compile_host_rule, compile_pattern, filter_urls

URLS = {
    "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"), "https://x.example.com/en/75?q": ("x.example.com", "/en/75", "example.com/en/7", "allow"),
    "http://EXAMPLE.COM/en/7": ("example.com", "/en/7", "example.com/en/7", "allow"), "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "http://a.net/de/": ("a.net", "/de/", "net/de/", "allow"), "http://m.example.net/de/8x#t": ("m.example.net", "/de/8x", "example.net/de/8", "block"),
    "http://a.org/es": ("a.org", "/es", None, "allow"), "http://a.org/ES/": ("a.org", "/ES/", None, "allow"), "http://com?x=/en/": ("com", "", None, "allow"),
    "ftp://www.spam-farm.example.org/es/1": ("www.spam-farm.example.org", "/es/1", "org/es/", "block"), "http://spam-farm.example.org:80/": ("spam-farm.example.org:80", "/", None, "block"),
    "http://spam-farm.example.org/en/2": ("spam-farm.example.org", "/en/2", None, "block"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
    "http://x.dev/a/phishing/b": ("x.dev", "/a/phishing/b", None, "block"), "http://example.org/about?casino=1": ("example.org", "/about", None, "allow"),
    "http://x.dev/?casino=1": ("x.dev", "/", None, "block"), "http://x.dev/occasino": ("x.dev", "/occasino", None, "allow"), "http://com/en/\n": ("com", "/en/\n", "com/en/", "block"),
}


def test_verdicts(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, None, *URLS])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("token", F.lit(2)).withColumn("kind", F.lit(3))
    out = filter_urls(df, URL_RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == len(rows) and {"token", "kind"} <= set(out.columns)
    for i, u in rows:
        assert got[i] == (URLS[u] if u is not None else ("", "", None, "allow")), u


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    plan = filter_urls(df, URL_RULES)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_many_rules_are_joined_by_shuffle(spark, monkeypatch):
    import contamgraph.llm.url_rules as U

    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    rules = [(f"h{i}.com", f"/p{i}/", "block") for i in range(50)]
    df = spark.createDataFrame([(i, f"http://a.h{i}.com/p{i}/x") for i in range(60)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, rules, ()).collect()}
    assert got == {i: "block" if i < 50 else "allow" for i in range(60)}


def test_compilation():
    assert compile_host_rule("Com", "/en/", "block")[4] == ["com", "en"]
    assert compile_host_rule("example.com", "/en/7", "allow")[4] == ["example", "com", "en"]
    assert compile_pattern("@@||ads.x.com^*foo")[2:5:2] == ("allow", ["ads", "x", "com"])
    assert compile_pattern("banner")[4] == []
    for bad in (("com", "en", "block"), ("com", "/", "maybe")):
        with pytest.raises(ValueError):
            compile_host_rule(*bad)


def test_empty_table_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(none, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert filter_urls(one, [], ()).first()["verdict"] == "allow"
