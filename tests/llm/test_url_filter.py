from pyspark.sql import functions as F

from logsluice.llm import url_filter as U

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def judged(spark, urls, rules=RULES):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit("x"), "n": F.lit(2)})
    rows = sorted(U.filter_urls(df, rules).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in rows] == list(range(len(urls)))
    return rows


def test_hosts_paths_and_rules(spark):
    rows = judged(spark, [
        "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "ftp://example.org", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/De/",
        None, "", "no scheme/de/", "http://", "http://u.com?q=/de/", "a://b://c.com/de/", "http://x.com/de/#", "http://ÄÉ.com/fr/é", "http://fr.com:80/de/",
    ])
    assert [(r.host, r.path, r.rule) for r in rows] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "", None),
        ("notexample.org", "/es/", "org/"), ("x.com", "/fr/", "com/fr/"), ("x.com", "/De/", None), ("", "", None), ("", "", None), ("", "", None),
        ("", "", None), ("u.com", "", None), ("b:", "//c.com/de/", None), ("x.com", "/de/", "com/de/"), ("ÄÉ.com", "/fr/é", "com/fr/"), ("fr.com:80", "/de/", None),
    ]
    assert [r.verdict for r in rows if r.rule] == ["block", "block", "allow", "allow", "block", "allow"]
    assert {r.verdict for r in rows} <= {"allow", "block"}


def test_branches_learn_from_rules(spark):
    rules = (("block", "s.com/shop/item1"), ("allow", "s.com/blog/"))
    urls = [f"http://s.com/shop/item{k}" for k in range(100, 130)] + ["http://s.com/shop/item7", "http://s.com/blog/a", "http://s.com/blog/b", "http://other.com/x"]
    by_url = dict(zip(urls, judged(spark, urls, rules)))
    other = by_url["http://s.com/shop/item7"]
    assert (other.template, other.rule, other.verdict) == ("/shop/*", None, "block")
    assert by_url["http://s.com/blog/a"].verdict == "allow" and by_url["http://other.com/x"].verdict == "allow"


def test_many_children_become_one_branch(spark):
    names = ["".join(chr(97 + int(d)) for d in str(10_000 + 37 * k)) for k in range(200)]
    rows = judged(spark, [f"http://h.com/wiki/{n}/talk" for n in names] + ["http://h.com/help/top"], ())
    assert {r.template for r in rows} == {"/wiki/*/talk", "/help/top"}


def test_empty_table_and_repeats(spark):
    assert judged(spark, []) == []
    assert len({(r.path, r.rule, r.template, r.verdict) for r in judged(spark, ["http://a.org/x"] * 5)}) == 1
