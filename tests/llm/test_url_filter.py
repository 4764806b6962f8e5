import re

from tillstone.llm import url_filter
from tillstone.llm.url_filter import Rule

URLS = [
    None, "", "no scheme", "http://", "://x.net/", "http://NET/", "http://a.b.NET", "http://a.b.net/", "https://xnet/", "ftp://example.net/en/",
    "http://www.example.net/en/x?y#z", "http://example.net/EN/", "http://example.net:80/en/", "http://u@example.net/en/", "http://net./",
    "http://example.com/de/", "http://deep.er.example.com/de/1", "http://example.com?/de/", "http://example.com#/de/", "http://example.org/fr/",
    "http://sub.example.org/fr/x/y", "http://example.org/FR/", "http://é.org/fr/", "http://a.org/fr", "http://net/a://b", "http://.net/", "http://exa.net-x/",
    "http://b.a.example.net/en/deep/er", "http://a.example.net/en/deep/",
]
RULES = [
    Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
    Rule("block", "a.example.net"), Rule("allow", "a.example.net", "/en/deep/"), Rule("allow", "net", ""), Rule("block", "net"),
]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(((len(r.host + r.path), r.host + r.path, r.verdict) for r in fits), default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_all_rules(spark):
    rows = [(at, url, "x", "y") for at, url in enumerate(URLS)] + [(0, None, "", ""), (None, URLS[5], "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, key string, host string").repartition(3)
    wanted = sorted(((page, *expected(url)) for page, url, *_ in rows), key=str)
    assert sorted((tuple(row) for row in url_filter.judged(pages, RULES).collect()), key=str) == wanted


def test_blocks_of_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RULES_PER_SWEEP", 3)
    test_against_all_rules(spark)


def test_one_host_goes_to_every_lane(spark):
    pages = spark.range(4000).selectExpr("id page_id", "'http://a.example.net/en/' url")
    found = url_filter.judged(pages, RULES).groupBy("rule").count().collect()
    assert [tuple(row) for row in found] == [("example.net/en/", 4000)]


def test_empty_table(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id bigint, url string"), RULES).count() == 0
