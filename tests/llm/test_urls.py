from procsight.llm import urls
from procsight.llm.queries import op6_url_filters
from tests.conftest import SF

URLS = [
    (1, None), (2, ""), (3, "no scheme.net/"), (4, "http://A.B.Example.COM/de/x?y#z"), (5, "http://example.com"), (6, "https://net/"),
    (7, "http://x.net?q=/de/"), (8, "ftp://user.org/fr/a/b/"), (9, "http://example.com/d"), (10, "http://example.com/de"), (11, "http://.com/de/"),
    (12, "http://badexample.com/de/x"), (13, "http://example.com/DE/x"), (14, "http://a.example.com//de/x"), (15, "http://example.com/deep/er/x"),
    (16, "a://b://c.net/"), (17, "http:///de/"), (17, "http:///de/"), (None, "http://x.net/"), (18, "http://x.net/" + "a/" * 300),
    (19, "http://example.com\n.net/a\nb/c"), (20, "http://éxample.net/ü/ÄB"),
]

RULES = [
    ("net", "/", "block"), ("Example.com", "/de/", "block"), ("example.com", "/de", "allow"), ("com", "", "allow"), ("org", "/fr/", "allow"),
    ("user.org", "/fr/a/b", "block"), ("x.net", "/", "block"), ("x.net", "/", "allow"), ("", "/de/", "block"), (None, "/", "block"), ("com", None, "block"),
]


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = lower(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for h, p, verdict in rules:
        if h is None:
            continue
        h, p = lower(h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), h + p, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_against_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in URLS], "page_id bigint, url string, html string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urls.judge(pages, rules).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, found), key=key) == sorted([(i, *plain(u, RULES)) for i, u in URLS], key=key)
    assert urls.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.where("false"), default="block").collect()} == {"block"}


def test_whole_table(spark):
    from procsight.llm.queries import RULES as own

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: tuple(r)[1:] for r in op6_url_filters(spark, SF).collect()}
    assert found == {r.page_id: plain(r.url, own) for r in pages}
