import re

from marginalia.llm import url_rules as U

URLS = [
    None, "", "no scheme", "http://", "http://org", "https://EXAMPLE.org/es/a", "https://www.example.org/en/123?x=/de/", "https://example.org/en/2", "http://a.b.com/fr/x#y", "http://com/de/", "http://example.org:80/es/",
    "http://notexample.org/es/", "http://x.com/FR/", "http://x.com/de", "ftp://org/", "http://org?/", "http://a.org#/es/", "http://é.org/ü", "x://y://org/", "http://" + "a." * 300 + "com/fr/" + "z" * 3000, "http://org/\nline",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")


def test_against_scanning_all_rules(spark):
    rules = spark.createDataFrame(list(U.RULES), "host string, path string, verdict string")
    got = {r[0]: tuple(r)[1:] for r in U.judge(frame(spark, URLS * 2), rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}


def test_precedence_and_defaults(spark):
    rules = spark.createDataFrame([("Org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("b.org", "", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(frame(spark, ["http://a.org/x", "http://b.org", "http://c.net/", None]), rules, "allow").collect()}
    assert got == {0: ("org/", "block"), 1: ("b.org", "allow"), 2: (None, "allow"), 3: (None, "allow")}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in U.judge(frame(spark, URLS[:3]), none, "block").collect()] == ["block"] * 3
    assert U.judge(frame(spark, []), rules).count() == 0
