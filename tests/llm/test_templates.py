from pyspark.sql import functions as F

from rollbook.llm import catalog, templates

from ..conftest import DATA


def split(url):
    """Host and path by plain string steps."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule(host, path):
    fits = [(h, p, v) for h, p, v in catalog.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x", "http://example.org/en/12?a=/de/", "http://example.org/en/2", "http://badexample.org/es/", "https://a.com/fr/#/de/", "x://y://z/de/", "http://com/de/",
    "http://É.com/de/1", "http://a.net?x", "http://a.net#x", "http://org", "http://org/", "http://u@h.com:80/de/x", "http://a.com/de", "http://a.net/" + "s/" * 3000, "http://a.net/line\nbreak?q",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:5])), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS shape", "1 AS n", "'z' AS verdict")
    rows = templates.judge(df, catalog.RULES).collect()
    assert len(rows) == len(URLS) + 5
    for r in rows:
        host, path = split((URLS + URLS[:5])[r["page_id"]])
        found = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, found[0] + found[1] if found else None)
        assert r["verdict"] == (found[2] if found else "block" if r["purity"] >= 0.5 else "allow")
    assert templates.judge(df.limit(0), catalog.RULES).count() == 0


def test_every_page_has_a_verdict(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = catalog.QUERIES["op7_url_templates"](spark, DATA).collect()
    assert len(rows) == df.count() and {r["verdict"] for r in rows} <= {"allow", "block"}
    for r, url in ((r, u) for u in df.select("page_id", "url").collect() for r in rows if r["page_id"] == u["page_id"]):
        host, path = split(url["url"])
        found = rule(host, path)
        assert (r["host"], r["path"]) == (host, path) and (found is None or r["verdict"] == found[2])


def test_templates_follow_the_labels(spark):
    """Variable segments become wildcards; branches of unlike purity stay apart, alike ones merge; purity decides."""
    rows = []
    for i in range(60):
        rows += [("shop.com", f"/spam/{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}", 1 if i < 40 else None), ("shop.com", f"/news/{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}", 0 if i < 40 else None)]
        rows += [("other.com", f"/{'abc'[i % 3]}/{i}", i % 2), ("fresh.com", f"/p/{i}", None)]
    df = spark.createDataFrame(rows, "host string, path string, bad int")
    found = {(r["host"], r["shape"]): r for r in templates.template_purity(df).collect()}
    assert found["shop.com", "spam/aa/#"]["template"] == "/spam/*/*" and found["shop.com", "news/aa/#"]["template"] == "/news/*/*"
    assert found["shop.com", "spam/ta/#"]["purity"] > 0.7 and found["shop.com", "news/zb/#"]["purity"] < 0.3
    assert {r["template"] for (h, _), r in found.items() if h == "other.com"} == {"/*/*"}
    assert 0.3 < found["fresh.com", "p/#"]["purity"] < 0.7


def test_labels_below_a_variable_segment(spark):
    """A telling segment keeps its branch below one or two variable ones, and a star in a url is no wildcard."""
    rows = []
    for i in range(60):
        name = chr(97 + i % 26) + chr(97 + i // 26)
        for kind, bad in (("spam", 1), ("news", 0)):
            rows += [("one.com", f"/u/{name}/{kind}/{i}", bad if i < 40 else None), ("two.com", f"/{name}/x{name}/{kind}", bad)]
        rows += [("star.com", "/*/b", 1), ("star.com", "/c/b", 0), ("star.com", "/d/b", 0)]
    rows.append(("one.com", "/u/" + "s/" * 3000, None))
    found = {(r["host"], r["shape"]): r for r in templates.template_purity(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
    assert len(found) == 2 * 120 + 3 + 1
    for (host, shape), r in found.items():
        kind = next((k for k in ("spam", "news") if k in shape), None)
        if kind:
            assert r["template"] == (f"/*/*/{kind}/*" if host == "one.com" else f"/*/*/{kind}")
            assert r["purity"] > 0.7 if kind == "spam" else r["purity"] < 0.3
    assert found["one.com", "u/" + "s/" * 3000]["template"] == "/*" * 3002
    assert found["star.com", "*/b"]["template"] == "/*/*" and found["star.com", "c/b"]["template"] in ("/*/*", "/c/*")


def test_purity_is_smoothed_towards_the_levels_above(spark):
    df = spark.createDataFrame([("a.x.com", "/p", 1), ("a.x.com", "/p", 1), ("b.x.com", "/q", 0), ("c.org", "/r", None)], "host string, path string, bad int")
    up = lambda bad, labelled, prior: (bad + 10 * prior) / (labelled + 10)
    base = (2 + 0.5) / (3 + 2)
    domain = up(2, 3, up(2, 3, base))
    want = {"a.x.com": up(2, 2, up(2, 2, domain)), "b.x.com": up(0, 1, up(0, 1, domain)), "c.org": base}
    got = {r["host"]: r["purity"] for r in templates.template_purity(df).select("host", F.round("purity", 12).alias("purity")).collect()}
    assert got == {h: round(p, 12) for h, p in want.items()}
