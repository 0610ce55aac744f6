import random

from topicloom.llm import queries, url_filter


def brute(url):
    """(host, path, rule, verdict by rule)."""
    rest = (url or "").partition("://")[2]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for kind, text in queries.URL_RULES:
        name, _, prefix = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            if best is None or len(text) > len(best[1]):
                best = (kind, text)
    return host, path, best[1] if best else None, best[0] if best else None


def odd_urls():
    rng = random.Random(5)
    parts = ["http", "://", "ORG", "org", ".", "example.org", "com", "/", "es/", "en/1", "fr/", "de/", "?", "#", "É", "\n", "a", "//", ":"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    return [None, "", "org/", "http://", "http://org", "x://Example.ORG/en/12?x", *made]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(odd_urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS n")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path, rule, verdict = brute(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_templates_learn_from_labels(spark):
    """Branches that rules block elsewhere are blocked on hosts without rules, and only those."""
    rows = [f"http://h{i % 3}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(120)]
    rows += [f"http://free.net/{lang}/{i}" for i in range(30) for lang in ("fr", "de")]
    rows += [f"http://free.net/{chr(97 + i % 26)}{chr(97 + i // 26)}x/end" for i in range(60)]
    pages = spark.createDataFrame([(None if i < 2 else i, u) for i, u in enumerate(rows)], "page_id long, url string")
    found = url_filter.filter_urls(pages, queries.URL_RULES).collect()
    assert len(found) == len(rows)
    free = [r for r in found if r.host == "free.net"]
    assert {r.verdict for r in free if r.path.startswith("/de/")} == {"block"}
    assert {r.verdict for r in free if r.path.startswith("/fr/")} == {"allow"}
    assert {r.template for r in free if r.path.endswith("x/end")} == {"/*/end"}


def test_no_labels_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, []).collect()] == ["allow", "allow"]
    assert url_filter.filter_urls(pages.where("false"), queries.URL_RULES).collect() == []


def test_deep_segments_and_any_size(spark):
    """The tree ends where paths end, and a host is judged alike in a crawl ten times its size."""
    rows = []
    for i in range(200):
        kind = ("fr", "de")[i % 2]
        rows += [f"http://a{i % 2}.com/{kind}/x/y/z/v{i}/end", f"http://free.net/k/l/m/n/o/{kind}/s{chr(97 + i % 26)}{chr(97 + i // 26)}q"]
        rows += [f"http://free.net/k/l/m/n/o/{kind}", f"http://long.net/{'/'.join('abc'[j % 3] for j in range(30))}/{i}"]
    rows += ["http://long.net/" + "seg" * 50_000]
    templates = []
    for times in (1, 10):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows * times)], "page_id long, url string")
        found = {r.path: r for r in url_filter.filter_urls(pages, [("block", "a1.com/de/"), ("allow", "a0.com/fr/")]).collect() if r.host != "a0.com"}
        assert found["/k/l/m/n/o/de/sbaq"].template == "/k/l/m/n/o/de/*"
        assert found["/k/l/m/n/o/fr"].template == "/k/l/m/n/o/fr"
        assert found[next(p for p in found if p.startswith("/a/b/c"))].template.count("/") == 31
        templates.append({p: r.template for p, r in found.items()})
    assert templates[0] == templates[1]
