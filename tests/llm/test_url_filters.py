"""URL rules against brute force."""

import random
import time

from framelake.llm.url_filters import HostRules, judge_urls


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if path.startswith(r[1]) and (host == r[0] or host.endswith("." + r[0]))]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "aa", "É", "x-y", "", "com", "\x01", "0"]
    name = lambda k: ".".join(rng.choice(labels) for _ in range(k))
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/b/"]
    rules = {(name(rng.randint(1, 3)), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items() if h]
    urls = [None, "", "nothing", "://", "http://", "x://A.B.com?x://y", "http://a#/a/", "http://a.b/a/\n?q", "ÉX://É.a/a"]
    urls += [f"{rng.choice(['http', 'HTTPS', ''])}://{name(rng.randint(0, 4))}{rng.choice(['', ':80'])}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#f', 'x'])}" for _ in range(1500)]
    urls += ["http://a.b.aa/a/b"] * 700  # a hot host
    rows = [(i if i % 50 else None, u, "clash") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    found = judge_urls(pages, spark.createDataFrame([*rules, (None, "/", "x"), ("b", None, "x")], "host string, path string, verdict string"), ranges=7, sample_rows=300).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, *brute(u, rules, "allow")) for i, u, _ in rows), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), none).count() == 0
    row = judge_urls(spark.createDataFrame([(1, "http://a.b/c?d")], "page_id long, url string"), none, default="block").first()
    assert tuple(row) == (1, "a.b", "/c", None, "block")


def test_many_path_rules_of_one_host_take_linear_time():
    def run(n):
        rules = HostRules("h.com")
        for path in sorted(f"/{k % 300}/{k}/" for k in range(n)):
            rules.add(path, "block")
        began = time.process_time()
        found = [rules.longest("www.h.com", f"/{k % 300}/{k}/x") for k in range(n)]
        assert all(r[1] == f"/{k % 300}/{k}/" for k, r in enumerate(found)) and rules.longest("h.com", "/x") is None and rules.longest("xh.com", "/1/1/") is None
        return time.process_time() - began

    assert run(50_000) < 5  # every rule against every path would be 2.5 billion tests


def test_nested_paths():
    rules = HostRules("h")
    for path in sorted(["", "/", "/a", "/a/", "/a/b/", "/ab", "/b"]):
        rules.add(path, path)
    for path, want in [("x", ""), ("/c", "/"), ("/a", "/a"), ("/a/b", "/a/"), ("/a/b/c", "/a/b/"), ("/abc", "/ab"), ("/ac", "/a"), ("/bb", "/b")]:
        assert rules.longest("h", path)[1] == want


def test_equal_rows_of_one_host_are_split(spark):
    """Null ids and one URL: the ranges part them by source partition."""
    pages = spark.createDataFrame([(None, "http://a.b/c")] * 4000, "page_id long, url string").repartition(8)
    found = judge_urls(pages, spark.createDataFrame([("b", "/", "block")], "host string, path string, verdict string"), ranges=4)
    assert found.where("rule = 'b/'").count() == 4000
