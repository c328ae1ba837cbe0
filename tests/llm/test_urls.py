from urllib.parse import quote

from tidemark.llm import urls as U

ODD = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x?y=1#z"), (5, "https://www.example.com/en/"), (6, "http://a.net/es/1"), (7, "http://a.net/fr/"),
       (8, "http://a.net/de/1"), (9, "http://com"), (10, "http://com/"), (11, "http://notexample.com/en/1"), (12, "http://x.example.com?q=/en/"), (13, "x://y://z.net/es/"),
       (14, "http:///path"), (15, "://net/fr/\n?#"), (16, "http://ÄB.net#/es/"), (16, "http://ÄB.net#/es/"), (None, "http://a.com/" + "x" * 5000)]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "<html>", 1, "s") for i, u in rows], "page_id bigint, url string, html string, label int, suffix string")


def test_hosts_paths_and_rules(spark):
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.ruled) for r in U.parsed(frame(spark, ODD)).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in ODD), key=str)


def test_verdicts(spark):
    got = U.judged(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.verdict for r in got} <= {"allow", "block"}
    assert all(r.verdict == brute(u)[3] for i, u in ODD if brute(u)[3] for r in got if r.page_id == i)
    assert U.judged(frame(spark, [])).count() == 0
    assert {r.verdict for r in U.judged(frame(spark, [(1, "http://x.org/"), (2, None)])).collect()} == {"allow"}


def test_trees_learn_from_ruled_urls(spark):
    rules = (("block", "bad.example", "/"), ("allow", "good.example", "/"))
    rows = [(i, f"http://a{i}.bad.example/{i * 7919}/{i * 104729}/{i}?a={i}&b={i}&c={i}") for i in range(300)]
    rows += [(1000 + i, f"http://good.example/{quote('page')}{'abcdefgh'[i % 8]}") for i in range(300)]
    rows += [(2000, "http://new.test/834723/2348723/1?a=1&b=2&c=3"), (2001, "http://new.test/pagea")]
    got = {r.page_id: r for r in U.judged(frame(spark, rows), rules).filter("page_id >= 2000").collect()}
    assert got[2000].verdict == "block" and got[2001].verdict == "allow"


def test_plan_has_no_python(spark):
    plan = U.judged(frame(spark, [(i, f"http://h{i % 7}.net/{'es' if i % 2 else 'en'}/") for i in range(50)]
                          + [(100 + i, f"http://h{i}.com/en/") for i in range(50)]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_every_suffix_keeps_its_rate(spark):
    rules = (("allow", "test", "/b/"), ("block", "b999.test", "/b/"))
    rows = [(10 * k + i, f"http://a.s{k:03}.test/b/{i}") for k in range(260) for i in range(4)]
    rows += [(5000 + i, f"http://a.b999.test/b/{i}") for i in range(3)]
    rows += [(9000, "http://a.b999.test/c/1"), (9001, "http://a.s123.test/c/1")]
    got = {r.page_id: r.verdict for r in U.judged(frame(spark, rows), rules).filter("page_id >= 9000").collect()}
    assert got == {9000: "block", 9001: "allow"}


def test_rare_verdict_is_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(U, "TRAIN_ROWS", 200)
    rules = (("allow", "test", "/"), ("block", "odd.example", "/"))
    rows = [(i, f"http://host.test/page{i % 10}") for i in range(3000)]
    rows += [(5000 + i, f"http://x.odd.example/{'9' * 40}?a={i}&b=1&c=2") for i in range(4)]
    rows += [(9000, f"http://new.site/{'9' * 40}?a=7&b=1&c=2"), (9001, "http://new.site/page5")]
    got = {r.page_id: r.verdict for r in U.judged(frame(spark, rows), rules).filter("page_id >= 9000").collect()}
    assert got == {9000: "block", 9001: "allow"}
