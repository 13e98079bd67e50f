"""Queues, sitemaps and robots.txt against plain versions of the same."""

import random
from collections import deque
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from siteq.operators import site
from siteq.sources import files


def queue(links, seeds, max_depth, max_pages):
    """(url, depth, source) in the order in which a queue finds them."""
    out, seen, waiting = [], set(), deque()
    for u in seeds:
        if u not in seen:
            seen.add(u)
            waiting.append((u, 0, None))
    while waiting and (max_pages is None or len(out) < max_pages):
        u, depth, source = waiting.popleft()
        out.append((u, depth, source, len(out)))
        if depth < max_depth:
            for _, dst in sorted(links.get(u, [])):
                if dst not in seen:
                    seen.add(dst)
                    waiting.append((dst, depth + 1, u))
    return out


@pytest.mark.parametrize(("max_depth", "max_pages"), [(4, None), (9, 17), (9, 3), (0, None), (2, 25), (9, 1)])
def test_reach_is_that_of_a_queue(spark, max_depth, max_pages):
    """Cycles, links to itself, repeated links, several seeds, caps inside a level."""
    r = random.Random(max_depth)
    links = {f"u{r.randrange(30)}": [(k, f"u{r.randrange(40)}") for k in range(r.randrange(1, 7))] for _ in range(45)}
    seeds = ["u3", "u1", "u3", "u99"]
    rows = [(src, dst, k) for src, out in links.items() for k, dst in out]
    found = site.crawl_reach(spark.createDataFrame(rows, "src string, dst string, pos int").repartition(3), spark.createDataFrame(list(zip(seeds, range(4), strict=True)), "url string, pos int"), max_depth, max_pages)
    assert sorted(map(tuple, found.select("url", "depth", "source", "ord").collect()), key=lambda x: x[3]) == queue(links, seeds, max_depth, max_pages)


def test_reach_without_seeds(spark):
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert site.crawl_reach(links, spark.createDataFrame([], "url string"), 3).count() == 0
    assert [tuple(x) for x in site.crawl_reach(links, spark.createDataFrame([("a",), (None,)], "url string"), 3).select("url", "depth", "source").orderBy("depth").collect()] == [("a", 0, None), ("b", 1, "a")]


def test_sitemaps_in_a_chain_and_a_cycle(spark):
    """Three maps deep and back to the first, a map that is not stored, repeated and foreign addresses, a cap of maps."""
    m = lambda k: f"https://S.test/maps/{k}.xml"
    maps = [
        (m(1), f"<loc>{m(2)}</loc><loc> /a?utm_x=1&b=2#c </loc><loc>https://s.test/file.pdf</loc><loc>https://far.test/</loc>"), (m(2), f"<loc>{m(3)}</loc><loc>{m(1)}</loc><loc>{m(9)}</loc><loc>https://s.test/A</loc>"),
        (m(3), f"<loc>{m(1)}</loc><loc>{m(4)}</loc><loc>b/../c</loc><loc>https://s.test/A#x</loc>"), (m(4), "<loc>/late</loc>"), (m(7), "<loc>/never</loc>"), ("https://s.test/x", None),
    ]
    df = spark.createDataFrame(maps, "url string, xml string")
    starts = spark.createDataFrame([(m(1), 0)], "url string, pos int")
    pages, read = site.expand_sitemaps(df, starts, ["s.test"])
    assert {r.url for r in pages.collect()} == {"https://s.test/a?b=2", "https://s.test/A", "https://s.test/maps/c", "https://s.test/late"}
    assert [(r.url, r.depth) for r in read.orderBy("ord").collect()] == [(m(1), 0), (m(2), 1), (m(3), 2), (m(9), 2), (m(4), 3)]
    few, read = site.expand_sitemaps(df, starts, ["s.test"], most=3)
    assert read.count() == 3 and {r.url for r in few.collect()} == {"https://s.test/a?b=2", "https://s.test/A", "https://s.test/maps/c"}


def drawn(r):
    """A robots.txt with groups in any order, blank lines in and between them, comments, odd fields and line ends."""
    line = lambda: r.choice([
        f"User-agent: {r.choice(['*', 'siteq', 'SiteQ', 'bot', 'other', 'q/1'])}", f"user-agent:{r.choice(['*', 'siteq-bot', 'zz'])} # x", f"Disallow: {r.choice(['/', '/a', '/a/b', '/%61/c', '', '*', '/ç', '/x?y=1', '/a%2fb'])}",
        f"Allow: {r.choice(['/a/b', '/', '/b', '/x', ''])}", "", "", "# only a comment", "Crawl-delay: 3", "crawl-delay: x", "Request-rate: 1/5", "Sitemap: https://s.test/m.xml", "nonsense", "  Disallow : /b  ",
    ])
    return r.choice(["\n", "\r\n"]).join(line() for _ in range(r.randrange(1, 30)))


def test_robots_as_the_standard_library_reads_them(spark):
    r = random.Random(12)
    bodies = {f"h{k}.test": drawn(r) for k in range(150)}
    paths = ["", "/", "/a", "/a/b", "/a/c/d", "/b?q", "/x?y=1&z", "/x", "/%C3%A7", "/a%2Fb", "/zz"]
    want = set()
    for host, body in bodies.items():
        rp = RobotFileParser()
        rp.parse(body.splitlines())
        rp.modified()
        want |= {f"https://{host}{p}" for p in paths if rp.can_fetch("SiteQ-bot/2.0", f"https://{host}{p}")}
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h in [*bodies, "free.test"] for p in paths], "url string")
    rules = site.robots_rules(spark.createDataFrame(list(bodies.items()), "host string, body string"), "SiteQ-bot/2.0")
    got = {x.url for x in site.robots_filter(urls, rules).collect()}
    assert got - {f"https://free.test{p}" for p in paths} == want and len(got) - len(want) == len(paths)
    assert 0.2 < len(want) / (len(paths) * len(bodies)) < 0.98


def test_log_with_broken_lines(spark, tmp_path):
    lines = ['{"id": 1, "v": "a"}', "", '{"id": 2, "v": "b"', "null", '[{"id": 3}]', '{"id": "x"}', '{"id": 1, "v": "é", "more": {}}', "  ", '{"v": null}', '{"id": 4, "v": "cut']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"id": 5}\n')
    schema = spark.createDataFrame([], "id long, v string").schema
    good, bad = files.read_results(spark, str(tmp_path), schema)
    assert sorted((r.file[-7:], r.block, r.line, r.id, r.v) for r in good.where("id IS NOT NULL").collect()) == [("a.jsonl", 0, 0, 1, "a"), ("a.jsonl", 0, 6, 1, "é"), ("b.jsonl", 0, 0, 5, None)]
    assert good.where("id IS NULL").select("line").first()[0] == 8
    assert sorted((r.line, r.value) for r in bad.collect()) == [(k, lines[k]) for k in (2, 3, 4, 5, 9)]
    assert bad.select(F.count_distinct("file")).first()[0] == 1
