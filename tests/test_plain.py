"""Queries that SQL cannot express, against plain Python over the same tables."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from siteq.operators import reviews, text
from siteq.plans import catalog, page_queries, review_queries, shot_queries


def test_question_marks(spark, sf):
    """Each hit of the two patterns that look around themselves, by Python's own expressions."""
    want = {}
    for r in shot_queries.damaged(spark, sf).collect():
        words = [w for w in re.split("[\\s\u00a0]+", r.text, flags=re.A) if "?" in w and not re.search(text.ADDRESS, w)]
        for name, where in (("soru_isareti", "\n".join(words)), ("mojibake", r.text)):
            if n := len(re.findall(text.PATTERNS[name], where)):
                want[r.doc_id, name] = n
    got = {(r.doc_id, r.pattern): r.n for r in catalog.QUERIES["g2_question_marks"](spark, sf).collect()}
    assert got == want and {p for _, p in want} == {"soru_isareti", "mojibake"}


class Shown(HTMLParser):
    """Text outside of hidden elements, a line for each block; the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.parts, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        if tag in page_queries.G.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        if tag in page_queries.G.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)


def test_visible_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", f"concat(html, {page_queries.EXTRA}) AS html").collect()
    want = {}
    for r in pages:
        p = Shown()
        p.feed(r.html)
        p.close()
        want[r.page_id] = "\n".join(x for x in (" ".join(s.split()) for s in "".join(p.parts).split("\n")) if x)
    got = {r.page_id: r.visible_text for r in catalog.QUERIES["g6_visible_text"](spark, sf).collect()}
    assert got == want


def test_random_per_group(spark, sf):
    """No group gives more than 25, each gives all that it has up to 25, and a second draw is the same."""
    candidates = reviews.arbiter_candidates(review_queries.records(spark, sf), review_queries.found(spark, sf), "claude", by_type=True)
    groups = defaultdict(set)
    for r in candidates.collect():
        groups[r.grp].add((r.file, r.slice))
    drawn = reviews.column_top(candidates, ["grp"], ["file"], 10**6)  # every candidate with its group
    got = [(r.file, r.slice) for r in catalog.QUERIES["f10_random_per_group"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == {(r.file, r.slice) for r in catalog.QUERIES["f10_random_per_group"](spark, sf).collect()}
    of = Counter(g for g, some in groups.items() for x in some if x in set(got))
    assert drawn.count() == sum(map(len, groups.values())) and all(of[g] >= min(25, len(some)) for g, some in groups.items())
    assert len(got) <= sum(min(25, len(some)) for some in groups.values()) and set(got) <= set().union(*groups.values())
    few = {(r.file, r.slice) for r in reviews.cap_per_group(candidates, 2, random=True).collect()}
    assert 0 < len(few) <= 2 * len(groups) and few <= set(got)
    assert few != {(r.file, r.slice) for r in reviews.cap_per_group(candidates, 2, random=True, seed=7).collect()}


def test_label_sample(spark, sf):
    """All findings to be seen by hand or not seen, 30 of those that were confirmed, no id twice, the same at each draw."""
    rows = [(r.id, r.verdict, r.source) for r in shot_queries.identified(spark, sf).collect()]
    of = defaultdict(set)
    for i, verdict, source in rows:
        if source != "http":
            of[verdict].add(i)
    got = {r.id: r.grp for r in catalog.QUERIES["j2_label_sample"](spark, sf).collect()}
    hand, unseen, sure = of["ELLE"], of["GORULMEDI"] - of["ELLE"], of["DOGRULANDI"]
    assert {i for i, g in got.items() if g == "elle"} == hand and {i for i, g in got.items() if g == "gorulmedi"} == unseen
    drawn = {i for i, g in got.items() if g == "ornek"}
    assert drawn <= sure - hand - unseen and len(drawn) <= 30 and len(drawn) + len(sure & (hand | unseen)) >= min(30, len(sure))
    assert got == {r.id: r.grp for r in catalog.QUERIES["j2_label_sample"](spark, sf).collect()}
