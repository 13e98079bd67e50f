"""The HTML pass on broken markup, and plans that read a page once."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from siteq.operators import curriculum, pages
from siteq.operators.pages import parse_page

AUDIT = ("base", "links", "forms", "images", "h1_count", "fields", "labels", "lang", "title", "metas", "embeds", "visible_text", "tables")
BROKEN = {
    "unclosed headings": "<b>x" * 200_000,
    "nested heading classes": '<div class="header">' * 100_000 + "x" * 1000,
    "nested tables": "<table><tr><td>x" * 10_000,
    "nested tables that end": "<table><tr><td>x" * 10_000 + "</table>" * 10_000,
    "nested unit links": '<div onclick="go(curSunit=1)">x' * 50_000,
    "one open link": "<a href=x>" + "<i>y</i>" * 100_000,
    "fields of one name": "<form>" + "<select name=a><option value=1>x</select>" * 30_000,
    "nested spans": "<span id=a>x" * 100_000,
    "tables after a long line": "<p>" + "L" * 100_000 + "<table></table>" * 10_000,
    "options": "<optgroup><option>" * 60_000,
    "headings around links": '<b><a href="?curUnit=3">x</a>' * 50_000,
    "attributes": "<p " + "a=1 " * 200_000 + ">",
    "signs": "<" * 300_000,
    "tags in a tag": "<a " * 300_000,
    "comments": "<!--" * 200_000,
    "references": "&" * 300_000,
    "ends": "</b>" * 200_000,
    "quotes": '<a href="' * 100_001,
    "spaces": "<b>" + " " * 300_000 + "<b> x" * 1000,
}


@pytest.mark.parametrize("want", [AUDIT, ("marks",)], ids=["audit", "marks"])
@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_time_and_room_in_proportion(name, want):
    html = BROKEN[name]
    began = time.process_time()
    page = parse_page(html, *want)
    assert time.process_time() - began < 4
    assert len(json.dumps(page)) < 90 * len(html) + 10_000


def test_half_the_page_takes_half_the_time():
    """A page of which each quarter costs about the same."""

    def took(n):
        began = time.process_time()
        parse_page('<div class="header"><b>x<a href="?curUnit=2">y<table><tr><td>z' * n)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 8 * took(10_000) + 0.5


def test_markup_as_browsers_read_it():
    p = parse_page("""<!doctype html><HTML LANG=tr><title>A < b &amp; <i>c</title><p Title='>' class="x" CLASS=y>1 < 2 &amp;&nbsp;3<!-- <a href=no> --><br/>
    <a href="/x?a=1&copy=2&amp;b=&#51;" download>t<b>ext</b></a><a href='/y'>u</a><script>if (a < b) "<a href=no>"</script><textarea name=n><a href=no></textarea><a href=/z/><style>@media{}</style><img src=i alt><img src=j""")
    assert p["lang"] == "tr" and p["title"] == "A < b & <i>c" and p["has_media_query"]
    assert [(x["href"], x["text"].strip(), x["download"]) for x in p["links"]] == [("/x?a=1&copy=2&b=3", "text", True), ("/y", "u", False), ("/z/", "", False)]
    assert p["images"] == [{"src": "i", "alt": ""}] and p["visible_text"].startswith("1 < 2 & 3")


def test_comments_leave_nothing_behind():
    p = parse_page("a<!-- x > y <b>no</b> -->b<!-->c<!--->d<!--e--!>f<!---->g<!x>h<?php i ?>j</ k>l<!-- m", "visible_text", "marks")
    assert p["visible_text"] == "abcdfghjl" and p["marks"] == []


def test_only_leaf_tables_with_labels_of_their_own():
    p = parse_page("<p>first<table><tr><td>a</table><table><tr><th>b<td>c</table><p>outer <table><tr><td>inner label<table><tr><td>d</table></table><table><caption>cap</caption><tr><td>e</table>", "tables")
    assert [(t["label"], [[c["text"] for c in r] for r in t["rows"]]) for t in p["tables"]] == [("first", [["a"]]), ("", [["b", "c"]]), ("inner label", [["d"]]), ("cap", [["e"]])]


def test_nested_marks_keep_their_places():
    m = parse_page('<body><h2>A <b>B</b> c</h2><div class=title>D<a href="?curUnit=4">E</a><a href="?curSunit=07">F</a></div><h3>G</h3>', "marks")["marks"]
    assert [(x["tag"], x["text"].strip(), x["last"], x["links"], x["deep_unit"], x["deep_program"]) for x in m] == [
        ("h2", "A B c", 1, False, None, None), ("b", "B", 1, False, None, None), ("div", "DEF", 4, True, "4", "07"), ("a", "E", 3, False, "4", None), ("a", "F", 4, False, None, "07"), ("h3", "G", 5, False, None, None),
    ]


def test_long_names_of_links_stay_whole():
    long = "name " * 100
    m = parse_page(f'<b>{long}<a href="?curSunit=1">{long}<a href="?curSunit=2">{long}</a></a></b>', "marks")["marks"]
    assert [len(x["text"].strip()) for x in m] == [99, 999, 99]


def test_wanted_parts_only(spark):
    rows = spark.createDataFrame([(1, "https://s.example/", "<p>a<a href=b>c</a>", 7), (2, None, None, None)], "page_id long, url string, html string, more int")
    p = pages.parse_pages(rows, "links", "visible_text", carry=("more",))
    assert p.columns == ["page_id", "url", "more", "links", "visible_text"]
    assert [(r.page_id, r.more, len(r.links), r.visible_text) for r in p.orderBy("page_id").collect()] == [(1, 7, 1, "ac"), (2, None, 0, "")]
    assert pages.parse_pages(rows.limit(0), "links").count() == 0
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<a href=x>"), F.repeat(F.lit("long text "), 200)).alias("html"))
    assert pages.parse_pages(many, "links").select(F.sum(F.size("links"))).first()[0] == 3000


@pytest.mark.parametrize("read", [curriculum.course_details, curriculum.course_matrix, curriculum.matrix_cells, curriculum.plan_links, curriculum.plan_entries, curriculum.program_pages, curriculum.weekly_topics])
def test_readers_parse_a_page_once(spark, tmp_path, read):
    """One scan and one pass over the HTML in each reader's plan."""
    spark.createDataFrame([(1, "u", "<table><tr><td>x</table>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    plan = read(pages.html_tables(pages.parse_pages(spark.read.parquet(str(tmp_path / "p")), "tables")))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) == 1 and len(re.findall(r"MapInArrow", plan)) == 1
