"""Known inputs and outputs, and sources that read files."""

import pytest
from pyspark.sql import functions as F

from siteq.functions import urls as U
from siteq.operators import audits, pages, progress, relations, site, text
from siteq.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("href", "want"), [
    ("notes.html?fbclid=9&page=3&utm_campaign=q#top", ("https://desk.test/guide/notes.html?page=3", "sayfa")), ("//desk.test/files/Plan.DOCX", ("https://desk.test/files/Plan.DOCX", "belge")),
    ("http://far.test:8080/x", ("http://far.test:8080/x", "dis")), ("tel:+90", (None, "sema")), ("img/a.WEBP", ("https://desk.test/guide/img/a.WEBP", "dosya")), ("/private/7", ("https://desk.test/private/7", "haric")),
    ("./../../a//b/../c", ("https://desk.test/a/c", "sayfa")), ("?z=1&y= 2&z=0", ("https://desk.test/guide/?y=+2&z=0&z=1", "sayfa")), ("  /spaced ", ("https://desk.test/spaced", "sayfa")),
])
def test_urls(spark, href, want):
    url = U.normalize_url(F.col("h"), F.lit("https://Desk.TEST/guide/"))
    df = spark.createDataFrame([(href,)], ["h"]).select(url.alias("u"))
    row = df.select("u", U.classify_url(F.col("u"), U.in_site(U.authority(F.col("u")), ["desk.test"]), exclude=["/private"]).alias("c")).first()
    assert (row["u"], row["c"]) == want


def test_query_cap(spark):
    """Three variants a path and host, those without a query without limit; later ones go."""
    urls = ["https://d.test/p?k=9", "https://d.test/p", "https://d.test/p?k=8", "https://e.test/p?k=9", "https://d.test/p?a", "https://d.test/p?b", "https://d.test/p", "https://d.test/q?b"]
    df = spark.createDataFrame(list(enumerate(urls)), ["k", "url"])
    assert sorted(r.k for r in site.cap_query_variants(df, 3, ["k"]).collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert site.cap_query_variants(df, 0, ["k"]).count() == len(urls)


def test_reach_with_a_cycle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], ["src", "dst"])
    got = {r.url: r.depth for r in site.crawl_reach(links, spark.createDataFrame([("a",)], ["url"]), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


@pytest.mark.parametrize(("line", "want"), [
    ("[7/31] FAIL /a", (7, 31)), ("   18/18", (18, 18)), ("2750 sayfa | kuyruk 0 | 3 hata", (2750, 2750)), ("hiz=2 biten=40 toplam=39", None), ("biten_kod=0 toplam_kod=8 sn", (0, 8)), ("saat 12/24 oldu", None), ("[9/4]", None), ("bitti", None),
    ("x [001/020] y", (1, 20)), ("biten=3 toplam=3", (3, 3)),
])
def test_progress(spark, line, want):
    got = one(spark, progress.progress(F.col("line")), line=line)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("line", "want"), [
    ("  ValueError: bad", "hata"), ("ZeroDivisionError", "hata"), ("HATA : disk", "hata"), ("x ❌ y", "hata"), ("✖", "hata"), ("panic: nil", "hata"), ("Fatal error", "hata"), ("fatality", None), ("write: No Space Left On Device", "hata"), ("ERROR z", "hata"),
    ("UYARI yavas", "uyari"), ("⚠", "uyari"), ("Warning: y", "uyari"), ("[2/3] ERROR z", "uyari"), ("level=WARNING", "uyari"), ("hatasiz", None), ("\t", None), ("uyarı", None),
])
def test_problem(spark, line, want):
    assert one(spark, progress.problem(F.col("line")), line=line) == want


@pytest.mark.parametrize(("rows", "window", "want"), [
    ([(5.0, 0.25, False), (25.0, 0.5, False), (26.0, 0.4, False)], 600, [None, 40.0, 42.0]), ([(0.0, 0.1, False), (4.0, 0.3, True), (24.0, 0.5, False)], 600, [None, None, 60.0]), ([(0.0, 0.0, False), (100.0, 0.5, False), (200.0, 0.6, False)], 90, [None, 100.0, 400.0]),
])
def test_eta(spark, rows, window, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "run_id long, t double, ratio double, skip boolean")
    assert [r["remaining"] for r in progress.eta(df, "run_id", "t", window).orderBy("t").collect()] == pytest.approx(want)


def test_text(spark):
    assert one(spark, text.norm(F.col("t")), t="  Dersin ÖĞRENME  Çıktıları ") == "dersin ogrenme ciktilari"
    assert one(spark, text.clean_lines(F.col("t")), t=" a \n\n b  c ") == "a\nb c"
    assert one(spark, pages.numbered_items(F.col("t")), t="Kısım 5. giriş 1) Ölçer, 4.2 ile 2. Yorumlar 30) ayrı 3) Yazar.\nalt satır") == ["Ölçer, 4.2 ile", "Yorumlar 30. ayrı", "Yazar"]
    assert one(spark, pages.numbered_items(F.col("t")), t="yalnız 1) başlık") is None
    assert [one(spark, text.ordinal_no(F.col("t")), t=t) for t in ("1", "1.", "PÇ1", "ÖÇ 3", "3. x")] == [1, 1, 1, 3, None]


def test_question_marks_outside_addresses(spark):
    df = spark.createDataFrame([(1, "s?z var https://a.b/c?d=x g?l"), (2, "ne? evet")], ["id", "text"])
    assert [(r.id, r.pattern, r.n) for r in text.text_patterns(df, "id").collect()] == [(1, "soru_isareti", 2)]


@pytest.mark.parametrize(("url", "want"), [("https://katalog.deniz-tip.edu.tr/a?b", "katalog_deniz_tip"), ("https://www.kule.com.tr", "kule"), ("https://9ay.net/", "s_9ay_net"), ("ftp://WWW.Site.TR", "site"), ("https://Obs.Ova.org.tr/q", "public")])
def test_site_key(spark, url, want):
    assert one(spark, relations.site_key(F.col("u"), "obs.ova.org.tr"), u=url) == want
    assert one(spark, relations.site_key(F.col("u")), u="https://obs.ova.org.tr/q") == "ova"


def test_link_classes(spark):
    assert one(spark, audits.link_class(F.col("s")), s="404") == "404 Bulunamadı"
    assert one(spark, audits.link_class(F.col("s")), s="getaddrinfo ENOTFOUND") == "Alan adı bulunamadı (DNS)"
    assert one(spark, audits.security_headers(F.col("h")), h={"X-Frame-Options": "x"})["present"] == ["x-frame-options"]


def test_html(spark):
    html = """<html lang="tr"><title> Ders </title><base href="/k/"><body><img src=a><h1>x</h1><form action=ara><input id=q><input type=hidden></form>
    <a href="b.pdf">Bel<b>ge</b></a><a href="file:///c/x">f</a><table><tr><td><table><caption>Ic</caption><tr><th>No</th><td>1</td></tr></table></td></tr></table>"""
    p = pages.parse_pages(spark.createDataFrame([(1, "https://s.example/a", html), (2, "https://s.example/b", None)], "page_id long, url string, html string"))
    a = pages.accessibility(p).where("page_id = 1").first()
    assert (a.images_without_alt, a.unlabeled_form_fields, a.missing_h1, a.has_lang, a.title) == (1, 1, False, True, "Ders")
    assert [(r.url, r.source) for r in pages.document_refs(p).collect()] == [("b.pdf", "dom"), ("file:///c/x", "dom(file:)")]
    assert {r.url for r in pages.page_links(p).collect()} == {"https://s.example/k/b.pdf", None, "https://s.example/k/ara"}
    assert [(r.key, r.value) for r in pages.table_kv(pages.html_tables(p)).collect()] == [("No", "1")]
    assert pages.forms(p).count() == 1 and p.count() == 2


@pytest.mark.parametrize("body", ['{"url_list": ["a", "b"]}', '{"pages": {"a": {"status": 200}, "b": 1}}', '{"urls": ["a", "b"]}', '["a", "b"]', '[{"url": "a"}, {"url": "b"}]'])
def test_url_lists(spark, tmp_path, body):
    (tmp_path / "x.json").write_text(body)
    assert [(r.url, r.pos) for r in files.read_url_list(spark, str(tmp_path / "x.json")).collect()] == [("a", 0), ("b", 1)]


@pytest.mark.parametrize("sep", [";", ","])
def test_csv(spark, tmp_path, sep):
    (tmp_path / "x.csv").write_text("﻿" + sep.join(["url", "not"]) + "\n" + sep.join(["u", '"ş"']) + "\n")
    df = files.read_csv_auto(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["url", "not"] and df.collect()[0]["not"] == "ş"


def test_charsets(spark):
    said = "Öğrenci işleri ışığı"
    rows = [(1, f'<meta charset="windows-1254">{said}'.encode("cp1254")), (2, said.encode("cp1254")), (3, ("x" * 4000 + said).encode()), (4, None)]
    got = {r.id: r.text for r in files.decode_pages(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert got[1].endswith(said) and got[2] == said and got[3].endswith(said) and got[4] is None
