"""Queries on parsed pages: the full HTML pass (A4, C5-C7, C16, G6, K2-K4). The driver's pages get a form, images and a table by the same expression on both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteq.operators import pages as G
from siteq.sources.shared import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


EXTRA = """'<img src="a"><img src="b" alt="x">' || CASE WHEN page_id % 3 = 0 THEN '<h1>again</h1>' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '<meta name="viewport" content="w"><style>@media print {}</style>' ELSE '' END
|| '<form action="/ara" method="GET"><input id="q' || page_id || '"><input type="hidden"><label for="q' || CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR(20)) ELSE 'none' END || '"></label><select></select></form>'
|| '<a href="/d/' || page_id || '.pdf?x=1">belge</a><iframe src="/e.docx"></iframe><p>Bilgi</p><table><tr><th>Ders Kodu :</th><td> K ' || page_id || '</td></tr><tr><td colspan="2">tek</td></tr><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table>'"""


def parsed(spark, d, *want):
    rows = table(spark, d, "pages").select("page_id", "url", F.concat("html", F.expr(EXTRA)).alias("html"))
    return G.parse_pages(rows, *want)


COUNT_H1 = "len(regexp_extract_all(html, '<h1[ >]'))"


@query("a4_page_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"')) + 2 AS n FROM pages")
def _(spark, d):
    return G.page_links(parsed(spark, d, "base", "links", "forms")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("c5_accessibility", f"SELECT page_id, 2 AS images_total, 1 AS images_without_alt, {COUNT_H1} + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS h1_count, {COUNT_H1} + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END = 0 AS missing_h1, {COUNT_H1} + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END > 1 AS multiple_h1, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS unlabeled_form_fields, true AS has_lang FROM pages")
def _(spark, d):
    return G.accessibility(parsed(spark, d, "images", "h1_count", "fields", "labels", "lang", "title")).drop("title")


@query("c6_forms", "SELECT page_id, '/ara' AS action, 'get' AS method, 3 AS n_fields FROM pages")
def _(spark, d):
    return G.forms(parsed(spark, d, "forms"))


@query("c7_responsive", "SELECT page_id, page_id % 4 = 0 AS has_viewport_meta, page_id % 4 = 0 AS has_media_queries FROM pages")
def _(spark, d):
    return G.responsive(parsed(spark, d, "metas", "has_media_query"))


@query("c16_document_refs", "SELECT page_id, '/d/' || page_id || '.pdf?x=1' AS url, 'dom' AS source, 'belge' AS text FROM pages UNION ALL SELECT page_id, '/e.docx', 'dom', '(gomulu icerik)' FROM pages")
def _(spark, d):
    return G.document_refs(parsed(spark, d, "links", "embeds"))


@query("g6_visible_text")
def _(spark, d):
    return G.visible_text(parsed(spark, d, "visible_text"))


MARKUP = """'<table><caption>Plan ' || page_id || '</caption><thead><tr><td colspan="3">Baş ' || page_id || '</td></tr><tr><td>a<td colspan="²">b</tr></thead><tr class="k' || page_id || '" onclick="ac(' || page_id || ')"><td colspan="99999999999"><a href="/s?n=1">x</a> y<td><a href="#">z</a></table>'
|| '<p>dış</p><table><tr><td><table><tr><td>iç ' || page_id || '</td></tr></table></td></tr></table>'"""


@query("k2_html_tables", """SELECT page_id, 0 AS idx, 'Plan ' || page_id AS label, 'Baş ' || page_id AS title, 'a:1:true,b:1:true;x y:1:false,z:1:false' AS cells, ';ac(' || page_id || ') /s?n=1' AS refs, ';k' || page_id AS classes FROM pages
    UNION ALL SELECT page_id, 1, 'dış', '', 'iç ' || page_id || ':1:false', '', '' FROM pages""")
def _(spark, d):
    t = G.html_tables(G.parse_pages(table(spark, d, "pages").select("page_id", "url", F.expr(MARKUP).alias("html")), "tables"))
    lines = lambda c, f, between: F.array_join(F.transform(c, f), between)
    cell = lambda c: F.concat_ws(":", c["text"], c["colspan"].cast("string"), c["header"].cast("string"))
    return t.select("page_id", "idx", "label", "title", lines("rows", lambda r: lines(r, cell, ","), ";").alias("cells"), lines("refs", lambda r: F.array_join(r, " "), ";").alias("refs"), F.array_join("classes", ";").alias("classes"))


@query("k3_table_kv", "SELECT page_id, 'Ders Kodu' AS key, 'K ' || page_id AS value FROM pages UNION ALL SELECT page_id, 'a', 'b' FROM pages UNION ALL SELECT page_id, 'c', 'd' FROM pages")
def _(spark, d):
    return G.table_kv(G.html_tables(parsed(spark, d, "tables"))).select("page_id", "key", "value")


@query("k4_table_headers", "SELECT page_id, 0 AS \"row\", 0 AS col, 'ders kodu :' AS header FROM pages UNION ALL SELECT page_id, 0, 1, 'k ' || page_id FROM pages")
def _(spark, d):
    return G.table_headers(G.html_tables(parsed(spark, d, "tables")), ["ders kodu"]).select("page_id", "row", "col", "header")


ITEMS = "'Bölüm 4. kısım: 1) Kodlar' || p_partkey || ' ve sınar. 3.1 sürüm 2. Ağ kurar 17) ek' || CASE WHEN p_partkey % 2 = 0 THEN ' 3) Sunar\nbaşka satır' ELSE '' END"


@query("k7_numbered_items", "SELECT p_partkey, 1 AS no, 'Kodlar' || p_partkey || ' ve sınar. 3.1 sürüm' AS description FROM part UNION ALL SELECT p_partkey, 2, 'Ağ kurar 17. ek' FROM part UNION ALL SELECT p_partkey, 3, 'Sunar' FROM part WHERE p_partkey % 2 = 0")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(ITEMS).alias("text"))
    return rows.select("p_partkey", F.posexplode(G.numbered_items(F.col("text"))).alias("k", "description")).select("p_partkey", (F.col("k") + 1).alias("no"), "description")


FIELDS = """'<form action="/kaydet"><input type="hidden" name="durum" value="' || page_id || '"><input name="ad"><input type="checkbox" name="onay" checked><input type="radio" name="r" value="1"><input type="submit" name="yolla" value="x"><input value="adsız">'
|| '<select name="yil"><option value="">-</option><option value="a' || page_id || '">A</option><option>B</option></select><select name="dil"><option value="tr">T<option selected> EN  dil </option></select><textarea name="not">satır ' || page_id || '</textarea></form>'"""


@query("c6_form_defaults", """SELECT page_id, 0 AS form, '/kaydet' AS action, k - 1 AS pos, (['durum', 'ad', 'onay', 'yil', 'dil', 'not'])[k] AS name,
    ([CAST(page_id AS VARCHAR), '', 'on', 'a' || page_id, 'EN dil', 'satır ' || page_id])[k] AS value FROM pages, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS k)""")
def _(spark, d):
    return G.form_defaults(G.parse_pages(table(spark, d, "pages").select("page_id", "url", F.expr(FIELDS).alias("html")), "forms"))
