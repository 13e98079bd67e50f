"""Queries of groups A and B on the driver's pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteq.functions import urls as U
from siteq.operators import site as S
from siteq.operators import tables as T
from siteq.sources import files
from siteq.sources.shared import shared_dir, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def status() -> F.Column:
    """The HTTP status that the bindings give a page."""
    return F.when(F.col("page_id") % 13 == 0, 404).when(F.col("page_id") % 17 == 0, 403).when(F.col("page_id") % 19 == 0, 500).otherwise(200)


STATUS = "CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 17 = 0 THEN 403 WHEN page_id % 19 = 0 THEN 500 ELSE 200 END"
RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(col: str, k: int) -> str:
    return f"regexp_extract({col}, '{RFC}', {k})"


def normal(col: str) -> str:
    """SQL for the normal form of an absolute URL whose parameters need no escapes."""
    kept = f"list_sort(list_filter(string_split({part(col, 4)}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')))"
    path = f"regexp_replace(CASE WHEN {part(col, 3)} = '' THEN '/' ELSE {part(col, 3)} END, '/{{2,}}', '/', 'g')"
    return f"({part(col, 1)} || '://' || lower({part(col, 2)}) || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


LINKS = r"""raw AS (SELECT page_id, url AS src, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*'), 1) - 1 AS pos FROM pages),
links AS (SELECT page_id, src, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)$', 1) AS text FROM raw),
abs_ AS (SELECT *, """ + part("src", 1) + " || '://' || lower(" + part("src", 2) + r""") || regexp_extract(href, '^[^?#]*') AS dst FROM links)"""  # hrefs of the driver's pages are rooted paths


def links(spark, d):
    """Links with the page they are on; a URL may be that of several pages."""
    return S.extract_links(table(spark, d, "pages"), carry=("page_id",)).withColumn("dst", U.normalize_url(F.col("href"), F.col("src")))


@query("a1_normalize_url", f"SELECT page_id, {normal('url')} AS url FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url"), F.col("url")).alias("url"))


@query("a1_resolve_links", f"WITH {LINKS} SELECT page_id, pos, dst FROM abs_")
def _(spark, d):
    return links(spark, d).select("page_id", F.col("pos"), "dst")


CLASS = f"CASE WHEN NOT (ends_with(lower({part('dst', 2)}), 'example.com')) THEN 'dis' WHEN ends_with(lower({part('dst', 3)}), '.pdf') THEN 'belge' WHEN ends_with(lower({part('dst', 3)}), '.js') THEN 'dosya' WHEN regexp_matches(dst, '/(the|in|of)$') THEN 'haric' ELSE 'sayfa' END"


def classified(spark, d):
    # every seventh link becomes a document and every eleventh an asset, on both engines
    dst = F.when(F.col("pos") % 7 == 3, F.concat("dst", F.lit(".PDF"))).when(F.col("pos") % 11 == 5, F.concat("dst", F.lit(".js"))).otherwise(F.col("dst"))
    rows = links(spark, d).withColumn("dst", dst)
    cls = U.classify_url(F.col("dst"), U.in_site(U.authority(F.col("dst")), ["example.com"], root="example.com"), exclude=["/(the|in|of)$"])
    return rows.withColumns({"cls": cls, "host": U.host(F.col("dst"))})


CLASSIFIED = LINKS + f", marked AS (SELECT page_id, src, pos, href, text, CASE WHEN pos % 7 = 3 THEN dst || '.PDF' WHEN pos % 11 = 5 THEN dst || '.js' ELSE dst END AS dst FROM abs_), cls AS (SELECT *, {CLASS} AS cls, lower({part('dst', 2)}) AS host FROM marked)"


@query("a2_classify_url", f"WITH {CLASSIFIED} SELECT cls, count(*) AS n FROM cls GROUP BY cls")
def _(spark, d):
    return T.distribution(classified(spark, d), "cls")


@query("a3_in_site", f"SELECT page_id, (lower({part('url', 2)}) IN ('ththed.example.org') OR ends_with(lower({part('url', 2)}), '.example.com')) AS inside FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.in_site(U.authority(F.col("url")), ["ththed.example.org"], root="example.com").alias("inside"))


@query("a4_extract_links", f"WITH {LINKS} SELECT src, pos, href, text FROM links")
def _(spark, d):
    return S.extract_links(table(spark, d, "pages"))


@query("a5_page_links", f"WITH {LINKS}, h AS (SELECT src, pos, dst AS href, text, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS rn FROM abs_) SELECT src, pos, href, substr(trim(text), 1, 90) AS text FROM h WHERE rn = 1 AND starts_with(href, 'http')")
def _(spark, d):
    return S.page_links(links(spark, d).select("src", "pos", F.col("dst").alias("href"), "text"))


@query("a6_cap_query_variants", f"WITH k AS (SELECT page_id, url, {part('url', 4)} <> '' AS has, row_number() OVER (PARTITION BY {part('url', 2)}, {part('url', 4)} <> '' ORDER BY page_id) AS rn FROM (SELECT page_id, regexp_replace(url, '/[^/?#]*/[^/?#]*', '/x') AS u, url FROM pages)) SELECT page_id FROM (SELECT page_id, rn, has FROM (SELECT page_id, {part('u', 4)} <> '' AS has, row_number() OVER (PARTITION BY {part('u', 2)}, {part('u', 3)}, {part('u', 4)} <> '' ORDER BY page_id) AS rn FROM (SELECT page_id, regexp_replace(url, '(//[^/]*)/[^?#]*', '\\1/x') AS u FROM pages))) WHERE NOT has OR rn <= 2")
def _(spark, d):
    # one path a host, so that variants come up
    urls = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "(//[^/]*)/[^?#]*", "$1/x").alias("url"))
    return S.cap_query_variants(urls, 2, ["page_id"]).select("page_id")


@query("a7_first_seen", f"WITH {LINKS}, o AS (SELECT dst, page_id, pos, row_number() OVER (PARTITION BY dst ORDER BY page_id, pos) AS rn FROM abs_) SELECT dst, page_id, pos FROM o WHERE rn = 1")
def _(spark, d):
    return S.first_seen(links(spark, d), "dst", F.struct("page_id", "pos"), ["page_id", "pos"])


def graph(spark, d):
    """Edges between (top domain, last path letter) nodes, so that paths of several steps exist."""
    rows = links(spark, d)
    node = lambda u: F.concat(F.lower(F.substring(F.regexp_replace(U.path(u), "[^A-Za-z0-9]", ""), 1, 2)), F.lit("/"), F.regexp_extract(U.authority(u), "([a-z]+)$", 1))
    return rows.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")).distinct()


NODE = "lower(substr(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'), 1, 2)) || '/' || regexp_extract({1}, '([a-z]+)$', 1)"
GRAPH = LINKS + f", g AS (SELECT DISTINCT {NODE.format(part('src', 3), part('src', 2))} AS src, {NODE.format(part('dst', 3), part('dst', 2))} AS dst FROM abs_)"


@query("a8_crawl_reach", f"WITH RECURSIVE {GRAPH}, r AS (SELECT DISTINCT src AS url, 0 AS depth FROM g WHERE starts_with(src, 'f') UNION SELECT g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.url WHERE r.depth < 5) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def _(spark, d):
    g = graph(spark, d)
    return S.crawl_reach(g, g.where(F.col("src").startswith("f")).select(F.col("src").alias("url")), 5).select("url", "depth")


TREE = "SELECT p_partkey + 1 AS k FROM part"


@query("a8_crawl_capped", f"SELECT 'n' || k AS url, CAST(floor(log2(k)) AS INTEGER) AS depth, CASE WHEN k > 1 THEN 'n' || k // 2 END AS source, k - 1 AS ord FROM ({TREE}), (SELECT count(*) AS n FROM part) WHERE k <= least(n * 3 // 4, 2047)")
def _(spark, d):
    """Numbers that link their double, the next one, their half and the first: a queue finds them in order. The cap falls inside a level."""
    part = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("k"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    to = F.array(F.expr("k div 2"), 2 * F.col("k"), 2 * F.col("k") + 1, F.lit(1).cast("long"))
    most = part.count()
    links = part.select("k", F.posexplode(to).alias("pos", "to")).where(f"to BETWEEN 1 AND {most}").select(name(F.col("k")).alias("src"), name(F.col("to")).alias("dst"), "pos")
    return S.crawl_reach(links, spark.sql("SELECT 'n1' AS url"), 10, most * 3 // 4)


@query("a9_document_links", f"WITH {CLASSIFIED}, o AS (SELECT dst AS url, src, row_number() OVER (PARTITION BY dst ORDER BY src, pos) AS rn FROM cls WHERE cls = 'belge') SELECT url, src FROM o WHERE rn = 1")
def _(spark, d):
    return S.document_links(classified(spark, d).withColumn("url", F.col("dst")))


@query("a10_external_domains", f"WITH {CLASSIFIED} SELECT host, count(*) AS n_links FROM cls WHERE cls = 'dis' GROUP BY host ORDER BY n_links DESC, host LIMIT 30")
def _(spark, d):
    return S.external_domains(classified(spark, d))


@query("a11_crawl_stats", f"WITH {CLASSIFIED}, s AS (SELECT {STATUS} AS status FROM pages) SELECT count(*) AS n_pages, count(*) FILTER (WHERE status < 400) AS n_listed, true AS completed, (SELECT count(DISTINCT dst) FROM cls WHERE cls = 'belge') AS n_documents, (SELECT count(*) FROM s WHERE status >= 500) AS n_errors FROM s")
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("status", status())
    return S.crawl_stats(pages, classified(spark, d).where("cls = 'belge'").select("dst").distinct(), pages.where("status >= 500"))


@query("a11_status_counts", f"SELECT status, count(*) AS n FROM (SELECT {STATUS} AS status FROM pages) GROUP BY status")
def _(spark, d):
    return T.distribution(table(spark, d, "pages").withColumn("status", status()), "status")


@query("a12_site_map_urls", f"SELECT url FROM pages WHERE {STATUS} < 400")
def _(spark, d):
    return S.site_map_urls(table(spark, d, "pages").withColumn("status", status()))


@query("a13_tail_errors", f"SELECT page_id, url FROM pages WHERE {STATUS} >= 400 ORDER BY page_id DESC LIMIT 20")
def _(spark, d):
    return S.tail_errors(table(spark, d, "pages").where(status() >= 400).select("page_id", "url"), 20, "page_id")


XML = "'<urlset><url><loc> ' || url || ' </loc></url><sitemap><loc>https://x.example.com/sitemap-' || page_id || '.php</loc></sitemap></urlset>'"


def sitemaps(spark, d):
    return table(spark, d, "pages").select(F.expr(XML).alias("xml"))


@query("a14_sitemap_pages", "SELECT DISTINCT url, 1 AS depth, 'sitemap' AS source FROM pages")
def _(spark, d):
    return S.sitemap_urls(sitemaps(spark, d))[0]


@query("a14_sitemap_nested", "SELECT DISTINCT 'https://x.example.com/sitemap-' || page_id || '.php' AS url FROM pages")
def _(spark, d):
    return S.sitemap_urls(sitemaps(spark, d))[1]


NESTED = "'https://x.example.com/maps/sitemap-' || {0} || '.xml'"
MAPS = f"""'<urlset><url><loc>https://x.example.com/p/' || page_id || '?utm_source=z&b=' || page_id || '#f</loc></url><url><loc>/rel/' || page_id || '</loc><loc>https://x.example.com/d.pdf</loc><loc>https://elsewhere.example.org/p</loc></url><sitemap><loc> ' || {NESTED.format("(2 * page_id + 1)")} || '</loc></sitemap><sitemap><loc>' || {NESTED.format("(2 * page_id + 2)")} || '</loc><loc>' || {NESTED.format("0")} || '</loc></sitemap></urlset>'"""


def expanded(spark, d):
    """Maps that each list two more, and the first again; of the last ones some are not stored."""
    maps = table(spark, d, "pages").select(F.expr(NESTED.format("page_id")).alias("url"), F.expr(MAPS).alias("xml"))
    starts = spark.sql(f"SELECT {NESTED.format('0')} AS url, 0 AS pos UNION ALL SELECT {NESTED.format('0')}, 1")
    return S.expand_sitemaps(maps, starts, ["x.example.com"])


@query("a14_expanded_pages", "SELECT unnest(['https://x.example.com/p/' || page_id || '?b=' || page_id, 'https://x.example.com/rel/' || page_id]) AS url, 1 AS depth, 'sitemap' AS source FROM pages WHERE page_id < 200")
def _(spark, d):
    return expanded(spark, d)[0]


@query("a14_read_maps", f"SELECT {NESTED.format('k')} AS url, CAST(floor(log2(k + 1)) AS INTEGER) AS depth, k AS ord FROM (SELECT unnest(range(200)) AS k), (SELECT count(*) AS n FROM pages) WHERE k <= 2 * n")
def _(spark, d):
    return expanded(spark, d)[1].select("url", "depth", "ord")


@query("a15_robots_filter", f"SELECT page_id FROM pages WHERE NOT (starts_with({part('url', 3)}, '/en/1') OR (starts_with({part('url', 3)}, '/de') AND NOT starts_with({part('url', 3)}, '/de/2')))")
def _(spark, d):
    rules = spark.createDataFrame([(1, "/en/1", False), (2, "/de/2", True), (3, "/de", False)], "rule_no int, prefix string, allow boolean")
    return S.robots_filter(table(spark, d, "pages").select("page_id", "url"), rules).select("page_id")


HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query("a15_robots_by_host", f"SELECT page_id FROM pages WHERE NOT (starts_with({part('url', 3)}, '/en') AND length({HOST}) % 2 = 0)")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(U.host(F.col("url")).alias("host")).distinct().where(F.length("host") % 2 == 0)
    rules = hosts.select("host", F.inline(F.array(F.struct(F.lit(2).alias("rule_no"), F.lit("/e").alias("prefix"), F.lit(True).alias("allow")), F.struct(F.lit(1).alias("rule_no"), F.lit("/en").alias("prefix"), F.lit(False).alias("allow")))))
    return S.robots_filter(pages, rules).select("page_id")


ROBOTS = {
    0: "# ours\nUser-agent: other\nDisallow: /\n\nUser-Agent: SiteQ\nuser-agent:second\nAllow: /en/1\nDisallow: /en # all else\nCrawl-delay: 2\nDisallow: /d%65/2\n\nDisallow: /\nUser-agent: *\nDisallow: /fr\n",
    1: "User-agent: nobody\n\nUser-agent: *\r\nDisallow: /fr\nDisallow:\nDisallow: /en",
}


@query("a15_robots_text", f"SELECT page_id FROM pages WHERE NOT (length({HOST}) % 2 = 0 AND (starts_with({part('url', 3)}, '/en') AND NOT starts_with({part('url', 3)}, '/en/1') OR starts_with({part('url', 3)}, '/de/2')) OR length({HOST}) % 2 = 1 AND starts_with({part('url', 3)}, '/fr'))")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(U.host(F.col("url")).alias("host")).distinct()
    robots = hosts.withColumn("body", F.when(F.length("host") % 2 == 0, ROBOTS[0]).otherwise(ROBOTS[1]))
    return S.robots_filter(pages, S.robots_rules(robots, "siteq-bot/2.1")).select("page_id")


LAYOUTS = "CASE g % 5 WHEN 0 THEN to_json(named_struct('url_list', u)) WHEN 1 THEN to_json(named_struct('pages', map_from_arrays(u, transform(u, x -> 1)))) WHEN 2 THEN to_json(named_struct('urls', u)) WHEN 3 THEN to_json(u) ELSE to_json(transform(u, x -> named_struct('url', x))) END"


@query("b1_url_list", "SELECT url || '#' || page_id AS url FROM pages")
def _(spark, d):
    """Lists of ten URLs in five layouts."""
    rows = table(spark, d, "pages").select(F.expr("page_id div 10").alias("g"), F.concat("url", F.lit("#"), "page_id").alias("url"))
    texts = rows.groupBy("g").agg(F.collect_list("url").alias("u")).select(F.expr(LAYOUTS).alias("value"))
    return files.url_list(texts).select("url")


@query("m8_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"; y' AS name FROM customer")
def _(spark, d):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("\ufeffc_custkey"), F.concat("c_name", F.lit(', "x"; y')).alias("name"))
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return files.read_csv_auto(spark, path).select("c_custkey", F.col("name"))


@query("k19_decode_pages", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<meta charset=\"iso-8859-1\">' ELSE '' END || 'ñé ' || url AS text FROM pages")
def _(spark, d):
    """Bytes of a declared charset, and of UTF-8 without a declaration."""
    declared = F.col("page_id") % 3 == 0
    said = F.concat(F.when(declared, '<meta charset="iso-8859-1">').otherwise(""), F.lit("ñé "), "url")
    rows = table(spark, d, "pages").select("page_id", F.when(declared, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8")).alias("content"))
    return files.decode_pages(rows).select("page_id", "text")


@query("a16_pending", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return T.pending(pages, pages.where("page_id % 3 = 0"), ["page_id"])


@query("b2_clean_urls", f"WITH {LINKS} SELECT dst AS url, min(page_id * 1000 + pos) AS pos FROM abs_ WHERE regexp_full_match(dst, 'http[\\x21-\\x7eçÇğĞıİöÖşŞüÜ]*') GROUP BY dst")
def _(spark, d):
    rows = links(spark, d).select(F.col("dst").alias("url"), (F.col("page_id") * 1000 + F.col("pos")).alias("at"))
    return S.clean_urls(rows, F.col("at"))


@query("b3_slice_rows", "SELECT page_id FROM pages ORDER BY page_id LIMIT 20 OFFSET 10")
def _(spark, d):
    return S.slice_rows(table(spark, d, "pages").select("page_id"), ["page_id"], 10, 20)


SEGS = f"list_filter(string_split({part('url', 3)}, '/'), lambda s: s <> '')"
LANGS = "('en', 'tr', 'de', 'fr', 'ar', 'ru', 'az', 'fa')"
FOLD = "CASE WHEN regexp_matches({0}, '[0-9]') OR regexp_full_match({0}, '[0-9a-f]{{8,}}') THEN '*' ELSE {0} END"
LEAF = f"""seg AS (SELECT src_id, url, segs, CASE WHEN len(segs) > 0 AND lower(segs[1]) IN {LANGS} THEN lower(segs[1]) ELSE '' END AS lang FROM (SELECT src_id, url, {SEGS} AS segs FROM u)),
rest AS (SELECT src_id, url, lang, CASE WHEN lang <> '' THEN segs[2:] ELSE segs END AS s FROM seg),
leaf AS (SELECT src_id, url, lang, len(s) AS depth, CASE WHEN len(s) = 0 THEN '' ELSE {FOLD.format('lower(s[1])')} END AS first, CASE WHEN len(s) = 0 THEN '' ELSE {FOLD.format('lower(s[len(s)])')} END AS last FROM rest)"""
URLS = f"WITH {LINKS}, u AS (SELECT page_id * 1000 + pos AS src_id, dst AS url FROM abs_ UNION ALL SELECT -1 - page_id, url FROM pages), {LEAF}"


def all_urls(spark, d):
    pages = table(spark, d, "pages")
    rows = links(spark, d).select((F.col("page_id") * 1000 + F.col("pos")).alias("src_id"), F.col("dst").alias("url"))
    return rows.union(pages.select(-1 - F.col("page_id"), "url"))


@query("b4_leaf_of", f"{URLS} SELECT src_id, first, last, depth FROM leaf")
def _(spark, d):
    return all_urls(spark, d).select("src_id", U.leaf_of(F.col("url")).alias("l")).select("src_id", "l.first", "l.last", "l.depth")


@query("b5_leaf_vocab", f"{URLS} SELECT last AS leaf, count(*) AS n FROM leaf WHERE last NOT IN ('', '*') GROUP BY last HAVING count(*) >= 5")
def _(spark, d):
    return S.leaf_vocab(all_urls(spark, d))


KEYS = f"CASE WHEN {part('url', 4)} <> '' THEN '?' || substr(regexp_replace(lower(regexp_replace({part('url', 4)}, '=[^&]*', '', 'g')), '[^a-z0-9&]+', '', 'g'), 1, 30) ELSE '' END"
SIG = f"""{URLS}, vocab AS (SELECT last AS leaf FROM leaf WHERE last NOT IN ('', '*') GROUP BY last HAVING count(*) >= 5),
sig AS (SELECT src_id, url, CASE WHEN depth = 0 THEN lang || '|ROOT' ELSE lang || '|' || first || '|' || CASE WHEN last = '*' OR leaf IS NOT NULL THEN last ELSE '*' END || {KEYS} END AS sig FROM leaf LEFT JOIN vocab ON leaf = last)"""


def signed(spark, d):
    urls = all_urls(spark, d)
    return S.template_signature(urls, S.leaf_vocab(urls))


@query("b6_template_signature", f"{SIG} SELECT src_id, sig FROM sig")
def _(spark, d):
    return signed(spark, d).select("src_id", "sig")


@query("b7_template_clusters", f"{SIG} SELECT sig, count(*) AS n_pages, min(url) AS example FROM sig GROUP BY sig")
def _(spark, d):
    return S.template_clusters(signed(spark, d))


@query("b8_representatives", f"{SIG}, d AS (SELECT DISTINCT sig, url FROM sig), o AS (SELECT sig, url, row_number() OVER (PARTITION BY sig ORDER BY url) - 1 AS i, count(*) OVER (PARTITION BY sig) AS n FROM d) SELECT sig, url FROM o WHERE i IN (0, n // 2, n - 1)")
def _(spark, d):
    return S.representatives(signed(spark, d).select("sig", "url").distinct())


@query("b9_with_affected", f"{SIG}, c AS (SELECT sig, count(*) AS n FROM sig WHERE src_id < 0 GROUP BY sig) SELECT src_id, coalesce(n, 1) AS affected FROM sig LEFT JOIN c USING (sig) WHERE src_id >= 0")
def _(spark, d):
    rows = signed(spark, d)
    return S.with_affected(rows.where("src_id >= 0"), S.template_clusters(rows.where("src_id < 0"))).select("src_id", "affected")


@query("b10_template_rollup", f"{SIG}, p AS (SELECT sig, url, -1 - src_id AS id FROM sig WHERE src_id < 0), c AS (SELECT sig, count(*) AS affected FROM p GROUP BY sig), f AS (SELECT p.sig, url, affected, id % 5 AS n, CASE WHEN id % 2 = 0 THEN ['overlap'] ELSE ['broken', 'overflow'] END AS types FROM p JOIN c USING (sig) WHERE id % 5 > 0), t AS (SELECT sig, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS types FROM f GROUP BY sig) SELECT f.sig, count(*) AS reps_hit, max(affected) AS affected, any_value(t.types) AS types, arg_min(url, (-n, url)) AS example FROM f JOIN t ON t.sig = f.sig GROUP BY f.sig")
def _(spark, d):
    rows = signed(spark, d).where("src_id < 0").withColumn("id", -1 - F.col("src_id"))
    found = rows.withColumns({"defect_count": F.col("id") % 5, "types": F.when(F.col("id") % 2 == 0, F.array(F.lit("overlap"))).otherwise(F.array(F.lit("broken"), F.lit("overflow")))})
    return S.template_rollup(S.with_affected(found, S.template_clusters(rows)))


SLUG = f"regexp_replace(regexp_replace({part('url', 3)}, '^/+|/+$', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g') || CASE WHEN {part('url', 4)} <> '' THEN '_' || regexp_replace({part('url', 4)}, '[^a-zA-Z0-9]+', '-', 'g') ELSE '' END"
NAME = f"substr(CASE WHEN regexp_replace({SLUG}, '^-+|-+$', '', 'g') = '' THEN 'anasayfa' ELSE regexp_replace({SLUG}, '^-+|-+$', '', 'g') END, 1, 110) || '-' || substr(md5(url), 1, 8)"


@query("b11_safe_name", f"SELECT page_id, {NAME} AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.safe_name(F.col("url")).alias("name"))


@query("b12_resolve_slugs", f"SELECT {NAME} AS slug, url FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    pages = table(spark, d, "pages")
    slugs = pages.select(F.when(F.col("page_id") % 2 == 0, U.safe_name(F.col("url"))).otherwise(F.concat(F.lit("x"), "page_id")).alias("slug"))
    return S.resolve_slugs(slugs, pages)[0]


@query("b12_missing_slugs", "SELECT 'x' || page_id AS slug FROM pages WHERE page_id % 2 = 1")
def _(spark, d):
    pages = table(spark, d, "pages")
    slugs = pages.select(F.when(F.col("page_id") % 2 == 0, U.safe_name(F.col("url"))).otherwise(F.concat(F.lit("x"), "page_id")).alias("slug"))
    return S.resolve_slugs(slugs, pages)[1]


@query("b13_round_robin_sample", f"WITH g AS (SELECT page_id, array_to_string(({SEGS})[1:2], '/') AS grp FROM (SELECT page_id, regexp_replace(url, '/([0-9])[^/?#]*', '/\\1') AS url FROM pages)), r AS (SELECT page_id, grp, row_number() OVER (PARTITION BY grp ORDER BY page_id) AS rn, min(page_id) OVER (PARTITION BY grp) AS first_pos FROM g) SELECT page_id, grp, rn FROM r ORDER BY rn, first_pos LIMIT 40")
def _(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "/([0-9])[^/?#]*", "/$1").alias("url"), F.col("page_id").alias("pos"))
    return S.round_robin_sample(urls, 40).select("page_id", "grp", "rn")


@query("d2_parent_url", f"SELECT page_id, {part('url', 1)} || '://' || {part('url', 2)} || regexp_replace(regexp_replace({part('url', 3)}, '/+$', ''), '/[^/]*$', '') AS parent FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.parent_url(F.col("url")).alias("parent"))
