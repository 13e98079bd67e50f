"""URL tables and the relations of a crawl: links, classes, reachability, statistics (A), URL lists and templates (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.functions import urls as U
from siteq.operators.tables import first_by
from siteq.sources.shared import kept


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(src, pos, href, text) of the anchors of each page, and the columns to carry, by the built-in path: quoted href and the text up to </a>."""
    anchors = F.regexp_extract_all(html, F.lit(r'(<a href="[^"]*"[^>]*>[^<]*)'), F.lit(1))
    rows = pages.select(*carry, F.col(url).alias("src"), F.posexplode(anchors).alias("pos", "_a"))
    return rows.select(*carry, "src", "pos", F.regexp_extract("_a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("_a", ">([^<]*)$", 1).alias("text"))


def page_links(links: DataFrame, most: int = 90) -> DataFrame:
    """Links of each page that start with http, once each with the first text, cut at `most` characters."""
    kept = links.where(F.col("href").startswith("http"))
    return first_by(kept, ["src", "href"], ["pos"]).withColumn("text", F.substring(F.trim("text"), 1, most))


def cap_query_variants(urls: DataFrame, n: int, order: list, url: str = "url") -> DataFrame:
    """At most n URLs with a query for each host and path, in order; n = 0 sets no limit."""
    if not n:
        return urls
    has = U.query(F.col(url)) != ""
    rows = urls.withColumns({"_has": has, "_h": U.authority(F.col(url)), "_p": U.path(F.col(url))})
    w = Window.partitionBy("_h", "_p", "_has").orderBy(*order)
    return rows.withColumn("_n", F.when(F.col("_has"), F.row_number().over(w)).otherwise(0)).where(F.col("_n") <= n).drop("_has", "_h", "_p", "_n")


def first_seen(df: DataFrame, key: str, order: Column, keep: list[str]) -> DataFrame:
    """Each key with the columns of its first row; a grouped minimum."""
    return df.groupBy(key).agg(F.min_by(F.struct(*keep), order).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in keep))


def _numbered(rows: DataFrame, order: list[str], base: int) -> DataFrame:
    """rows with ord: their place in the given order, counted on from base, written to the shared folder.

    Ranges of the order go to tasks, rows are counted within each, and the tasks' counts, a number for each, are added up; no task sorts all rows.
    """
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    parts = kept(parts)
    starts, at = [], base
    for r in parts.groupBy("_part").agg(F.max("_k").alias("k")).orderBy("_part").collect():
        starts.append((r["_part"], at))
        at += r["k"] + 1
    starts = spark.createDataFrame(starts, "_part int, _at long")  # a row for each task
    return parts.join(F.broadcast(starts), "_part").withColumn("ord", F.col("_at") + F.col("_k")).select(*rows.columns, "ord")


def crawl_reach(links: DataFrame, seeds: DataFrame, max_depth: int = 10, max_pages: int | None = None) -> DataFrame:
    """(url, depth, source, ord): breadth-first reachability over links (src, dst, and pos, their order on the page) from seeds (url, and pos), up to max_pages.

    A URL's source is the page that a queue would have found it on: the first in order, and there the first link; ord is its place in the queue. Without pos, links
    and seeds go by URL. A level is one join of the frontier with the links and one anti join with what is known. Levels are written to the shared folder, so
    lineage stays short and lost executors cost nothing; a cap that falls inside a level cuts it in the order of the queue.
    """
    pos = lambda df: F.col("pos") if "pos" in df.columns else F.lit(0)
    links = links.where("dst IS NOT NULL").select("src", "dst", pos(links).cast("long").alias("_pos"))
    first = seeds.where("url IS NOT NULL").groupBy("url").agg(F.min(pos(seeds)).cast("long").alias("_pos")).select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("source"), F.lit(-1).cast("long").alias("_from"), "_pos")
    level, known, n = first, None, 0
    for depth in range(max_depth + 1):
        frontier = _numbered(level, ["_from", "_pos", "url"], n)
        frontier = kept(frontier.where(F.col("ord") < max_pages) if max_pages is not None else frontier).select("url", "depth", "source", "ord")
        if frontier.isEmpty():
            break
        known = frontier if known is None else known.unionByName(frontier)
        n = frontier.agg(F.max("ord")).first()[0] + 1
        if depth == max_depth or (max_pages is not None and n >= max_pages):
            break
        found = frontier.join(links, F.col("url") == F.col("src")).groupBy("dst").agg(F.min(F.struct("ord", "_pos", "src")).alias("x"))
        level = found.select(F.col("dst").alias("url"), F.lit(depth + 1).alias("depth"), F.col("x.src").alias("source"), F.col("x.ord").alias("_from"), F.col("x._pos").alias("_pos"))
        level = level.join(known.select("url"), "url", "left_anti")
    return known if known is not None else kept(first.select("url", "depth", "source", F.col("_pos").alias("ord")))


def document_links(classified: DataFrame) -> DataFrame:
    """Documents with the first page, by order of discovery, that links them. Takes url, cls, src, pos."""
    return first_seen(classified.where("cls = 'belge'"), "url", F.struct("src", "pos"), ["src"])


def external_domains(classified: DataFrame, n: int = 30) -> DataFrame:
    """The n outside hosts with the most links."""
    return classified.where("cls = 'dis'").groupBy("host").agg(F.count("*").alias("n_links")).orderBy(F.desc("n_links"), "host").limit(n)


def crawl_stats(pages: DataFrame, n_documents: DataFrame, n_errors: DataFrame) -> DataFrame:
    """One row: pages, listed pages (status below 400), documents, errors and completeness (no page without a status)."""
    head = pages.agg(F.count("*").alias("n_pages"), F.count_if(F.coalesce("status", F.lit(0)) < 400).alias("n_listed"), (F.count_if(F.col("status").isNull()) == 0).alias("completed"))
    return head.crossJoin(n_documents.agg(F.count("*").alias("n_documents"))).crossJoin(n_errors.agg(F.count("*").alias("n_errors")))  # three rows of one


def site_map_urls(pages: DataFrame, only_ok: bool = True) -> DataFrame:
    return (pages.where(F.coalesce("status", F.lit(0)) < 400) if only_ok else pages).select("url")


def tail_errors(errors: DataFrame, n: int = 2000, order: str = "seq") -> DataFrame:
    """The last n errors; the sort keeps n rows a task."""
    return errors.orderBy(F.desc(order)).limit(n)


def sitemap_urls(xml: DataFrame, col: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(pages, nested): the <loc> values of sitemap texts; nested ones end in .xml or name a sitemap in their last segment."""
    loc = xml.select(F.explode(F.regexp_extract_all(col, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    last = F.lower(F.element_at(F.split(U.path(F.col("url")), "/"), -1))
    nested = F.lower(F.col("url")).endswith(".xml") | last.contains("sitemap")
    return loc.where(~nested).select("url", F.lit(1).alias("depth"), F.lit("sitemap").alias("source")).distinct(), loc.where(nested).distinct()


def expand_sitemaps(maps: DataFrame, starts: DataFrame, hosts: list[str], exclude: list[str] | None = None, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(pages, read): what stored sitemaps (url, xml) list, from the starts (url, pos) on, following nested ones (A14).

    read: url, depth and ord of the maps that were gone through, `most` at most, in the order in which they come up; each once, whatever cycles they make, and those
    that are not stored count as well. pages: url, depth 1 and source sitemap, the pages of the site among their other addresses, normalised against the map, once each.
    """
    locs = maps.select(F.col("url").alias("src"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("pos", "dst"))
    last = F.element_at(F.split(F.lower("dst"), "/"), -1)
    locs = kept(locs.withColumn("nested", F.lower("dst").endswith(".xml") | last.contains("sitemap")))
    read = crawl_reach(locs.where("nested"), starts, most, most)
    pages = locs.where("NOT nested").join(read.select(F.col("url").alias("src")), "src").select(U.normalize_url(F.col("dst"), F.col("src")).alias("url")).distinct()
    pages = pages.where(U.classify_url(F.col("url"), U.in_site(U.authority(F.col("url")), hosts), exclude=exclude or []) == "sayfa")
    return pages.select("url", F.lit(1).alias("depth"), F.lit("sitemap").alias("source")), read


def _unquoted(text: Column) -> Column:
    """text with its percent codes read, or as it is if some are wrong."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, rule_no, prefix, allow) of the groups of robots.txt bodies (host, body) that are for the agent (A15), for `robots_filter`.

    A group is one or more user-agent lines and what follows up to a blank line or the next user-agent line after a rule; of these the first counts
    whose name is part of the agent's, up to a slash and without case, else the first for all. Rules outside of groups are left out, as are comments and other fields.
    A disallow line without a path allows all; an asterisk in a path is one like any letter. A host's lines are one window.
    """
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("k", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    pair = F.split(bare, ":", 2)
    lines = lines.select("host", "k", (F.trim("raw") == "").alias("_blank"), F.lower(F.trim(F.get(pair, F.lit(0)))).alias("field"), F.trim(F.get(pair, F.lit(1))).alias("value"))
    kind = F.when(F.col("_blank"), "end").when(F.col("value").isNull(), None).when(F.col("field") == "user-agent", "agent").when(F.col("field").isin("allow", "disallow"), "rule").when(F.col("field").isin("crawl-delay", "request-rate"), "other")
    rows = lines.withColumn("kind", kind).where("kind IS NOT NULL")
    w = Window.partitionBy("host").orderBy("k")  # a file's lines
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.max(F.when(c, F.col("k"))).over(before)
    # rules count from an agent line on, up to the next blank line
    rows = rows.withColumn("_agent", last(F.col("kind") == "agent")).withColumn("_end", last(F.col("kind") == "end"))
    rows = rows.where((F.col("kind").isin("agent", "end")) | (F.col("_agent") > F.coalesce("_end", F.lit(-1))))
    rows = rows.withColumn("_new", ((F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(w), F.lit("end")) != "agent")).cast("int"))
    rows = rows.withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.lower(F.when(F.col("kind") == "agent", F.col("value")))
    groups = rows.groupBy("host", "grp").agg(F.bool_or(F.col("kind").isin("rule", "other")).alias("some"), F.bool_or(name == "*").alias("_all"), F.bool_or(F.lit(agent.split("/")[0].lower()).contains(name)).alias("mine"))
    rank = F.struct(F.col("_all").cast("int"), "grp")
    chosen = groups.where("some AND (_all OR mine)").groupBy("host").agg(F.min_by("grp", rank).alias("grp"))
    allow = (F.col("field") == "allow") | (F.col("value") == "")
    return rows.where("kind = 'rule'").join(chosen, ["host", "grp"]).select("host", F.col("k").alias("rule_no"), F.col("value").alias("prefix"), allow.alias("allow"))


def robots_filter(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """URLs that the rules (rule_no, prefix, allow; of a host with a column host, else of all) let through: the first rule whose prefix starts the path and query decides; none allows.

    Percent codes are read on both sides. A host's rules, a few lines, come to each of its URLs as one array, so repeated rows stay and no URL meets another host's rules.
    """
    rest = F.regexp_replace(F.col(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = _unquoted(F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    packed = F.array_sort(F.collect_list(F.struct("rule_no", _unquoted(F.col("prefix")).alias("prefix"), "allow"))).alias("_rules")
    if "host" in rules.columns:
        hit = urls.withColumn("_host", U.host(F.col(url))).join(rules.groupBy(F.col("host").alias("_host")).agg(packed), "_host", "left")
    else:
        hit = urls.join(F.broadcast(rules.agg(packed)))  # one row
    decides = F.get(F.filter("_rules", lambda r: F.col("_path").startswith(r["prefix"])), F.lit(0))
    return hit.withColumn("_path", path).where(F.coalesce(decides["allow"], F.lit(True))).select(*urls.columns)


def clean_urls(df: DataFrame, order: Column, url: str = "url") -> DataFrame:
    """Well-formed URLs once each, in their first order."""
    return df.where(U.clean_url(F.col(url))).groupBy(url).agg(F.min(order).alias("pos"))


def slice_rows(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def leaf_vocab(urls: DataFrame, leaf_min: int = 5, url: str = "url") -> DataFrame:
    """Last segments that come up leaf_min times or more."""
    return urls.select(U.leaf_of(F.col(url))["last"].alias("leaf")).where("leaf NOT IN ('', '*')").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= leaf_min)


def template_signature(urls: DataFrame, vocab: DataFrame, url: str = "url") -> DataFrame:
    """Adds sig: language|first|last and the query's keys; rare last segments become *."""
    leaf = U.leaf_of(F.col(url))
    rows = urls.withColumn("_leaf", leaf).withColumn("leaf", F.col("_leaf.last")).join(vocab.select("leaf", F.lit(True).alias("_known")), "leaf", "left")
    last = F.when((F.col("leaf") == "*") | F.col("_known"), F.col("leaf")).otherwise(F.lit("*"))
    lang = U.language(F.col(url))
    sig = F.when(F.col("_leaf.depth") == 0, F.concat(lang, F.lit("|ROOT"))).otherwise(F.concat(lang, F.lit("|"), F.col("_leaf.first"), F.lit("|"), last, U.query_keys(F.col(url))))
    return rows.withColumn("sig", sig).drop("_leaf", "leaf", "_known")


def template_clusters(signed: DataFrame, url: str = "url") -> DataFrame:
    return signed.groupBy("sig").agg(F.count("*").alias("n_pages"), F.min(url).alias("example"))


def representatives(signed: DataFrame, reps: int = 3, url: str = "url") -> DataFrame:
    """First, middle and last URL of each template, as many as reps."""
    w = Window.partitionBy("sig").orderBy(url)
    rows = signed.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("sig"))})
    picks = F.slice(F.array_sort(F.array_distinct(F.array(F.lit(0), (F.floor(F.col("_n") / 2)).cast("int"), (F.col("_n") - 1).cast("int")))), 1, reps)
    one = F.array(F.lit(0))
    return rows.where(F.array_contains(F.when(F.lit(reps) == 1, one).otherwise(picks), F.col("_i"))).select("sig", url).distinct()


def with_affected(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Findings (with sig) and how many pages their template has, 1 if it is unknown."""
    return findings.join(clusters.select("sig", "n_pages"), "sig", "left").withColumn("affected", F.coalesce("n_pages", F.lit(1))).drop("n_pages")


def template_rollup(pages: DataFrame) -> DataFrame:
    """Per template: representatives hit, affected pages, types and the page with the most defects. Takes sig, url, affected, types, defect_count."""
    return pages.where("defect_count > 0").groupBy("sig").agg(
        F.count("*").alias("reps_hit"), F.max("affected").alias("affected"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ",").alias("types"),
        F.min_by("url", F.struct(-F.col("defect_count"), F.col("url"))).alias("example"),
    )


def resolve_slugs(slugs: DataFrame, urls: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(matched, missing): slugs joined to the URL with that safe name, the smallest first."""
    named = urls.select(U.safe_name(F.col(url)).alias("slug"), F.col(url).alias("url")).groupBy("slug").agg(F.min("url").alias("url"))
    return slugs.join(named, "slug"), slugs.join(named, "slug", "left_anti")


def round_robin_sample(urls: DataFrame, n: int, order: str = "pos", url: str = "url") -> DataFrame:
    """The first of each group (first two path segments), then the second, up to n; groups in order of their first URL."""
    group = F.array_join(F.slice(U.segments(F.col(url)), 1, 2), "/")
    rows = urls.withColumn("grp", group)
    w = Window.partitionBy("grp").orderBy(order)
    rows = rows.withColumns({"rn": F.row_number().over(w), "first_pos": F.min(order).over(Window.partitionBy("grp"))})
    return rows.orderBy("rn", "first_pos").limit(n)
