"""Screenshot measurements: hashes, flags, groups, representatives (E)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.operators.tables import first_by
from siteq.sources.shared import kept

# Name pattern, detail pages, thresholds of the flags, least sizes.
NAME = r"^(.*)-([0-9a-f]{8})__([A-Za-z0-9]+)$"
DETAIL = r"-n-\d+$"
BLANK, SHORT, LONG = 4.0, 0.3, 5.0


def dhash(values: Column, width: int = 9, height: int = 8) -> Column:
    """Hash of a grid of width x height grey values, by row: a bit for each value but a row's last, set where it is larger than the next, the first highest.

    Of 64 bits it is a long, of more an array of longs, the highest first.
    """
    words = []
    pairs = [r * width + c for r in range(height) for c in range(width - 1)]
    for at in range(0, len(pairs), 64):
        bits = [F.when(F.get(values, F.lit(i)) > F.get(values, F.lit(i + 1)), F.lit(1)).otherwise(F.lit(0)).cast("long") for i in pairs[at : at + 64]]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(b, len(bits) - 1 - k) for k, b in enumerate(bits))))
    return words[0] if len(words) == 1 else F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def parse_shot_name(name: Column) -> Column:
    """(page, slug, device) of slug-hash8__device.png, or of what there is."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    full = stem.rlike(NAME)
    page = F.regexp_extract(stem, r"^(.*)__", 1)
    return F.struct(
        F.when(page != "", page).otherwise(stem).alias("page"),
        F.when(full, F.regexp_extract(stem, NAME, 1)).when(page != "", page).otherwise(stem).alias("slug"),
        F.when(full, F.regexp_extract(stem, NAME, 3)).when(stem.contains("__"), F.regexp_extract(stem, "__([^_]*)$", 1)).otherwise("?").alias("device"),
    )


def truncated_names(df: DataFrame, slug: str = "slug") -> DataFrame:
    """Adds truncated: within one of the longest slug, if that is over 60."""
    longest = df.agg(F.max(F.length(slug)).alias("_m"))
    return df.crossJoin(longest).withColumn("truncated", (F.length(slug) >= F.col("_m") - 1) & (F.col("_m") > 60)).drop("_m")  # one row


def page_type_vocab(df: DataFrame, n: int = 10) -> DataFrame:
    """Last words of slugs that come up n times, without truncated and detail pages."""
    rows = df.where(~F.col("truncated") & ~F.col("slug").rlike(DETAIL))
    return rows.groupBy(F.element_at(F.split("slug", "-"), -1).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def shot_template(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds template from the slug; null where the name is truncated."""
    t = F.split("slug", "-")
    first, section, n = F.get(t, F.lit(0)), F.coalesce(F.get(t, F.lit(1)), F.lit("")), F.size(t)
    rows = df.withColumn("word", F.element_at(t, -1)).join(vocab.select("word", F.lit(True).alias("_known")), "word", "left")
    last = F.when(F.col("_known"), F.col("word")).otherwise("[diger]")
    head = F.concat(first, F.lit("/"), section)
    value = F.when(~first.isin("tr", "en"), F.col("slug")).when(F.col("slug").rlike(DETAIL), F.concat(head, F.lit("/[detay]"))).when(F.col("truncated"), F.lit(None).cast("string")).when(n <= 2, head).otherwise(F.concat(head, F.lit("/"), last))
    return rows.withColumn("template", value).drop("word", "_known")


def device_stats(df: DataFrame) -> DataFrame:
    """Per device: most frequent width (first seen on a tie), median height, number; rows with an error are left out."""
    ok = df.where("error IS NULL")
    width = ok.groupBy("device", "width").agg(F.count("*").alias("n"), F.min("pos").alias("first")).groupBy("device").agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("mode_width"))
    return ok.groupBy("device").agg(F.percentile("height", F.lit(0.5)).alias("median_height"), F.count("*").alias("n")).join(width, "device")


def shot_flags(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds flags: overflow, narrow, blank, too short, too long, or broken."""
    d = F.col("width") - F.col("mode_width")
    flags = F.array_compact(F.array(
        F.when(d > 0, F.concat(F.lit("TASMA(+"), d.cast("string"), F.lit("px)"))).when(d < 0, F.concat(F.lit("DAR(-"), (-d).cast("string"), F.lit("px)"))),
        F.when(F.col("std") < BLANK, F.lit("BOS_SAYFA")), F.when(F.col("height") < F.col("median_height") * SHORT, F.lit("COK_KISA")), F.when(F.col("height") > F.col("median_height") * LONG, F.lit("COK_UZUN")),
    ))
    rows = df.join(F.broadcast(stats.select("device", "mode_width", "median_height")), "device", "left")  # a row for each device
    return rows.withColumn("flags", F.when(F.col("error").isNotNull(), F.array(F.lit("BOZUK_DOSYA"))).otherwise(flags)).drop("mode_width", "median_height")


def missing_pairs(df: DataFrame) -> DataFrame:
    """Pages that lack a device that other pages have."""
    every = df.where("error IS NULL").agg(F.array_sort(F.collect_set("device")).alias("every"))
    pages = df.groupBy("page").agg(F.collect_set("device").alias("have"))
    return pages.crossJoin(every).select("page", F.array_join(F.array_except("every", "have"), ",").alias("missing")).where("missing <> ''")  # one row


def same_look(df: DataFrame, min_pages: int = 3) -> DataFrame:
    """Shots that look the same on min_pages pages or more: device, look, images and pages."""
    rows = df.where(F.col("look").isNotNull() & ~F.array_contains("flags", "BOS_SAYFA"))
    return rows.groupBy("device", "look").agg(F.count("*").alias("n_images"), F.count_distinct("page").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def same_look_flags(df: DataFrame, min_pages: int = 3) -> DataFrame:
    """df with AYNI_GORUNUM(n) among the flags of shots in a group of same_look, n its images."""
    groups = same_look(df, min_pages).select(F.col("device").alias("_d"), F.col("look").alias("_l"), "n_images")
    rows = df.join(groups, (F.col("device") == F.col("_d")) & (F.col("look") == F.col("_l")) & ~F.array_contains("flags", "BOS_SAYFA"), "left")
    more = F.when(F.col("n_images").isNotNull(), F.array(F.concat(F.lit("AYNI_GORUNUM("), F.col("n_images"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("flags", F.concat("flags", more)).drop("_d", "_l", "n_images")


def greedy_clusters(df: DataFrame, eps: int = 10, block: int = 256, most: int = 1000) -> DataFrame:
    """(template, id, cluster, hash, height): in order of height a shot joins the first centre within eps bits, or opens a cluster. Shots without a hash are left out.

    Rounds: the first open shots of each template, `block` of them and twice as many each time up to `most`, name the next centres, and every open shot is held against
    those alone, in order. A centre comes before all shots that it is new to, so the outcome is that of one pass, but no task holds more than a block of a template: up
    to 1,000 rows a group Spark cuts within the tasks, before it sorts.
    """

    def opened(rows: pd.DataFrame) -> pd.DataFrame:
        centres: list[int] = []
        for h in rows.sort_values(["height", "id"])["hash"]:
            if not any(((int(h) ^ c) & (2**64 - 1)).bit_count() <= eps for c in centres):
                centres.append(int(h))
        return pd.DataFrame({"of": [rows["template"].iloc[0]], "centres": [centres]})

    order = Window.partitionBy("template").orderBy("height", "id")
    at = F.array_position(F.transform("centres", lambda c: hamming(c, F.col("hash")) <= eps), True)  # the first that is near, 0 without one
    rows = kept(df.where("hash IS NOT NULL").select("template", "id", "hash", "height", F.lit(0).alias("base")))
    done = rows.limit(0).select("template", "id", F.col("base").alias("cluster"), "hash", "height")
    while not rows.isEmpty():
        head = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= block)
        centres = head.groupBy("template").applyInPandas(opened, "of string, centres array<long>")
        round_ = kept(rows.join(centres, F.col("template").eqNullSafe(F.col("of"))).select("template", "id", "hash", "height", "base", F.size("centres").alias("n"), at.cast("int").alias("at")))
        done = done.unionByName(round_.where("at > 0").select("template", "id", (F.col("base") + F.col("at") - 1).alias("cluster"), "hash", "height"))
        rows = round_.where("at = 0").select("template", "id", "hash", "height", (F.col("base") + F.col("n")).alias("base"))
        block = min(2 * block, most)
    return done


def cluster_centres(clusters: DataFrame) -> DataFrame:
    """The first member of each cluster."""
    return first_by(clusters, ["template", "cluster"], ["height", "id"]).select("template", "cluster", F.col("hash").alias("centre"))


def assign_nearest(df: DataFrame, centres: DataFrame, eps: int = 10, chunk: int = 1024) -> DataFrame:
    """(id, template, how) of shots without a template: the nearest centre of their section within eps bits, ties to the smaller template. Takes id, section, hash; section, template, centre.

    With a column lang on both sides a section is one of its language. A shot meets a section's centres in arrays of about `chunk`, dealt by hash, so that no pair becomes a row.
    """
    keys = [c for c in ("lang", "section") if c in centres.columns]
    known = centres.where("centre IS NOT NULL").select(*keys, "template", "centre").distinct()
    parts = known.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("long").alias("parts"))
    packed = known.join(parts, keys).groupBy(*keys, F.pmod(F.xxhash64("template", "centre"), "parts").alias("part")).agg(F.collect_list(F.struct("template", "centre")).alias("near"))
    nearest = F.array_min(F.transform("near", lambda c: F.struct(hamming(F.col("hash"), c["centre"]).alias("d"), c["template"].alias("template"))))
    # the arrays end here: what is sorted and grouped is a distance and a name
    best = df.join(packed, keys, "left").select("id", *keys, nearest.alias("b")).groupBy("id", *keys).agg(F.min("b").alias("b"))
    hit = F.col("b.d") <= eps
    cut = F.concat(*(x for k in keys for x in (F.col(k), F.lit("/"))), F.lit("[kesik]"))
    return best.select("id", F.when(hit, F.col("b.template")).otherwise(cut).alias("template"), F.when(hit, F.concat(F.lit("gorsel("), F.col("b.d"), F.lit(")"))).otherwise("yok").alias("how"))


def propagate_template(df: DataFrame, main: str) -> DataFrame:
    """Adds final: a shot's template, or its page's on the main device."""
    lead = df.where(F.col("device") == main).groupBy("page").agg(F.min("template").alias("_t"))
    return df.join(lead, "page", "left").withColumn("final", F.coalesce("template", "_t", F.concat("section", F.lit("/[kesik]")))).drop("_t")


def shot_representatives(clusters: DataFrame, n: int = 3, least: int = 5) -> DataFrame:
    """(template, cluster, id): the shot at the middle height of up to n clusters with `least` members, or else of the largest one."""
    sized = clusters.withColumn("size", F.count("*").over(Window.partitionBy("template", "cluster")))
    w = Window.partitionBy("template", "cluster").orderBy("height", "id")
    middle = sized.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") == F.floor(F.col("size") / 2))
    order = Window.partitionBy("template").orderBy(F.desc("size"), "cluster")
    ranked = middle.withColumn("rank", F.row_number().over(order))
    return ranked.where(((F.col("size") >= least) & (F.col("rank") <= n)) | (F.col("rank") == 1)).select("template", "cluster", "id", "size")


def chosen_shots(shots: DataFrame, clusters: DataFrame, n: int = 3, least: int = 5) -> DataFrame:
    """(template, page, reason, device, id, n_pages): the pages that stand for each template, with all their devices (E15).

    Those of shot_representatives by falling size of their cluster, and the widest page of a template of which some shot overflows; a page that is picked twice has its
    first reason. n_pages are those of the template. Takes shots (template, page, device, id, width, flags) and clusters (template, cluster, id, height).
    """
    page = shots.select("template", "id", "page")
    middle = shot_representatives(clusters, n, least)
    order = Window.partitionBy("template").orderBy(F.desc("size"), "cluster")
    middle = middle.withColumn("rank", F.row_number().over(order)).join(page, ["template", "id"])  # n rows of a template
    picks = middle.select("template", "page", "rank", F.concat(F.lit("görsel küme "), "rank", F.lit(" ("), "size", F.lit(" sayfa)")).alias("reason"))
    over = shots.where(F.exists("flags", lambda f: f.startswith("TASMA"))).groupBy("template").agg(F.min_by("page", F.struct(-F.col("width"), "id")).alias("page"), F.count("*").alias("k"))
    picks = picks.unionByName(over.select("template", "page", F.lit(1 << 30).alias("rank"), F.concat(F.lit("en çok taşan sayfa ("), "k", F.lit(" taşma)")).alias("reason")))
    once = picks.groupBy("template", "page").agg(F.min_by("reason", "rank").alias("reason"))
    pages = shots.groupBy("template").agg(F.count_distinct("page").alias("n_pages"))
    return once.join(pages, "template").join(shots.select("page", "device", "id"), "page").select("template", "page", "reason", "device", "id", "n_pages")


def template_summary(df: DataFrame, clusters: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(template, n_pages, n_flagged, sample) of shots; with clusters and chosen_shots also n_clusters and n_chosen, the pages that stand for it (E16)."""
    rows = df.groupBy("template").agg(F.count_distinct("page").alias("n_pages"), F.count_if(F.size("flags") > 0).alias("n_flagged"), F.min("page").alias("sample"))
    for part, of, name in ((clusters, "cluster", "n_clusters"), (chosen, "page", "n_chosen")):
        if part is not None:
            rows = rows.join(part.groupBy("template").agg(F.count_distinct(of).alias(name)), "template", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return rows


def scan_totals(df: DataFrame) -> DataFrame:
    """images, pages, templates, templates of a single page, truncated names, how many of these got a template by look, and the share of chosen shots in percent.

    Takes page, template, truncated, how (as of assign_nearest) and chosen. Pages are counted in their own pass, since one may be in several templates.
    """
    each = df.groupBy("template").agg(F.count("*").alias("n"), F.count_distinct("page").alias("p"), F.count_if("truncated").alias("t"), F.count_if(F.col("truncated") & F.col("how").startswith("gorsel")).alias("g"), F.count_if("chosen").alias("c"))
    share = F.try_divide(F.coalesce(F.sum("c"), F.lit(0)) * 100.0, F.coalesce(F.sum("n"), F.lit(0)))
    sums = each.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in (("n", "images"), ("t", "truncated"), ("g", "by_look"))), F.count("*").alias("templates"), F.count_if(F.col("p") == 1).alias("single_page"), share.alias("chosen_pct"))
    return sums.crossJoin(df.agg(F.count_distinct("page").alias("pages")))  # one row each


def flag_counts(df: DataFrame) -> DataFrame:
    return df.select("device", F.explode("flags").alias("f")).groupBy("device", F.substring_index("f", "(", 1).alias("flag")).agg(F.count("*").alias("n"))


def hash_bits(digits: Column) -> Column:
    """A 64-bit hash in hexadecimal as long; null for an empty one."""
    return F.conv(F.nullif(digits, F.lit("")), 16, -10).cast("long")
