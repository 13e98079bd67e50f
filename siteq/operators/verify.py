"""Re-verification of findings (I), labelling and before/after comparison (J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteq.functions.urls import safe_name
from siteq.operators.tables import ratio

# Types that the page's layout can show again, by what they're called there; tolerance in pixels.
MEASURED = {"overflow": "icerik_tasmasi", "TASMA": "icerik_tasmasi", "overlap": "ust_uste_binme", "broken_image": "kirik_gorsel"}
MARGIN = 200


def collect_findings(*sources: DataFrame) -> DataFrame:
    """One table of all sources' findings; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def certain_findings(found: DataFrame) -> DataFrame:
    """(file, slice, type, evidence) that two models or more saw, with the first evidence that isn't empty, cut at 200."""
    some = F.when(F.col("sample") != "", F.col("seq"))
    return found.groupBy("file", "slice", "type").agg(F.count_distinct("model").alias("votes"), F.substring(F.min_by("sample", some), 1, 200).alias("evidence")).where("votes >= 2").drop("votes")


def resolve_finding_urls(findings: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with a URL, the count of those without): a missing URL is that of the page's safe name."""
    named = urls.select(safe_name(F.col("url")).alias("page"), F.col("url").alias("_u")).groupBy("page").agg(F.min("_u").alias("_u"))
    rows = findings.join(named, "page", "left").withColumn("url", F.coalesce("url", "_u")).drop("_u")
    return rows.where("url IS NOT NULL"), rows.agg(F.count_if(F.col("url").isNull()).alias("unresolved"))


def verify_findings(pending: DataFrame, measured: DataFrame, text_again: DataFrame | None) -> DataFrame:
    """Adds verdict: DOGRULANDI, GORULMEDI, ELLE or ACILAMADI.

    pending: source, type, url, device, y0, y1; measured (a row a url and device): http_status, scrolls, defects (type, y);
    text_again: url, pattern. A text finding must show its pattern again; an http one a status other than 200; others a
    defect of the type in the same place, and overflow also a page that scrolls. Where measured has a column widest (y), the
    element that widens a scrolling page stands in for a missing defect. Without text_again text findings are ELLE.
    """
    checked = text_again is not None
    again = pending.limit(0).select("url", F.col("type"), F.lit(True).alias("_again")) if not checked else text_again.select("url", F.col("pattern").alias("type"), F.lit(True).alias("_again")).distinct()
    rows = pending.join(again, ["url", "type"], "left").join(measured.withColumn("_seen", F.lit(True)), ["url", "device"], "left")
    kind = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), MEASURED.items(), F.when(F.lit(False), ""))
    rows = rows.withColumn("_kind", kind)
    mine = F.filter(F.coalesce("defects", F.array().cast("array<struct<type: string, y: int>>")), lambda d: d["type"] == F.col("_kind"))
    near = F.filter(mine, lambda d: F.col("y0").isNull() | d["y"].isNull() | d["y"].between(F.col("y0") - MARGIN, F.col("y1") + MARGIN))
    overflow = F.col("_kind") == "icerik_tasmasi"
    anywhere = F.col("y0").isNull() | F.col("y1").isNull()
    widens = F.col("widest").isNotNull() & (anywhere | F.coalesce(F.col("widest.y"), F.lit(-1)).between(F.col("y0") - MARGIN, F.col("y1") + MARGIN)) if "widest" in measured.columns else F.lit(False)
    visual = (
        F.when(F.col("_kind").isNull(), "ELLE")
        .when(overflow & ~F.col("scrolls"), "GORULMEDI")
        .when(overflow & F.col("scrolls") & (F.size(near) == 0), F.when(widens, "DOGRULANDI").when(F.size(mine) == 0, "ELLE").otherwise("GORULMEDI"))
        .when(F.size(near) > 0, "DOGRULANDI")
        .otherwise("GORULMEDI")
    )
    verdict = (
        F.when(F.col("source") == "metin", F.when(F.col("_again"), "DOGRULANDI").otherwise("GORULMEDI" if checked else "ELLE"))
        .when(F.col("_seen").isNull(), "ACILAMADI")
        .when(F.col("source") == "http", F.when(F.col("http_status") == 200, "GORULMEDI").otherwise("DOGRULANDI"))
        .otherwise(visual)
    )
    return rows.withColumn("verdict", verdict).drop("_again", "_seen", "_kind")


def root_causes(defects: DataFrame) -> DataFrame:
    """Per device, type and selector: distinct pages, largest overflow, smallest URL, and with columns text and seq the first text that isn't empty."""
    more = [F.min_by("text", F.when(F.col("text") != "", F.col("seq"))).alias("text")] if "text" in defects.columns else []
    return defects.groupBy("device", "type", "selector").agg(F.count_distinct("url").alias("n_pages"), F.max("px").alias("max_px"), F.min("url").alias("example"), *more)


def remaining_causes(defects: DataFrame, n: int = 15) -> DataFrame:
    """The n root causes on most pages: what is left after a fix."""
    return root_causes(defects).orderBy(F.desc("n_pages"), "device", "type", "selector").limit(n)


VERDICTS = ["DOGRULANDI", "GORULMEDI", "ELLE", "ACILAMADI"]


def verdict_crosstab(df: DataFrame) -> DataFrame:
    """Counts of each verdict by source and type, and of all."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return df.groupingSets([["source", "type"], []], "source", "type").agg(*counts, F.count("*").alias("total"))


def scroll_counts(df: DataFrame) -> DataFrame:
    """By source how many findings' pages scroll and don't."""
    return df.where(F.col("scrolls").isNotNull()).groupBy("source").agg(F.count_if("scrolls").alias("evet"), F.count_if(~F.col("scrolls")).alias("hayir"))


def finding_id(*parts: Column) -> Column:
    """The first 12 digits of the md5 of source|type|device|url|slice, nulls empty."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12)


def label_sample(df: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """(id, grp): all ELLE, all GORULMEDI and n drawn DOGRULANDI findings, none of http; an id is in its first group. The draw is by hash."""
    rows = df.where("source <> 'http'")
    drawn = rows.where("verdict = 'DOGRULANDI'").select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("id", F.lit(2).alias("rank"), F.lit("ornek").alias("grp"))
    rest = rows.where("verdict IN ('ELLE', 'GORULMEDI')").select("id", F.when(F.col("verdict") == "ELLE", 0).otherwise(1).alias("rank"), F.when(F.col("verdict") == "ELLE", "elle").otherwise("gorulmedi").alias("grp"))
    return rest.unionByName(drawn).groupBy("id").agg(F.min_by("grp", "rank").alias("grp"))


def label_precision(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Per group, source and type, and for all of the sample: real, false, unsure and real / (real + false)."""
    j = items.join(labels, "id")
    counts = [F.count_if(F.col("label") == v).alias(n) for v, n in (("gercek", "real"), ("yanlis", "false"), ("emin_degil", "unsure"))]
    each = j.groupBy("grp", "source", "type").agg(*counts)
    total = j.where("grp = 'ornek'").agg(*counts).select(F.lit("ornek").alias("grp"), F.lit("").alias("source"), F.lit("").alias("type"), "real", "false", "unsure")
    return each.unionByName(total).withColumn("rate", ratio(F.col("real"), F.col("real") + F.col("false")))


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "id", "left")


def scrolling_pages(before: DataFrame) -> DataFrame:
    return before.where("scrolls").select("url").distinct()


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, device, state, px_before, px_after) of pages measured both times that scroll in one of them. Takes url, device, scrolls, scroll, client."""
    b, a = before.alias("b"), after.alias("a")
    j = b.join(a, ["url", "device"]).where("b.scrolls OR a.scrolls")
    px = lambda t: F.greatest(F.lit(0), F.coalesce(f"{t}.scroll", F.lit(0)) - F.coalesce(f"{t}.client", F.lit(0)))
    state = F.when(F.col("b.scrolls") & ~F.col("a.scrolls"), "DUZELDI").when(F.col("b.scrolls"), "KALDI").otherwise("YENI_BOZULDU")
    return j.select("url", "device", state.alias("state"), px("b").alias("px_before"), px("a").alias("px_after"))


def fix_summary(states: DataFrame) -> DataFrame:
    """Per device: fixed, left, newly broken and the rate of fixes."""
    s = states.groupBy("device").agg(*(F.count_if(F.col("state") == v).alias(n) for v, n in (("DUZELDI", "fixed"), ("KALDI", "left_over"), ("YENI_BOZULDU", "new_broken"))))
    return s.withColumn("rate", ratio(F.col("fixed"), F.col("fixed") + F.col("left_over")))


def rule_body(kind: Column, nowrap: Column, flex: Column, important: Column) -> Column:
    """Declarations of a fix rule."""
    imp = F.when(important, " !important").otherwise("")
    put = lambda *d: F.array(*(F.concat(F.lit(x), imp) for x in d))
    text = F.array_compact(F.array(F.concat(F.lit("overflow-wrap: anywhere"), imp), F.when(nowrap, F.concat(F.lit("white-space: normal"), imp)), F.when(flex, F.concat(F.lit("min-width: 0"), imp))))
    body = F.when(kind == "tablo", put("display: block", "max-width: 100%", "overflow-x: auto")).when(kind == "onbicimli", put("max-width: 100%", "overflow-x: auto")).when(kind == "metin", text).otherwise(put("max-width: 100%", "box-sizing: border-box"))
    return F.array_join(body, "; ")


def fix_rules(measured: DataFrame) -> DataFrame:
    """Rules of scrolling elements: (selector, kind, nowrap, flex, n_pages, body)."""
    r = measured.where(~F.col("selector").isin("html", "body")).groupBy("selector", "kind").agg(F.bool_or("nowrap").alias("nowrap"), F.bool_or("flex").alias("flex"), F.count_distinct("url").alias("n_pages"))
    return r.withColumn("body", rule_body(F.col("kind"), F.col("nowrap"), F.col("flex"), F.lit(False)))


def update_rules(rules: DataFrame, derived: DataFrame) -> DataFrame:
    """Rules after a round: new ones, changed kinds (no longer important), hints ORed, and unchanged ones that still fail made important."""
    o, n = rules.alias("o"), derived.where(~F.col("selector").isin("html", "body")).alias("n")
    j = o.join(n, "selector", "full_outer")
    old, new = F.col("o.kind").isNotNull(), F.col("n.kind").isNotNull()
    other = new & old & (F.col("o.kind") != F.col("n.kind"))
    hint = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(False)) | F.coalesce(F.col(f"n.{c}"), F.lit(False))
    more = (hint("nowrap") != F.coalesce(F.col("o.nowrap"), F.lit(False))) | (hint("flex") != F.coalesce(F.col("o.flex"), F.lit(False)))
    important = F.when(~old | other, False).when(new & ~more, True).otherwise(F.col("o.important"))
    return j.select("selector", F.coalesce("n.kind", "o.kind").alias("kind"), hint("nowrap").alias("nowrap"), hint("flex").alias("flex"), important.alias("important"))


def drop_ineffective(rule_pages: DataFrame, fixed: DataFrame) -> DataFrame:
    """Selectors that fixed a page of theirs. Takes selector, url; url."""
    return rule_pages.join(fixed.select("url"), "url", "left_semi").select("selector").distinct()


def round_table(rounds: DataFrame, base: DataFrame) -> DataFrame:
    """Per round and device: measured, scrolling, fixed and newly broken against the base."""
    j = rounds.alias("r").join(base.select("url", "device", F.col("scrolls").alias("was")), ["url", "device"])
    return j.groupBy("round", "device").agg(F.count("*").alias("measured"), F.count_if("scrolls").alias("scrolling"), F.count_if(F.col("was") & ~F.col("scrolls")).alias("fixed"), F.count_if(~F.col("was") & F.col("scrolls")).alias("new_broken"))
