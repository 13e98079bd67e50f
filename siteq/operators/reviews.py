"""Model-review analytics (F), report aggregates (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteq.functions.urls import any_of
from siteq.operators.tables import column_top, ratio

# Width and slice height of a device, quota marks, types of defects, reliable types, prices per million tokens.
SLICES = {"desktop": (1024, 1024), "mobile": (375, 1334)}
DEFAULT_SLICE = (1024, 1024)
QUOTA = ("kota_bitti", "429", "RESOURCE_EXHAUSTED", "PerDay", "per day")
RELIABLE = ("mojibake", "overlap", "missing_data", "broken_image")
ANSWER = "struct<visible_text_sample: string, defects: array<struct<type: string, severity: string, confidence: string, location: string, evidence_text: string, description: string>>>"


def plan_slices(images: DataFrame, most: int) -> DataFrame:
    """A row (file, device, slice, n_slices, y0, y1) for each slice to look at. Takes file, device, width, height."""
    w = F.when(F.col("device") == "mobile", SLICES["mobile"][0]).otherwise(DEFAULT_SLICE[0])
    h = F.when(F.col("device") == "mobile", SLICES["mobile"][1]).otherwise(DEFAULT_SLICE[1])
    scaled = F.when(F.col("width") > w, F.rint(F.col("height") * w / F.col("width"))).otherwise(F.col("height")).cast("long")
    rows = images.withColumns({"_sh": h.cast("long"), "_h": scaled})
    rows = rows.withColumn("n_slices", F.greatest(F.lit(1), F.ceil(F.col("_h") / F.col("_sh"))).cast("long"))
    first = F.when(F.col("n_slices") <= most, F.sequence(F.lit(1).cast("long"), F.col("n_slices"))).otherwise(F.concat(F.slice(F.sequence(F.lit(1).cast("long"), F.col("n_slices")), 1, most - 1), F.array("n_slices")) if most > 1 else F.array(F.lit(1).cast("long")))
    rows = rows.withColumn("slice", F.explode(first))
    scale = F.when(F.col("width") > w, F.col("width") / w).otherwise(F.lit(1.0))
    y = lambda v: F.rint(v * scale).cast("long")
    return rows.select("file", "device", "slice", "n_slices", y((F.col("slice") - 1) * F.col("_sh")).alias("y0"), y(F.least(F.col("_h"), F.col("slice") * F.col("_sh"))).alias("y1"))


KEY = ["model", "file", "slice"]


def latest_success(records: DataFrame) -> DataFrame:
    """One record a model, file and slice: the last success, or the first failure if none succeeded. Takes seq (order) and error."""
    rest = [c for c in records.columns if c not in KEY]
    ok = F.col("error").isNull()
    rank = F.struct(ok.cast("int"), F.when(ok, F.col("seq")).otherwise(-F.col("seq")))
    return records.groupBy(*KEY).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*KEY, *(F.col(f"_r.{c}").alias(c) for c in rest))


def parse_answers(df: DataFrame, types, text: str = "answer") -> DataFrame:
    """Adds parsed: the JSON between the first { and the last }, null without an array of defects; unknown types become other, odd ratings low."""
    body = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), ANSWER)
    rate = lambda c: F.when(c.isin("low", "medium", "high"), c).otherwise("low")
    empty = lambda c: F.coalesce(c, F.lit(""))
    fix = lambda d: F.struct(F.when(d["type"].isin(*types), d["type"]).otherwise("other").alias("type"), rate(d["severity"]).alias("severity"), rate(d["confidence"]).alias("confidence"), empty(d["location"]).alias("location"), empty(d["evidence_text"]).alias("evidence_text"), empty(d["description"]).alias("description"))
    rows = df.withColumn("_b", body)
    return rows.withColumn("parsed", F.when(F.col("_b.defects").isNotNull(), F.struct(empty(F.col("_b.visible_text_sample")).alias("visible_text_sample"), F.transform("_b.defects", fix).alias("defects")))).drop("_b")


def findings(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each defect; records without one give none."""
    return parsed.select(*keep, F.inline("parsed.defects"))


def local_review_rows(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each defect, and one with nulls for a record without any."""
    return parsed.select(*keep, F.explode_outer("parsed.defects").alias("d")).select(*keep, "d.type", "d.severity")


def vote(found: DataFrame, records: DataFrame) -> DataFrame:
    """Votes for (file, slice, type): models that found it, models that looked, verdict, their names, modal severity (first seen on a tie), sample."""
    looked = records.where("error IS NULL").groupBy("file", "slice").agg(F.count_distinct("model").alias("looked"))
    by = ["file", "slice", "type"]
    severity = found.groupBy(*by, "severity").agg(F.count("*").alias("n"), F.min("seq").alias("first")).groupBy(*by).agg(F.max_by("severity", F.struct("n", -F.col("first"))).alias("severity"))
    votes = found.groupBy(*by).agg(F.count_distinct("model").alias("votes"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.substring(F.min_by("sample", "seq"), 1, 300).alias("sample"))
    rows = votes.join(severity, by).join(looked, ["file", "slice"], "left")
    return rows.withColumns({"looked": F.coalesce("looked", F.lit(1)), "verdict": F.when(F.col("votes") >= 2, "KESIN").otherwise("INCELE")})


def review_error_class(error: Column) -> Column:
    has = lambda *words: any_of(error.contains(w) for w in words)
    low = F.lower(error)
    return (
        F.when(has("gemma_500_kalici"), "Gemma kalıcı 500 (PNG ve JPEG denendi)")
        .when((error == "kota_bitti") | has("429", "RESOURCE_EXHAUSTED"), "kota / hız sınırı")
        .when(has("json") | (error == "bos_cevap"), "geçersiz ya da boş cevap")
        .when(any_of(low.contains(w) for w in ("timeout", "timed out", "deadline_exceeded")), "zaman aşımı (cevap gelmedi)")
        .when(error.isNotNull(), "bağlantı / sunucu hatası")
    )


def _state(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Expected slices with done, and the last error of those that never succeeded."""
    seen = records.groupBy(*KEY).agg(F.bool_or(F.col("error").isNull()).alias("done"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"))
    return expected.join(seen, KEY, "left").withColumn("done", F.coalesce("done", F.lit(False)))


def coverage(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Per model: expected, done, failed, quota, untried slices."""
    failed = ~F.col("done") & F.col("last_error").isNotNull()
    quota = failed & any_of(F.col("last_error").contains(q) for q in QUOTA)
    return _state(expected, records).groupBy("model").agg(F.count("*").alias("expected"), F.count_if("done").alias("done"), F.count_if(failed).alias("failed"), F.count_if(quota).alias("quota"), F.count_if(~F.col("done") & F.col("last_error").isNull()).alias("untried"))


def coverage_errors(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Per model and failure class: slices that failed."""
    return _state(expected, records).where(~F.col("done") & F.col("last_error").isNotNull()).groupBy("model", review_error_class(F.col("last_error")).alias("class")).agg(F.count("*").alias("n"))


def first_model_complete(cov: DataFrame) -> DataFrame:
    """Whether a model's slices are all tried but for lasting failures."""
    return cov.select("model", ((F.col("untried") + F.col("quota")) == 0).alias("complete"))


def arbiter_candidates(records: DataFrame, found: DataFrame, arbiter: str, by_type: bool = False, only_unseen: bool = False) -> DataFrame:
    """Slices for the arbiter, (grp, file, slice): high severity, found by fewer than two models, or never seen by the first models."""
    mine, hits = records.where(F.col("model") != arbiter), found.where(F.col("model") != arbiter)
    info = mine.groupBy("file", "slice").agg(F.max_by("template", "seq").alias("template"), F.max_by("device", "seq").alias("device"), F.bool_or(F.col("error").isNull()).alias("seen"))
    high = hits.where("severity = 'high'").select("file", "slice", "type").distinct()
    few = hits.groupBy("file", "slice", "type").agg(F.count_distinct("model").alias("n")).where("n < 2").select("file", "slice", "type")
    unseen = info.where(~F.col("seen"))
    if only_unseen:
        return unseen.select(F.lit("_bakilamadi").alias("grp"), "file", "slice")
    key = F.concat_ws("|", "device", "type") if by_type else F.concat_ws("|", "template", "device", "type")
    rows = high.unionByName(few).distinct().join(info, ["file", "slice"]).select(key.alias("grp"), "file", "slice")
    if not by_type:
        rows = rows.unionByName(unseen.withColumn("type", F.lit("_bakilamadi")).select(key.alias("grp"), "file", "slice"))
    return rows.distinct()


def cap_per_group(candidates: DataFrame, n: int, random: bool = False, seed: int = 42) -> DataFrame:
    """Slices of at most n candidates a group: the first by file and slice, or a draw by hash that any partitioning repeats."""
    order = [F.xxhash64("file", "slice", F.lit(seed)), "file", "slice"] if random else ["file", "slice"]
    return column_top(candidates, ["grp"], order, n).select("file", "slice").distinct()


def pending_requests(slices: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """Each model with each slice, without what is done. Models are a handful of rows, and broadcast."""
    return slices.crossJoin(F.broadcast(models)).join(done.select(*KEY).distinct(), KEY, "left_anti")


def exclude_http_errors(shots: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shots of pages with status 200 or none known, pages with another status by status and URL). Takes page; page, url, status."""
    errors = results.where("status <> 200")
    return shots.join(errors.select("page"), "page", "left_anti"), errors.select("status", "url")


def model_usage(records: DataFrame, found: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests, successes, findings, slices with findings, tokens, mean seconds and cost (half when batched) of each model."""
    ok = F.col("error").isNull()
    r = records.join(F.broadcast(prices), "model", "left")  # a row for each model
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6 * F.when(F.col("batched"), 0.5).otherwise(1.0)
    base = r.groupBy("model").agg(F.count("*").alias("requests"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.avg(F.when(ok & (F.col("seconds") > 0), F.col("seconds"))).alias("mean_seconds"), F.sum(cost).alias("cost"))
    f = found.groupBy("model").agg(F.count("*").alias("findings"), F.count_distinct("file", "slice").alias("slices_with_findings"))
    return base.join(f, "model", "left").withColumns({"findings": F.coalesce("findings", F.lit(0)), "slices_with_findings": F.coalesce("slices_with_findings", F.lit(0))})


# Pixels of a token, tokens of the prompt and of an answer.
PIXELS, PROMPT_TOKENS, OUT_TOKENS = 750, 900, 350


def estimate_cost(slices: DataFrame, prices: DataFrame) -> DataFrame:
    """Expected tokens and cost of each priced model over all slices, whose width and height are those of the image as it is sent."""
    t = slices.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("w") * F.col("h") / PIXELS) + PROMPT_TOKENS).alias("tokens_in"))
    return F.broadcast(prices).crossJoin(t).select("model", "n", "tokens_in", (F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("n") * OUT_TOKENS * F.col("price_out") / 1e6).alias("cost"))


def agreement(records: DataFrame, found: DataFrame, main: str, arbiter: str) -> DataFrame:
    """Per device and type, with a row of totals: findings of the main model, those whose slice the arbiter saw, those it confirmed, and the rate."""
    first = found.where(F.col("model") == main).select("device", "file", "slice", "type").distinct()
    saw = records.where((F.col("model") == arbiter) & F.col("error").isNull()).select("file", "slice").distinct().withColumn("saw", F.lit(True))
    same = found.where(F.col("model") == arbiter).select("file", "slice", "type").distinct().withColumn("same", F.lit(True))
    rows = first.join(saw, ["file", "slice"], "left").join(same, ["file", "slice", "type"], "left")
    out = rows.groupingSets([["device", "type"], []], "device", "type").agg(F.count("*").alias("main"), F.count_if("saw").alias("sampled"), F.count_if(F.col("saw") & F.col("same")).alias("confirmed"))
    return out.withColumn("rate", ratio(F.col("confirmed"), F.col("sampled")))


def confusion(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """TP, FP, FN, precision and recall over files that were measured. Takes file, hit (several rows a file); file, flag."""
    p = pred.groupBy("file").agg(F.bool_or("hit").alias("hit"))
    c = p.join(truth, "file").agg(F.count_if(F.col("hit") & F.col("flag")).alias("tp"), F.count_if(F.col("hit") & ~F.col("flag")).alias("fp"), F.count_if(~F.col("hit") & F.col("flag")).alias("fn"))
    return c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def evidence(found: DataFrame, kind: str, n: int = 40) -> DataFrame:
    """Up to n findings of one type for each model, by file and slice."""
    return column_top(found.where(F.col("type") == kind), ["model"], ["file", "slice", "sample"], n).select("model", "file", "slice", "sample")


def limit_pages(shots: DataFrame, n: int) -> DataFrame:
    """All shots of the n pages that come first."""
    pages = shots.groupBy("page").agg(F.min("pos").alias("first")).orderBy("first", "page").limit(n)
    return shots.join(pages.select("page"), "page", "left_semi")


def reliable_split(found: DataFrame) -> DataFrame:
    """Findings of reliable types with certain: whether two models or more saw them."""
    return found.where(F.col("type").isin(*RELIABLE)).groupBy("file", "slice", "type").agg((F.count_distinct("model") >= 2).alias("certain"))


def page_defects(certain: DataFrame) -> DataFrame:
    """Pages with a type over devices and slices: devices and number of slices. Takes page, type, device, slice."""
    return certain.groupBy("page", "type").agg(F.array_join(F.array_sort(F.collect_set("device")), ",").alias("devices"), F.count_distinct("device", "slice").alias("n_slices"))


def overflow_px(flagged: DataFrame, n: int = 20) -> DataFrame:
    """The n shots that overflow most, from the text of their flag."""
    px = F.regexp_extract("flag", r"TASMA\(\+(\d+)px\)", 1)
    return flagged.where(px != "").select("file", px.cast("int").alias("px")).orderBy(F.desc("px"), "file").limit(n)


def overflow_by_template(flagged: DataFrame, n: int = 20) -> DataFrame:
    return flagged.where(F.col("flag").startswith("TASMA")).groupBy("template", "device").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template", "device").limit(n)


def overflow_by_device(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("flag").startswith("TASMA")).groupBy("device").agg(F.count("*").alias("n"))


def report_totals(flagged: DataFrame, certain: DataFrame, http: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: images, pages, overflowing images, pages with an HTTP error, pages with text damage, and certain findings by page and type and by slice.

    Takes page, flag; page, type, slice, certain; url, status; url, n.
    """
    sure = F.col("certain")
    return (
        flagged.agg(F.count("*").alias("images"), F.count_distinct("page").alias("pages"), F.count_if(F.col("flag").startswith("TASMA")).alias("overflow"))
        .crossJoin(http.agg(F.count_distinct(F.when(F.col("status") != 200, F.col("url"))).alias("http_pages")))
        .crossJoin(texts.agg(F.count_distinct(F.when(F.col("n") > 0, F.col("url"))).alias("text_pages")))
        .crossJoin(certain.agg(F.count_distinct(F.when(sure, F.struct("page", "type"))).alias("page_defects"), F.count_if(sure).alias("certain")))
    )  # one row each


def flag_totals(flagged: DataFrame) -> DataFrame:
    """(name, n_pages, n) of each flag, without what it says in brackets."""
    return flagged.where("flag <> ''").groupBy(F.substring_index("flag", "(", 1).alias("name")).agg(F.count_distinct("page").alias("n_pages"), F.count("*").alias("n"))


def model_types(found: DataFrame) -> DataFrame:
    return found.groupBy("model", "type").agg(F.count("*").alias("n"))


def type_counts(found: DataFrame) -> DataFrame:
    """Single-model and unreliable findings by type."""
    one = found.groupBy("file", "slice", "type").agg(F.count_distinct("model").alias("m"))
    return one.groupBy("type", F.col("type").isin(*RELIABLE).alias("reliable")).agg(F.count("*").alias("n"), F.count_if(F.col("m") == 1).alias("single"))

