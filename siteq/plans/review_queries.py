"""Queries of groups F and H: review records from lineitem by the same expressions on both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteq.operators import reviews as R
from siteq.operators import tables as T
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


# Columns of a review record, in SQL that both engines read. Every slice is tried up to three times.
RECORD = {
    "model": "CASE l_suppkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'claude' END",
    "file": "CAST(l_orderkey % 3000 AS BIGINT)",
    "slice": "CAST(l_linenumber AS BIGINT)",
    "seq": "CAST(l_orderkey AS BIGINT) * 100000000 + l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100",
    "type": "CASE l_returnflag WHEN 'A' THEN 'overlap' WHEN 'N' THEN 'overflow' ELSE 'mojibake' END",
    "severity": "CASE WHEN l_linestatus = 'O' AND l_partkey % 5 = 0 THEN 'high' WHEN l_linestatus = 'O' THEN 'medium' ELSE 'low' END",
    "error": "CASE WHEN l_quantity > 45 THEN 'timeout' WHEN l_quantity > 42 THEN '429 quota' WHEN l_quantity > 40 THEN 'bos_cevap' END",
    "template": "'t' || l_orderkey % 40",
    "device": "CASE WHEN l_orderkey % 3000 % 2 = 0 THEN 'desktop' ELSE 'mobile' END",
    "sample": "'s' || l_orderkey || '-' || l_linenumber || ' | ' || l_partkey",
    "tokens_in": "CAST(l_partkey AS BIGINT)",
    "tokens_out": "CAST(l_quantity AS BIGINT)",
    "seconds": "l_quantity",
    "batched": "l_linenumber % 2 = 0",
}
REC = "rec AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RECORD.items()) + " FROM lineitem), found AS (SELECT * FROM rec WHERE error IS NULL)"


def records(spark, d):
    return table(spark, d, "lineitem").select(*(F.expr(e).alias(c) for c, e in RECORD.items()))


def found(spark, d):
    return records(spark, d).where("error IS NULL")


IMAGES = "img AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, CAST(300 + o_custkey % 1500 AS BIGINT) AS width, CAST(200 + o_orderkey % 9000 AS BIGINT) AS height FROM orders)"


def images(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END").alias("device"), F.expr("300 + o_custkey % 1500").cast("long").alias("width"), F.expr("200 + o_orderkey % 9000").cast("long").alias("height"))


SLICED = IMAGES + """, s AS (SELECT *, CASE device WHEN 'mobile' THEN 375 ELSE 1024 END AS w, CASE device WHEN 'mobile' THEN 1334 ELSE 1024 END AS sh FROM img), t AS (SELECT *, CASE WHEN width > w THEN CAST(round_even(height * w / width, 0) AS BIGINT) ELSE height END AS hh FROM s),
n AS (SELECT *, greatest(1, CAST(ceil(hh / sh) AS BIGINT)) AS n_slices FROM t),
sl AS (SELECT file, device, i AS slice, n_slices, CAST(round_even((i - 1) * sh * CASE WHEN width > w THEN width / w ELSE 1.0 END, 0) AS BIGINT) AS y0, CAST(round_even(least(hh, i * sh) * CASE WHEN width > w THEN width / w ELSE 1.0 END, 0) AS BIGINT) AS y1
FROM (SELECT *, unnest(CASE WHEN n_slices <= 3 THEN range(1, n_slices + 1) ELSE [1, 2, n_slices] END) AS i FROM n))"""


@query("f1_plan_slices", f"WITH {SLICED} SELECT * FROM sl")
def _(spark, d):
    return R.plan_slices(images(spark, d), 3)


LATEST = "lat AS (SELECT *, row_number() OVER (PARTITION BY model, file, slice ORDER BY CASE WHEN error IS NULL THEN 1 ELSE 0 END DESC, CASE WHEN error IS NULL THEN seq ELSE -seq END DESC) AS rn FROM rec)"


@query("f2_latest_success", f"WITH {REC}, {LATEST} SELECT model, file, slice, seq, error FROM lat WHERE rn = 1")
def _(spark, d):
    return R.latest_success(records(spark, d)).select("model", "file", "slice", "seq", "error")


def answers(spark, d):
    one = lambda t, s: f'{{"type": "{t}", "severity": "{s}", "confidence": null, "location": "x"}}'
    text = F.when(F.col("o_orderkey") % 4 == 0, 'sure: {"visible_text_sample": "a", "defects": [' + one("overlap", "high") + "," + one("strange", "huge") + "]} done").when(F.col("o_orderkey") % 4 == 1, '{"defects": []}').when(F.col("o_orderkey") % 4 == 2, '{"note": 1}').otherwise("no json")
    return R.parse_answers(table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), text.alias("answer")), ("overlap", "overflow"))


@query("f3_parse_answers", "SELECT o_orderkey AS file, o_orderkey % 4 IN (0, 1) AS valid, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS n_defects FROM orders")
def _(spark, d):
    return answers(spark, d).select("file", F.col("parsed").isNotNull().alias("valid"), F.coalesce(F.size("parsed.defects"), F.lit(0)).alias("n_defects")).withColumn("n_defects", F.greatest("n_defects", F.lit(0)))


@query("f4_findings", "SELECT o_orderkey AS file, t[1] AS type, t[2] AS severity FROM orders, (SELECT unnest([['overlap', 'high'], ['other', 'low']]) AS t) WHERE o_orderkey % 4 = 0")
def _(spark, d):
    return R.findings(answers(spark, d).where("parsed IS NOT NULL"), ["file"]).select("file", "type", "severity")


@query("f18_local_review_rows", "SELECT o_orderkey AS file, t[1] AS type, t[2] AS severity FROM orders, (SELECT unnest([['overlap', 'high'], ['other', 'low']]) AS t) WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 4 = 1")
def _(spark, d):
    return R.local_review_rows(answers(spark, d).where("parsed IS NOT NULL"), ["file"])


VOTES = """sev AS (SELECT file, slice, type, arg_max(severity, (n, -first)) AS severity FROM (SELECT file, slice, type, severity, count(*) AS n, min(seq) AS first FROM found GROUP BY ALL) GROUP BY ALL),
votes AS (SELECT f.file, f.slice, f.type, count(DISTINCT model) AS votes, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, substr(arg_min(sample, seq), 1, 300) AS sample FROM found f GROUP BY ALL),
looked AS (SELECT file, slice, count(DISTINCT model) AS looked FROM found GROUP BY ALL)"""


@query("f5_vote", f"WITH {REC}, {VOTES} SELECT v.file, v.slice, v.type, votes, looked, CASE WHEN votes >= 2 THEN 'KESIN' ELSE 'INCELE' END AS verdict, models, severity, sample FROM votes v JOIN sev USING (file, slice, type) JOIN looked l ON l.file = v.file AND l.slice = v.slice")
def _(spark, d):
    return R.vote(found(spark, d), records(spark, d)).select("file", "slice", "type", "votes", "looked", "verdict", "models", "severity", "sample")


EXPECTED = "want AS (SELECT m AS model, f AS file, s AS slice FROM (SELECT unnest(['alpha', 'beta']) AS m), (SELECT o_orderkey AS f FROM orders), (SELECT unnest(range(1, 8)) AS s) WHERE (f + s) % 5 < 3)"
STATE = f"WITH {REC}, {EXPECTED}, seen AS (SELECT model, file, slice, bool_or(error IS NULL) AS done, arg_max(error, seq) FILTER (WHERE error IS NOT NULL) AS last_error FROM rec GROUP BY ALL), state AS (SELECT w.model, coalesce(done, false) AS done, last_error FROM want w LEFT JOIN seen s ON s.model = w.model AND s.file = w.file AND s.slice = w.slice)"


def expected(spark, d):
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"))  # with and without records
    rows = every.select("file", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("slice")).where("(file + slice) % 5 < 3")
    return rows.select(F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("model"), "file", "slice")


COVERAGE = "SELECT model, count(*) AS expected, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE NOT done AND last_error IS NOT NULL) AS failed, count(*) FILTER (WHERE NOT done AND contains(last_error, '429')) AS quota, count(*) FILTER (WHERE NOT done AND last_error IS NULL) AS untried FROM state GROUP BY model"


@query("f6_coverage", f"{STATE} {COVERAGE}")
def _(spark, d):
    return R.coverage(expected(spark, d), records(spark, d))


@query("f7_first_model_complete", f"{STATE}, cov AS ({COVERAGE}) SELECT model, untried + quota = 0 AS complete FROM cov")
def _(spark, d):
    return R.first_model_complete(R.coverage(expected(spark, d), records(spark, d)))


@query("f8_review_error_class", f"{STATE} SELECT model, CASE last_error WHEN 'timeout' THEN 'zaman aşımı (cevap gelmedi)' WHEN '429 quota' THEN 'kota / hız sınırı' ELSE 'geçersiz ya da boş cevap' END AS class, count(*) AS n FROM state WHERE NOT done AND last_error IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return R.coverage_errors(expected(spark, d), records(spark, d))


CANDIDATES = """mine AS (SELECT * FROM rec WHERE model <> 'claude'), hits AS (SELECT * FROM found WHERE model <> 'claude'), info AS (SELECT file, slice, arg_max(template, seq) AS template, arg_max(device, seq) AS device, bool_or(error IS NULL) AS seen FROM mine GROUP BY ALL),
pick AS (SELECT file, slice, type FROM hits WHERE severity = 'high' UNION SELECT file, slice, type FROM hits GROUP BY ALL HAVING count(DISTINCT model) < 2),
cand AS (SELECT DISTINCT template || '|' || device || '|' || type AS grp, p.file, p.slice FROM pick p JOIN info i ON i.file = p.file AND i.slice = p.slice UNION SELECT template || '|' || device || '|_bakilamadi', file, slice FROM info WHERE NOT seen)"""


@query("f9_arbiter_candidates", f"WITH {REC}, {CANDIDATES} SELECT * FROM cand")
def _(spark, d):
    return R.arbiter_candidates(records(spark, d), found(spark, d), "claude")


@query("f9_unseen_candidates", f"WITH {REC}, {CANDIDATES} SELECT '_bakilamadi' AS grp, file, slice FROM info WHERE NOT seen")
def _(spark, d):
    return R.arbiter_candidates(records(spark, d), found(spark, d), "claude", only_unseen=True)


@query("f10_cap_per_group", f"WITH {REC}, {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY file, slice) AS rn FROM cand) SELECT DISTINCT file, slice FROM o WHERE rn <= 5")
def _(spark, d):
    return R.cap_per_group(R.arbiter_candidates(records(spark, d), found(spark, d), "claude"), 5)


@query("f10_random_per_group")
def _(spark, d):
    return R.cap_per_group(R.arbiter_candidates(records(spark, d), found(spark, d), "claude", by_type=True), 25, random=True)


@query("f11_pending_requests", f"WITH {REC}, s AS (SELECT DISTINCT file, slice FROM rec), m AS (SELECT DISTINCT model FROM rec), f AS (SELECT DISTINCT model, file, slice FROM found) SELECT m.model, s.file, s.slice FROM s, m WHERE (m.model, s.file, s.slice) NOT IN (SELECT (model, file, slice) FROM f)")
def _(spark, d):
    r = records(spark, d)
    return R.pending_requests(r.select("file", "slice").distinct(), r.select("model").distinct(), found(spark, d)).select("model", "file", "slice")


SHOTS = "shots AS (SELECT o_orderkey AS pos, o_custkey AS page, o_orderkey % 2 AS device FROM orders), res AS (SELECT c_custkey AS page, 'https://x/' || c_custkey AS url, CASE WHEN c_custkey % 9 = 0 THEN 404 ELSE 200 END AS status FROM customer)"


def shots(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 2).alias("device"))


def results(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.concat(F.lit("https://x/"), "c_custkey").alias("url"), F.when(F.col("c_custkey") % 9 == 0, 404).otherwise(200).alias("status"))


@query("f12_exclude_http_errors", f"WITH {SHOTS} SELECT pos, page FROM shots WHERE page NOT IN (SELECT page FROM res WHERE status <> 200)")
def _(spark, d):
    return R.exclude_http_errors(shots(spark, d), results(spark, d))[0].select("pos", "page")


@query("f12_http_error_list", f"WITH {SHOTS} SELECT status, url FROM res WHERE status <> 200")
def _(spark, d):
    return R.exclude_http_errors(shots(spark, d), results(spark, d))[1]


PRICES = "price AS (SELECT * FROM (VALUES ('alpha', 1.0, 5.0), ('claude', 3.0, 15.0)) t(model, price_in, price_out))"


def prices(spark):
    return spark.createDataFrame([("alpha", 1.0, 5.0), ("claude", 3.0, 15.0)], "model string, price_in double, price_out double")


@query("f13_model_usage", f"WITH {REC}, {PRICES}, b AS (SELECT r.model, count(*) AS requests, count(*) FILTER (WHERE error IS NULL) AS ok, count(*) FILTER (WHERE error IS NOT NULL) AS failed, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, avg(seconds) FILTER (WHERE error IS NULL AND seconds > 0) AS mean_seconds, sum((tokens_in * price_in + tokens_out * price_out) / 1e6 * CASE WHEN batched THEN 0.5 ELSE 1.0 END) AS cost FROM rec r LEFT JOIN price p ON p.model = r.model GROUP BY r.model), f AS (SELECT model, count(*) AS findings, count(DISTINCT (file, slice)) AS slices_with_findings FROM found GROUP BY model) SELECT b.model, requests, ok, failed, tokens_in, tokens_out, round(mean_seconds, 6) AS mean_seconds, round(CAST(cost AS DOUBLE), 4) AS cost, findings, slices_with_findings FROM b JOIN f ON f.model = b.model")
def _(spark, d):
    return R.model_usage(records(spark, d), found(spark, d), prices(spark)).withColumns({"mean_seconds": F.round("mean_seconds", 6), "cost": F.round("cost", 4)})


@query("f14_estimate_cost", f"WITH {SLICED}, {PRICES}, tt AS (SELECT count(*) AS n, CAST(sum(floor(1024 * (y1 - y0) / 750.0) + 900) AS BIGINT) AS tokens_in FROM sl) SELECT model, n, tokens_in, round(CAST(tokens_in * price_in / 1e6 + n * 350 * price_out / 1e6 AS DOUBLE), 4) AS cost FROM price, tt")
def _(spark, d):
    s = R.plan_slices(images(spark, d), 3).select(F.lit(1024).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    return R.estimate_cost(s, prices(spark)).withColumn("cost", F.round("cost", 4))


@query("f15_agreement", f"WITH {REC}, a AS (SELECT DISTINCT device, file, slice, type FROM found WHERE model = 'alpha'), saw AS (SELECT DISTINCT file, slice FROM found WHERE model = 'claude'), same AS (SELECT DISTINCT file, slice, type FROM found WHERE model = 'claude'), r AS (SELECT a.*, s.file IS NOT NULL AS saw, m.file IS NOT NULL AS same FROM a LEFT JOIN saw s ON s.file = a.file AND s.slice = a.slice LEFT JOIN same m ON m.file = a.file AND m.slice = a.slice AND m.type = a.type) SELECT device, type, count(*) AS main, count(*) FILTER (WHERE saw) AS sampled, count(*) FILTER (WHERE saw AND same) AS confirmed, CASE WHEN count(*) FILTER (WHERE saw) > 0 THEN count(*) FILTER (WHERE saw AND same) / count(*) FILTER (WHERE saw) END AS rate FROM r GROUP BY GROUPING SETS ((device, type), ())")
def _(spark, d):
    return R.agreement(records(spark, d), found(spark, d), "alpha", "claude")


@query("f16_confusion", f"WITH {REC}, p AS (SELECT file, bool_or(type = 'overflow' AND severity = 'high') AS hit FROM found GROUP BY file), t AS (SELECT o_orderkey AS file, o_totalprice > 150000 AS flag FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT count(*) FILTER (WHERE hit AND flag) AS tp, count(*) FILTER (WHERE hit AND NOT flag) AS fp, count(*) FILTER (WHERE NOT hit AND flag) AS fn FROM p JOIN t ON t.file = p.file) SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c")
def _(spark, d):
    truth = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("file"), (F.col("o_totalprice") > 150000).alias("flag"))
    return R.confusion(found(spark, d).select("file", ((F.col("type") == "overflow") & (F.col("severity") == "high")).alias("hit")), truth)


@query("f17_evidence", f"WITH {REC}, o AS (SELECT model, file, slice, sample, row_number() OVER (PARTITION BY model ORDER BY file, slice, sample) AS rn FROM found WHERE type = 'overlap') SELECT model, file, slice, sample FROM o WHERE rn <= 40")
def _(spark, d):
    return R.evidence(found(spark, d), "overlap")


@query("f19_limit_pages", f"WITH {SHOTS}, p AS (SELECT page FROM shots GROUP BY page ORDER BY min(pos), page LIMIT 30) SELECT pos, page, device FROM shots WHERE page IN (SELECT page FROM p)")
def _(spark, d):
    return R.limit_pages(shots(spark, d), 30).select("pos", "page", "device")


SPLIT = "rel AS (SELECT file, slice, type, count(DISTINCT model) >= 2 AS certain FROM found WHERE type IN ('mojibake', 'overlap', 'missing_data', 'broken_image') GROUP BY ALL)"


@query("h1_reliable_split", f"WITH {REC}, {SPLIT} SELECT * FROM rel")
def _(spark, d):
    return R.reliable_split(found(spark, d))


@query("h2_page_defects", f"WITH {REC}, {SPLIT}, c AS (SELECT file // 4 AS page, type, CASE WHEN file % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, slice FROM rel WHERE certain) SELECT page, type, array_to_string(list_sort(list(DISTINCT device)), ',') AS devices, count(DISTINCT (device, slice)) AS n_slices FROM c GROUP BY ALL")
def _(spark, d):
    rows = R.reliable_split(found(spark, d)).where("certain").select(F.expr("file div 4").alias("page"), "type", F.when(F.col("file") % 2 == 0, "desktop").otherwise("mobile").alias("device"), "slice")
    return R.page_defects(rows)


FLAGS = "fl AS (SELECT o_orderkey AS file, 't' || o_custkey % 30 AS template, CASE WHEN o_orderkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, CASE WHEN o_orderkey % 5 = 0 THEN 'TASMA(+' || o_custkey % 700 || 'px)' WHEN o_orderkey % 5 = 1 THEN 'DAR(-3px)' ELSE '' END AS flag FROM orders)"


def flagged(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("file"), F.concat(F.lit("t"), F.col("o_custkey") % 30).alias("template"), F.when(k % 2 == 0, "desktop").otherwise("mobile").alias("device"), F.when(k % 5 == 0, F.concat(F.lit("TASMA(+"), F.col("o_custkey") % 700, F.lit("px)"))).when(k % 5 == 1, "DAR(-3px)").otherwise("").alias("flag"))


@query("h3_overflow_px", f"WITH {FLAGS} SELECT file, CAST(regexp_extract(flag, '([0-9]+)px', 1) AS INT) AS px FROM fl WHERE starts_with(flag, 'TASMA') ORDER BY px DESC, file LIMIT 20")
def _(spark, d):
    return R.overflow_px(flagged(spark, d))


@query("h4_overflow_by_template", f"WITH {FLAGS} SELECT template, device, count(*) AS n FROM fl WHERE starts_with(flag, 'TASMA') GROUP BY ALL ORDER BY n DESC, template, device LIMIT 20")
def _(spark, d):
    return R.overflow_by_template(flagged(spark, d))


@query("h4_overflow_by_device", f"WITH {FLAGS} SELECT device, count(*) AS n FROM fl WHERE starts_with(flag, 'TASMA') GROUP BY device")
def _(spark, d):
    return R.overflow_by_device(flagged(spark, d))


@query("f13_model_types", f"WITH {REC} SELECT model, type, count(*) AS n FROM found GROUP BY ALL")
def _(spark, d):
    return R.model_types(found(spark, d))


@query("h5_all_totals", f"""WITH {REC}, {SPLIT}, {FLAGS} SELECT (SELECT count(*) FROM fl) AS images, (SELECT count(DISTINCT template) FROM fl) AS pages, (SELECT count(*) FROM fl WHERE starts_with(flag, 'TASMA')) AS overflow, (SELECT count(DISTINCT url) FROM pages WHERE length(html) % 7 = 0) AS http_pages,
    (SELECT count(DISTINCT page_id) FROM pages WHERE contains(html, '&')) AS text_pages, (SELECT count(DISTINCT (file, type)) FROM rel WHERE certain) AS page_defects, (SELECT count(*) FROM rel WHERE certain) AS certain""")
def _(spark, d):
    pages = table(spark, d, "pages")
    http = pages.select("url", F.when(F.length("html") % 7 == 0, 404).otherwise(200).alias("status"))
    texts = pages.select(F.col("page_id").alias("url"), F.regexp_count("html", F.lit("&")).alias("n"))
    return R.report_totals(flagged(spark, d).withColumnRenamed("template", "page"), R.reliable_split(found(spark, d)).withColumnRenamed("file", "page"), http, texts)


@query("h5_report_totals", f"WITH {REC}, {SPLIT}, {FLAGS} SELECT (SELECT count(*) FROM fl) AS images, (SELECT count(DISTINCT template) FROM fl) AS pages, (SELECT count(*) FROM fl WHERE starts_with(flag, 'TASMA')) AS overflow, (SELECT count(*) FROM rel WHERE certain) AS certain")
def _(spark, d):
    f = flagged(spark, d).agg(F.count("*").alias("images"), F.count_distinct("template").alias("pages"), F.count_if(F.col("flag").startswith("TASMA")).alias("overflow"))
    return f.crossJoin(R.reliable_split(found(spark, d)).agg(F.count_if("certain").alias("certain")))  # one row each


@query("h6_type_counts", f"WITH {REC}, o AS (SELECT file, slice, type, count(DISTINCT model) AS m FROM found GROUP BY ALL) SELECT type, type IN ('mojibake', 'overlap') AS reliable, count(*) AS n, count(*) FILTER (WHERE m = 1) AS single FROM o GROUP BY ALL")
def _(spark, d):
    return R.type_counts(found(spark, d))


@query("h7_flag_totals", f"WITH {FLAGS} SELECT split_part(flag, '(', 1) AS name, count(DISTINCT template) AS n_pages, count(*) AS n FROM fl WHERE flag <> '' GROUP BY 1")
def _(spark, d):
    return R.flag_totals(flagged(spark, d).withColumnRenamed("template", "page"))


_ = T
