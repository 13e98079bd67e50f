"""Quality rules with thresholds that follow the data, with DataFrame operations only.

Each text is measured within its row: words, symbols, repeated lines, words in repeated three-word windows. The values of
each measure go into a quantile sketch for each language and source: counts of logarithmic buckets, so a value is known to
half a percent and two sketches merge by adding counts. That is exact in any order, hence the sketches are plain grouped counts that combine
before the shuffle, however many documents one source has, and reruns agree. A rollup merges them to languages and to the whole table. The
quartiles of a sketch give each measure its fence, a number of quartile distances from the quartiles; groups with too few documents take
the fence of their language, or of all. The documents' measures, written once, are then joined with the fences of their group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.llm.common import plain, table, written

SPACE = r"[\x20\x09-\x0D]"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Ratio of two buckets' bounds, and parts that a measure is counted in.
GAMMA, PARTS = 1.01, 1_000_000
#: Measures: what is divided by what, the least quartile distance in parts, and whether low values are judged, too.
MEASURES = {
    "word_length": ("word_chars", "n_words", 50_000, True),
    "symbols": ("n_symbols", "n_words", 30_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100_000, False),
    "repeats": ("n_repeat_words", "n_words", 70_000, False),
}
#: Quartile distances from a quartile to its fence; documents that a group needs for a fence of its own.
REACH, LEAST_DOCS = 6, 100
#: Fewest words, and the largest share of words in repeated windows in percent, of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Number of words in windows of n words that come twice or more, the first included.

    Windows are compared by 64-bit hash, within a text only. Texts without a repeated one are done with a hash set; in others the windows are sorted
    to find those with an equal neighbour, and each adds the words that the one before it does not cover.
    """
    zipped = F.arrays_zip(words, *(F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(1, n)))
    windows = F.slice(F.transform(zipped, lambda x: F.xxhash64(x)), 1, F.size(words) - n + 1)
    ordered = lambda h: F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("at"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = lambda s: F.filter(F.transform(s, lambda x, k: F.when(same(s, x, k + 1) | same(s, x, k - 1), x["at"])), lambda at: at.isNotNull())
    start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
    grow = lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(n), at - acc["last"])).alias("sum"))
    covered = lambda s: F.aggregate(F.sort_array(twice(s)), start, grow, lambda acc: acc["sum"])
    counted = _bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(ordered(h), covered)))
    return F.when(F.size(words) >= n, counted).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed), a row for each row of docs.

    Takes doc_id, text, lang and source. Words are runs without white space, lines end at \\n and count if they hold a word; a null text has none.
    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in repeated windows. Other columns are ignored.
    """
    text, long = F.col("text"), lambda c: c.cast("bigint")
    rows = plain(docs, "doc_id", "lang", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    without = lambda letters: F.length(F.regexp_replace(text, letters, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = _bound(F.array_remove(F.split(text, f"{SPACE}+", -1), ""), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    dup = _bound(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = rows.select("doc_id", "lang", "source", long(without(f"{SPACE}+")).alias("word_chars"), long(without(f"[^{SYMBOLS}]+")).alias("n_symbols"), counts.alias("w"), dup.alias("l"))
    out = rows.select("doc_id", "lang", "source", long(F.col("w.n_words")).alias("n_words"), "word_chars", "n_symbols", long(F.col("l.n_lines")).alias("n_lines"), long(F.col("l.n_dup_lines")).alias("n_dup_lines"), long(F.col("w.n_repeat_words")).alias("n_repeat_words"))
    return out.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def _parts(name: str) -> str:
    """A measure in parts, null without a word."""
    over, under, *_ = MEASURES[name]
    return f"CASE WHEN n_words > 0 THEN ({PARTS}L * {over}) div {under} END"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): a quantile sketch of each measure for each language and source, of all documents with a word.

    Bucket b counts the values above GAMMA^(b-1) parts and up to GAMMA^b, and bucket -1 the zeros. Nulls are a language or source of their own.
    """
    values = measured.where("n_words > 0").select("lang", "source", F.expr("stack({}, {}) AS (measure, value)".format(len(MEASURES), ", ".join(f"'{m}', {_parts(m)}" for m in MEASURES))))
    bucket = F.when(F.col("value") == 0, -1).otherwise(F.ceil(F.log("value") / math.log(GAMMA))).cast("int")
    return values.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """The sketches of sources (level 0), and those of languages (1) and of the whole table (3) that they merge to; the columns above a level are null."""
    sets = sketch.groupingSets([[F.col(c) for c in keys] for keys in (("lang", "source", "measure", "bucket"), ("lang", "measure", "bucket"), ("measure", "bucket"))], "lang", "source", "measure", "bucket")
    level = F.grouping_id("lang", "source", "measure", "bucket")
    return sets.agg(F.sum("n").alias("n"), level.alias("g")).withColumn("level", F.expr("CAST(g div 4 AS INT)")).drop("g")


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, measure, docs, q1, q3) of merged sketches: the middles of the buckets that hold the first and the third quartile."""
    keys = ("level", "lang", "source", "measure")
    w = Window.partitionBy(*keys)  # the buckets of a sketch, some thousands at most
    value = F.when(F.col("bucket") >= 0, F.floor(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))).otherwise(0)
    rows = sketch.withColumns({"value": value, "upto": F.sum("n").over(w.orderBy("bucket")), "docs": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.expr(f"4 * upto >= {q} * docs"), F.col("value"))).alias(f"q{q}")
    return rows.groupBy(*keys).agg(F.max("docs").alias("docs"), at(1), at(3))


def fences(sketch: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, level, and low_ and high_ of each measure) for each language and source: a document passes from low to high.

    A fence is `reach` quartile distances from the quartile, each at least the measure's least one; low is null where only high values are judged.
    level tells whose sketch they are of: 0 the group's own, 1 its language's, 3 all documents', the first that has least_docs documents.
    """
    q = quartiles(merged(sketch))
    low, high = ([F.when(F.col("measure") == m, F.expr(f"{end} greatest(q3 - q1, {least}L)")) for m, (_, _, least, both) in MEASURES.items() if both or sign > 0] for sign, end in ((-1, f"q1 - {reach} *"), (1, f"q3 + {reach} *")))
    q = q.select("level", "lang", "source", "measure", "docs", F.coalesce(*low).alias("low"), F.coalesce(*high).alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    wide = q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), F.struct(*(pick(m, c).alias(f"{c}_{m}") for m in MEASURES for c in ("low", "high"))).alias("f"))
    own = wide.where("level = 0").select("lang", "source", "docs", "f")
    lang = wide.where("level = 1").select(F.col("lang").alias("_l"), F.col("docs").alias("lang_docs"), F.col("f").alias("lang_f"))
    whole = wide.where("level = 3").select(F.col("f").alias("all_f"))  # one row
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(whole))
    level = F.when(F.col("docs") >= least_docs, 0).when(F.col("lang_docs") >= least_docs, 1).otherwise(3)
    rows = rows.withColumn("level", level).withColumn("f", F.when(F.col("level") == 0, F.col("f")).when(F.col("level") == 1, F.col("lang_f")).otherwise(F.col("all_f")))
    return rows.select("lang", "source", "level", "f.*")


def judge(measured: DataFrame, fence: DataFrame) -> DataFrame:
    """measured with kept, and failed, the names of the measures outside of their fences. Documents of a group without fences have no word and fail the base rules."""
    fence = fence.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(c for c in fence.columns if c.startswith(("low_", "high_"))))
    # a hot source is split by adaptive execution, where the fences are too many to broadcast by their measured size
    rows = measured.join(fence, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside = lambda m: F.expr(f"coalesce({_parts(m)} > high_{m}, false) OR coalesce({_parts(m)} < low_{m}, false)")
    failed = F.filter(F.array(*(F.when(outside(m), F.lit(m)) for m in MEASURES)), lambda x: x.isNotNull())
    rows = rows.withColumn("failed", failed).withColumn("kept", F.expr("NOT base_failed AND size(failed) = 0"))
    return rows.select(*measured.columns, "failed", "kept")


def apply_rules(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """measure and judge of docs, whose measures are written to the shared folder once.

    Null languages and sources are groups, repeated rows count as often as they come, an empty table gives no rows, a text of any length is measured whole.
    """
    measured = written(measure(docs))
    fence = written(fences(sketches(measured), reach, least_docs))  # a row for each language and source
    return judge(measured, fence)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of all documents."""
    rows = apply_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PARTS_SQL = {m: f"({PARTS}::BIGINT * {over}) // {under}" for m, (over, under, *_) in MEASURES.items()}
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: sha256(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS g FROM w WHERE len(words) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p),
t AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS b FROM g WHERE c > 1),
rep AS (SELECT r, sum(least(3, coalesce(i - b, 3)))::BIGINT AS n FROM t GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.r = rep.r),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {x} AS value FROM b WHERE n_words > 0" for m, x in _PARTS_SQL.items())}),
s AS (SELECT lang, source, measure, CASE WHEN value = 0 THEN -1 ELSE ceil(ln(value) / {math.log(GAMMA)!r}) END::INT AS bucket, count(*) AS n FROM v GROUP BY ALL),
l AS (SELECT 0 AS level, * FROM s UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM s GROUP BY lang, measure, bucket UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(n) FROM s GROUP BY measure, bucket),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS docs,
        CASE WHEN bucket < 0 THEN 0 ELSE floor(2 * pow({GAMMA}, bucket) / ({GAMMA} + 1)) END::BIGINT AS value FROM l),
q AS (SELECT level, lang, source, measure, max(docs) AS docs, min(value) FILTER (4 * upto >= docs) AS q1, min(value) FILTER (4 * upto >= 3 * docs) AS q3 FROM c GROUP BY ALL),
f AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.docs >= {LEAST_DOCS} THEN [o.q1, o.q3] WHEN g.docs >= {LEAST_DOCS} THEN [g.q1, g.q3] ELSE [a.q1, a.q3] END AS q
      FROM q o JOIN q g ON g.level = 1 AND o.measure = g.measure AND o.lang IS NOT DISTINCT FROM g.lang JOIN q a ON a.level = 3 AND a.measure = o.measure WHERE o.level = 0),
e AS (SELECT lang, source, {", ".join(f"max(q[1]) FILTER (measure = '{m}') AS a_{m}, max(q[2]) FILTER (measure = '{m}') AS z_{m}" for m in MEASURES)} FROM f GROUP BY lang, source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {" AND ".join(f"{_PARTS_SQL[m]} <= z_{m} + {REACH} * greatest(z_{m} - a_{m}, {least})" + (f" AND {_PARTS_SQL[m]} >= a_{m} - {REACH} * greatest(z_{m} - a_{m}, {least})" if both else "") for m, (_, _, least, both) in MEASURES.items())} END AS kept
FROM b LEFT JOIN e ON b.lang IS NOT DISTINCT FROM e.lang AND b.source IS NOT DISTINCT FROM e.source
"""
