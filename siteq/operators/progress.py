"""Progress logs: counters, problems, monotone ratios and time estimates (M), as columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.functions.urls import any_of

# Patterns of counters and whether the second number is a queue; patterns of errors and warnings.
COUNTERS = ((r"\bbiten(?:_kod)?=(\d+)\s+toplam(?:_kod)?=(\d+)", False), (r"\[(\d+)\s*/\s*(\d+)\]", False), (r"\b(\d+) sayfa \| kuyruk (\d+)\b", True), (r"^\s+(\d+)\s*/\s*(\d+)(?:\s|$)", False))
ERRORS = (r"Traceback \(most recent call last\)", r"^\s*[\w.]*(?:Error|Exception)(?::|$)", r"\[HATA\]|^\s*HATA\s*:|❌|⛔|✖", r"\blevel=ERROR\b", r"(?i)^(?:error|fatal|panic)\b[:\s]", r"(?i)\bno space left on device\b")
WARNINGS = (r"\[!\]|\bUYARI\b|\bUyarı\b|⚠", r"\blevel=WARN\b", r"\bWARNING\b|\bWarning:", r"\[\d+/\d+\]\s+ERROR\b")


def progress(line: Column) -> Column:
    """(done, total) of the first counter in a line that makes sense, else null."""
    tries = []
    for pattern, queue in COUNTERS:
        a, b = (F.regexp_extract(line, pattern, k).try_cast("long") for k in (1, 2))
        total = a + b if queue else b
        tries.append(F.when((total > 0) & (a <= total), F.struct(a.alias("done"), total.alias("total"))))
    return F.coalesce(*tries)


def problem(line: Column) -> Column:
    """hata, uyari or null."""
    blank = F.trim(line) == ""
    return F.when(blank, F.lit(None).cast("string")).when(any_of(line.rlike(p) for p in ERRORS), "hata").when(any_of(line.rlike(p) for p in WARNINGS), "uyari")


def monotone(df: DataFrame, part: str, order: list[str], ratio: str = "ratio") -> DataFrame:
    """Adds top: the running maximum of the ratio."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("top", F.max(ratio).over(w))


def eta(df: DataFrame, part: str, ts: str, window_s: int = 600) -> DataFrame:
    """Adds remaining seconds after each observation (ts in seconds, ratio, skip).

    Work is the sum of increases that aren't skips; speed is work over the last window, from the observation at or just
    before its start. Null with under five seconds or no work.
    """
    order = Window.partitionBy(part).orderBy(ts)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("top", F.greatest(F.max("ratio").over(upto), F.lit(0.0)))
    rows = rows.withColumn("gain", F.when(F.col("skip"), 0.0).otherwise(F.col("top") - F.coalesce(F.lag("top").over(order), F.lit(0.0))))
    rows = rows.withColumn("worked", F.sum("gain").over(upto))
    seen = Window.partitionBy(part).orderBy(ts)
    before = seen.rangeBetween(Window.unboundedPreceding, -window_s)
    inside = seen.rangeBetween(-window_s, 0)
    point = F.struct(F.col(ts).alias("t"), F.col("worked").alias("w"))
    rows = rows.withColumn("anchor", F.coalesce(F.max(point).over(before), F.min(point).over(inside)))
    passed, done = F.col(ts) - F.col("anchor.t"), F.col("worked") - F.col("anchor.w")
    return rows.withColumn("remaining", F.when((passed >= 5) & (done > 0), (1 - F.col("top")) * passed / done)).drop("anchor", "gain")


def linear_eta(df: DataFrame) -> DataFrame:
    """Per run the last counters and elapsed / done * (total - done)."""
    rows = df.groupBy("run_id").agg(F.max("done").alias("done"), F.max("total").alias("total"), F.max("elapsed").alias("elapsed"), F.sum("errors").alias("errors"))
    return rows.withColumn("remaining", F.try_divide(F.col("elapsed"), F.col("done")) * (F.col("total") - F.col("done")))


def stage_status(coverage: DataFrame) -> DataFrame:
    """Whether the first model and the arbiter are complete, by coverage rows (role, untried, quota, failed)."""
    open_ = (F.col("untried") > 0) | (F.col("quota") > 0) | ((F.col("role") == "arbiter") & (F.col("failed") > 0))
    return coverage.groupBy("role").agg((~F.bool_or(open_)).alias("complete"))


def kpis(pages: DataFrame, tested: DataFrame, broken_links: DataFrame, documents: DataFrame, defects: DataFrame, certain: DataFrame) -> DataFrame:
    """One row of headline numbers; every part is one row before they are put side by side."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(pages, "map_size"), tested.agg(F.count_distinct("url").alias("tested"), F.count_if(F.col("status") >= 400).alias("broken_pages")), count(broken_links, "broken_links"), count(documents, "problem_documents"), count(defects, "visual_defects"), count(certain, "certain_findings")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out.withColumn("coverage", F.try_divide(F.col("tested").cast("double"), F.col("map_size").cast("double")))
