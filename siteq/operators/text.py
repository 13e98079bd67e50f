"""Text audits (G) and text columns of curricula (K1, K5, K20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteq.operators.tables import computed

# Letters, patterns of damage, what makes a word an address.
LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü"
PATTERNS = {
    "soru_isareti": rf"(?<=[{LETTERS}])\?(?=[{LETTERS}])|(?<![{LETTERS}?])\?(?=[A-ZÇĞİÖŞÜ]{{2,}})",
    "html_kodu": r"&(?:#\d{2,5}|#x[0-9a-fA-F]{2,4}|amp|quot|lt|gt|nbsp|apos);",
    "mojibake": "[ÃÄÅÂ][\x80-\xbfŒ-Ÿˆ-›]",
    "yer_tutucu": "�",
    "html_etiketi": r"(?i)</?(?:span|div|p|br|strong|em|b|i|a|ul|li|table|td|tr|font)\b[^<>]{0,300}>|<(?:span|div|p|a|font|table|td|img)\s+(?:class|style|href|id|src|align)\s*=",
}
ADDRESS = r"https?:|www\.|\.(?:aspx|php|html?|jsp|asp)\b|[=&/\\]"


def text_patterns(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pattern, n): hits of each pattern. Question marks in words that look like addresses don't count."""
    words = F.filter(F.split(text, r"[\s ]+"), lambda w: w.contains("?") & ~w.rlike(ADDRESS))
    cleaned = F.array_join(words, "\n")
    counts = F.array(*(F.struct(F.lit(name).alias("pattern"), F.regexp_count(cleaned if name == "soru_isareti" else F.col(text), F.lit(p)).cast("long").alias("n")) for name, p in PATTERNS.items()))
    return df.select(key, F.inline(F.filter(counts, lambda c: c["n"] > 0)))


def text_pattern_samples(df: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """(key, samples): the first three different hits with 25 characters on either side. Contexts may overlap."""
    whole = F.coalesce(F.col(text), F.lit(""))
    some = df.select(key, whole.alias("_t")).where(F.col("_t").rlike(PATTERNS[pattern]))
    # worked out once a row, for a step looks at a few places of them: hits, what is between them, and the ends of that
    some = computed(some, _hits=F.regexp_extract_all("_t", F.lit(PATTERNS[pattern]), F.lit(0)), _gaps=F.split("_t", PATTERNS[pattern], -1))
    some = computed(some, _heads=F.transform("_gaps", lambda g: F.left(g, F.lit(25))), _tails=F.transform("_gaps", lambda g: F.right(g, F.lit(25)))).drop("_gaps", "_t")
    zero = F.struct(F.lit("").alias("before"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, k: Column) -> Column:
        hit, before = F.get("_hits", k), F.right(F.concat(acc["before"], F.get("_tails", k)), F.lit(25))
        # a hit has a character at least, so 25 more hits and the gaps between reach as far as a context
        after = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(26)), lambda j: F.concat(F.get("_heads", k + j), F.coalesce(F.get("_hits", k + j), F.lit("")))), "")
        context = F.trim(F.replace(F.concat(before, hit, F.left(after, F.lit(25))), F.lit("\n"), F.lit(" ")))
        return F.struct(F.right(F.concat(before, hit), F.lit(25)).alias("before"), F.array_union(acc["found"], F.array(context)).alias("found"))

    go = lambda acc, k: F.when(F.size(acc["found"]) >= 3, acc).otherwise(step(acc, k))
    return some.select(key, F.aggregate(F.sequence(F.lit(0), F.size("_hits") - 1), zero, go, lambda acc: acc["found"]).alias("samples"))


def pattern_by_lang(found: DataFrame) -> DataFrame:
    return found.groupBy("pattern", "lang").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_hits"))


def text_report(pages: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A row for each hit, and one with 0 for pages without any."""
    return pages.select(key).join(found, key, "left").select(key, F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("n", F.lit(0)).alias("n"))


# Letters and what they fold to.
FOLD = ("ıIİîÎşŞğĞüÜûÛöÖçÇâÂ ", "iiiiissgguuuuooccaa ")


def clean(text: Column) -> Column:
    """One line with single spaces."""
    return F.trim(F.regexp_replace(text, r"[\s \u0085 -     　]+", " "))


def norm(text: Column) -> Column:
    """Folded for comparison: Turkish letters to ASCII, lower case, single spaces."""
    return clean(F.lower(F.translate(text, *FOLD)))


def clean_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), clean), lambda s: s != ""), "\n")


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")


def first_float(text: Column) -> Column:
    return F.replace(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def ordinal_no(text: Column) -> Column:
    """The number of a cell such as 1, 1., PÇ1 or ÖÇ 3."""
    return F.regexp_extract(clean(text), r"^[^0-9]{0,6}?([0-9]{1,3})\s*[.):]?$", 1).try_cast("int")


def split_tul(text: Column) -> Column:
    """(t, u, l) of 3+2+0; nulls without a plus."""
    parts = F.split(text, "[+]")
    some = F.size(parts) >= 2
    at = lambda k: F.when(some, first_int(F.get(parts, F.lit(k))))
    return F.struct(at(0).alias("t"), at(1).alias("u"), at(2).alias("l"))


def extract_ids(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, id): numbers of curUnit, curSunit and curCourse in a text, and .aspx links."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(rf"(?i){k}=(\d+)"), F.lit(1)).alias("ids")) for k in ("curUnit", "curSunit", "curCourse")), F.struct(F.lit("aspx").alias("kind"), F.regexp_extract_all(text, F.lit(r"""([^\s"'<>]+\.aspx[^\s"'<>]*)"""), F.lit(1)).alias("ids")))
    return df.select(key, F.inline(found)).select(key, "kind", F.explode("ids").alias("id"))
