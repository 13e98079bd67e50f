"""Fill-in-the-middle: each text is cut in three by one match of a pattern made for its row, and put together in another order.

regexp_count gives the number n of units of a text. Two of four numbers that depend on the row's id alone choose places a <= b among the
n + 1 between units; the pattern `\\A(unit{a}+)(unit{b-a}+)(.*+)\\z` then captures prefix, middle and suffix, and the replacement that goes with the
row's form writes them between sentinels in the same match. Counted possessive quantifiers neither back up nor recurse, so a text of any
length takes one pass and constant stack. Each text is handled within its row: no shuffle, no Python.

A text that already holds a sentinel stays as it is, and sentinels cannot run into each other or into text: none holds another one or, after its
start, another one's first character. So the first occurrence of each is the one that was written, and a second pattern restores the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import plain, table

#: One code point.
UNIT = r"(?s:.)"
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units that are counted as one match first, so that no array of single units of a long text is made.
BLOCK = 4096


def count_units(text: Column, unit: str = UNIT) -> Column:
    """Number of matches of unit in the text, which they have to fill: those of whole blocks, and of what follows the last one."""
    block = f"(?:{unit}){{{BLOCK}}}+"
    rest = F.regexp_replace(text, rf"\A(?:{block})*+", "")
    return F.regexp_count(text, F.lit(block)).cast("bigint") * BLOCK + F.regexp_count(rest, F.lit(unit))


def row_numbers(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers, the start of sha256 of seed:doc_id. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    firsts = {s[:1] for s in sentinels}
    inside = any(a != b and a in b for a in sentinels for b in sentinels)
    if len(set(sentinels)) < 3 or "" in sentinels or inside or any(c in firsts for s in sentinels for c in s[1:]):
        raise ValueError("sentinels must differ, and none may hold another one or, after its start, another one's first character")
    return sentinels


def _literal(text: str) -> str:
    """text in a replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def fill_middle(
    docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, unit: str = UNIT
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of docs.

    Takes doc_id and text; a null text is empty. n counts units, as do prefix_chars and middle_chars, which are null where form is plain: for an empty text,
    one that holds a sentinel, and plain_percent of the others. spm_percent of the rest have form spm (suffix, prefix, middle), the others psm.
    unit is a pattern without groups whose matches fill any text, one after the other. What happens to a row depends on seed, its id and its text only, so rows
    that share an id share the choice, and repeated rows give equal rows; an empty table gives none. Other columns are ignored.
    """
    p, s, m = _checked(sentinels)
    h1, h2, h3, h4 = row_numbers(F.col("doc_id"), seed)
    rows = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n", count_units(F.col("text"), unit))
    held = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | held | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = F.col("form") != "plain"
    rows = rows.withColumn("form", form).withColumns({"prefix_chars": F.when(cut, F.least(x, y)), "middle_chars": F.when(cut, F.greatest(x, y) - F.least(x, y))})
    piece = lambda name: F.concat(F.lit(f"((?:{unit}){{"), F.col(name).cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), piece("prefix_chars"), piece("middle_chars"), F.lit(r"((?s:.*+))\z"))
    psm, spm = _literal(p) + "$1" + _literal(s) + "$3" + _literal(m) + "$2", _literal(s) + "$3" + _literal(p) + "$1" + _literal(m) + "$2"
    output = F.when(cut, F.regexp_replace("text", pattern, F.when(F.col("form") == "spm", spm).otherwise(psm))).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of fill_middle was made of."""
    p, s, m = (re.escape(x) for x in _checked(sentinels))
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill_middle of all documents, with digests of the output and of the text restored from it in place of the output."""
    rows = fill_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS u, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS v FROM d),
f AS (SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
