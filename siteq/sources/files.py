"""File sources: URL lists in five JSON layouts (B1), logs of JSON lines (C1), CSV with a sniffed delimiter (M8), page bytes of unknown charset (K19)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def url_list(texts: DataFrame, col: str = "value") -> DataFrame:
    """(url, pos) of JSON texts: {url_list}, {pages: {url: ...}}, {urls}, a list of strings or a list of {url}."""
    t = F.col(col)
    strings = lambda path: F.from_json(F.get_json_object(t, path), "array<string>")
    objects = F.transform(F.from_json(t, "array<struct<url: string>>"), lambda x: x["url"])
    plain = F.from_json(t, "array<string>")
    listed = F.when(F.trim(t).startswith("["), F.when(F.exists(objects, lambda u: u.isNotNull()), objects).otherwise(plain))
    mapped = F.map_keys(F.from_json(F.get_json_object(t, "$.pages"), "map<string, string>"))
    urls = F.coalesce(strings("$.url_list"), mapped, strings("$.urls"), listed)
    return texts.select(F.posexplode(urls).alias("pos", "url")).where("url IS NOT NULL").select("url", "pos")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url_list of whole files."""
    return url_list(spark.read.text(path, wholetext=True))


def read_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header whose first line has more `;` than `,`, or the other way round; a byte order mark is dropped."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    df = spark.read.option("header", True).option("sep", ";" if line.count(";") > line.count(",") else ",").option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def read_results(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a log of JSON lines (C1): the schema's columns, and the lines that are no JSON object or do not fit it, as value.

    Both have file, block and line: the file, the byte at which the part of it starts that one task reads, and the line's number in that part, from 0. Blank lines are
    neither. A log that is cut off in its last line loses that line only. A record's missing fields are null.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    first = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"))
    broken = StructType([*schema.fields, StructField("_broken", StringType())])
    rows = lines.withColumn("_r", F.from_json("value", broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).where(F.trim("value") != "")
    rows = rows.join(first, ["file", "block"]).withColumn("line", F.col("_id") - F.col("_first"))
    bad = F.col("_r").isNull() | F.col("_r._broken").isNotNull() | ~F.trim("value").startswith("{")
    return rows.where(~bad).select("file", "block", "line", *(F.col(f"_r.{c}").alias(c) for c in schema.names)), rows.where(bad).select("file", "block", "line", "value")


CHARSET = r"""(?i)charset=["']?([A-Za-z0-9_-]+)"""


def decode_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds text: bytes by the declared charset (first 2,048 bytes), else as UTF-8 if valid, else as windows-1254."""
    head = F.regexp_extract(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"), CHARSET, 1)

    @F.pandas_udf("string")
    def by_name(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raw, name in parts:
            out = []
            for b, n in zip(raw, name, strict=True):
                try:
                    out.append(None if b is None else bytes(b).decode(n or "cp1254", "replace"))
                except LookupError:
                    out.append(bytes(b).decode("cp1254", "replace"))
            yield pd.Series(out)

    valid = F.is_valid_utf8(F.col(content).cast("string"))
    utf8 = F.lower(head).isin("utf-8", "utf8") | ((head == "") & valid)
    return files.withColumn("_n", head).withColumn("text", F.when(utf8 & valid, F.col(content).cast("string")).otherwise(by_name(F.col(content), F.col("_n")))).drop("_n")


__all__ = ["decode_pages", "read_csv_auto", "read_results", "read_url_list", "url_list"]
