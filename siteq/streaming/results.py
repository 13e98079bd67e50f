"""Streams: the latest row of each key as keyed state with a log of changes, and time estimates in event-time order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def log_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int | None = None) -> DataFrame:
    """Appended JSON lines as a stream; lines that are no record are dropped, which `siteq.sources.files.read_results` lists."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(path)


def results_stream(spark: SparkSession, path: str, schema: StructType, late: str = "1 hour", files_a_batch: int | None = None) -> DataFrame:
    """log_stream without exact repeats within the watermark. The event time column is ts."""
    return log_stream(spark, path, schema, files_a_batch).withWatermark("ts", late).dropDuplicatesWithinWatermark([f.name for f in schema.fields])


def _order(order: list[str]):
    return F.struct(*order)


def latest_per_key(stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str):
    """Starts a query that logs the rows of a stream that become the last of their key, by `order`; `latest_table` reads the table that they make.

    The last row of each key is state, so a batch costs what it brings: it appends the keys that it changes as out/changes/batch=N. Once the log
    since the last snapshot has as many rows as that, the next snapshot is made of both, so snapshots cost no more than the log, over time. Exact repeats and rows that come
    late change nothing, and a batch that runs again overwrites what it wrote. Rows that tie in `order` are compared by their other columns.
    """
    rest = [c for c in stream.columns if c != key]
    last = F.max(F.struct(_order(order).alias("_o"), F.struct(*rest).alias("_r"))).alias("_x")
    changed = stream.groupBy(key).agg(last).select(key, *(F.col(f"_x._r.{c}").alias(c) for c in rest))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        upto, snapshot, changes = _parts(spark, out, batch.schema)
        if changes.count() >= (snapshot.count() if snapshot is not None else 1):  # counts of Parquet footers
            latest_table(spark, out, key, order, batch.schema).write.mode("overwrite").parquet(f"{out}/snapshots/upto={number}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, out: str, schema: StructType) -> tuple[int, DataFrame | None, DataFrame]:
    """The last snapshot's number, its rows, and the changes since."""
    plain = [f.name for f in schema.fields]
    try:
        snapshots = spark.read.schema(StructType([*schema.fields, StructField("upto", LongType())])).parquet(f"{out}/snapshots")
        upto = max((int(f.split("/upto=")[1].split("/")[0]) for f in snapshots.inputFiles()), default=-1)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        snapshots, upto = None, -1
    changes = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{out}/changes")
    return upto, snapshots.where(F.col("upto") == upto).select(*plain) if snapshots is not None else None, changes.where(F.col("batch") > upto).select(*plain)


def latest_table(spark: SparkSession, out: str, key: str, order: list[str], schema: StructType) -> DataFrame:
    """The last row of each key that a `latest_per_key` query has logged at `out`: the last snapshot and the changes since."""
    _, snapshot, changes = _parts(spark, out, schema)
    rows = snapshot.unionByName(changes) if snapshot is not None else changes
    rest = [f.name for f in schema.fields if f.name != key]
    last = rows.groupBy(key).agg(F.max(F.struct(_order(order).alias("_o"), F.struct(*rest).alias("_r"))).alias("_x"))
    return last.select(key, *(F.col(f"_x._r.{c}").alias(c) for c in rest)).select(*schema.names)


# What eta_stream keeps, as packed records: observations of the window, of which a run's last one has its counters, and rows that wait for the watermark.
SEEN = np.dtype([("run", "i8"), ("t", "f8"), ("top", "f8"), ("worked", "f8")])
HELD = np.dtype([("run", "i8"), ("t", "f8"), ("ratio", "f8"), ("skip", "?")])


def _runs(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each run of rows that are sorted by it, and its rows."""
    ends = np.append(np.flatnonzero(np.diff(rows["run"])) + 1, len(rows)) if len(rows) else []
    for a, b in zip([0, *ends], ends):
        yield int(rows["run"][a]), rows[a:b]


def _estimates(seen: np.ndarray, rows: np.ndarray, window_s: float) -> tuple[pd.DataFrame, np.ndarray]:
    """The estimates at rows that come after those seen, and what is seen then."""
    rows = rows[np.lexsort((rows["t"], rows["run"]))]
    first = np.flatnonzero(np.append(True, (np.diff(rows["run"]) != 0) | (np.diff(rows["t"]) != 0)))
    once = rows[first]
    once["ratio"], once["skip"] = np.fmax.reduceat(rows["ratio"], first), np.logical_or.reduceat(rows["skip"], first)
    known, remaining = dict(_runs(seen)), []
    for run, new in _runs(once):
        old = known.get(run, np.zeros(0, SEEN))
        top, worked = (old["top"][-1], old["worked"][-1]) if len(old) else (0.0, 0.0)
        tops = np.fmax.accumulate(np.append(top, new["ratio"]))
        points = np.empty(len(old) + len(new), SEEN)
        points[: len(old)], added = old, points[len(old) :]
        added["run"], added["t"], added["top"] = run, new["t"], tops[1:]
        added["worked"] = np.cumsum(np.append(worked, np.where(new["skip"], 0.0, np.fmax(np.diff(tops), 0.0))))[1:]
        start = np.maximum(np.searchsorted(points["t"], new["t"] - window_s, "right") - 1, 0)
        passed, done = new["t"] - points["t"][start], added["worked"] - points["worked"][start]
        known[run], fits = points[start[-1] :], (passed >= 5) & (done > 0)
        remaining.append(np.where(fits, (1 - tops[1:]) * passed / np.where(fits, done, 1.0), np.nan))
    return pd.DataFrame({"run_id": once["run"], "ts": once["t"], "remaining": np.concatenate(remaining)}), np.concatenate([known[run] for run in sorted(known)])


def eta_stream(stream: DataFrame, window_s: float = 600.0, late: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """(run_id, ts, remaining) for each time of a run of a stream of observations (run_id, ts timestamp, ratio, skip), as `progress.eta` gives for a table.

    Files may come in any order: a run's rows wait in the state until the watermark, the latest time seen less `late`, has passed them, and are then taken in order of time.
    Rows of one time are one observation with the largest ratio, a skip if one of them is. Rows that come after the watermark has passed their time are dropped, and the last
    rows wait until later ones, of any run, move it. The state is those rows, and the observations of the window.

    Runs are dealt to buckets, and a bucket is a key of the state: a call of Python for each run takes milliseconds, much longer than its rows. More buckets make states
    smaller; like the number of partitions of the state, theirs is fixed by the first batch of a checkpoint.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, *packed = state.get if state.exists else (float("-inf"), b"", b"")
        seen, held = (np.frombuffer(x, kind) for x, kind in zip(packed, (SEEN, HELD), strict=True))
        mark = state.getCurrentWatermarkMs() / 1000
        came = [held]
        for p in parts:
            rows = np.empty(len(p), HELD)
            rows["run"], rows["t"], rows["ratio"], rows["skip"] = p["run"], p["t"], p["ratio"], p["skip"]
            came.append(rows[rows["t"] >= upto])
        held = np.concatenate(came)
        ready, held = held[held["t"] < mark], held[held["t"] >= mark]
        out = None
        if len(ready):
            out, seen = _estimates(seen, ready, window_s)
        state.update((max(upto, mark), seen.tobytes(), held.tobytes()))
        if len(held):
            state.setTimeoutTimestamp(max(int(held["t"].min() * 1000), int(mark * 1000)) + 1)
        if out is not None:
            yield out.assign(run_id=pd.array([None] * len(out), "Int64")) if key[0] < 0 else out

    run = F.col("run_id").cast("long")
    bucket = F.when(run.isNull(), -1).otherwise(F.pmod(F.xxhash64(run), F.lit(buckets)))  # rows without a run are one of their own
    rows = stream.withWatermark("ts", late).select(bucket.alias("bucket"), F.coalesce(run, F.lit(0)).alias("run"), "ts", F.col("ts").cast("double").alias("t"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("skip", F.lit(False)).alias("skip"))
    return rows.groupBy("bucket").applyInPandasWithState(step, "run_id long, ts double, remaining double", "upto double, seen binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)
