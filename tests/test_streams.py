"""Streams against the same work on tables: files in any order, repeats, replays, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from siteq.operators import progress
from siteq.streaming import results

OBSERVED = "run_id long, ts timestamp, ratio double, skip boolean"


def written(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def run(stream, tmp_path):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()


def at(spark, rows):
    return [(k, spark.sql(f"SELECT timestamp_micros({int(t * 1e6)})").first()[0], ratio, skip) for k, t, ratio, skip in rows]


def test_eta_of_files_in_any_order(spark, tmp_path):
    """Rows of any time in five files, one file a batch, with ties of time; an end mark lets the last ones out."""
    r = random.Random(3)
    rows = [(k % 3, 1000.0 + k // 2 * 2, r.random() * min(1.0, k / 80), k % 7 == 0) for k in range(120)]
    mixed = r.sample(rows, len(rows))
    stamped = dict(zip(sorted({t for _, t, _, _ in rows}), [x[1] for x in at(spark, [(0, t, 0.0, False) for t in sorted({t for _, t, _, _ in rows})])], strict=True))
    for k in range(5):
        written(spark, [(a, stamped[t], b, c) for a, t, b, c in mixed[k::5]], tmp_path / "in", OBSERVED)
    written(spark, at(spark, [(-1, 10_000.0, 0.0, False)]), tmp_path / "in", OBSERVED)
    run(results.eta_stream(results.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], OBSERVED).schema, 1), 30.0, "500 seconds"), tmp_path)
    got = {(x.run_id, x.ts): x.remaining for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    once = spark.createDataFrame(rows, "run_id long, t double, ratio double, skip boolean").groupBy("run_id", "t").agg(F.max("ratio").alias("ratio"), F.bool_or("skip").alias("skip"))
    want = {(x.run_id, x.t): x.remaining for x in progress.eta(once, "run_id", "t", 30).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_eta_of_many_runs(spark, tmp_path):
    """Many runs with few rows, some without a number and some with large ones, are a few keys of the state, and each has its own estimates."""
    r = random.Random(7)
    rows = [(None if k % 50 == 0 else 2**62 + k if k % 3 == 0 else k, 1000.0 + 7 * r.randrange(20), r.random(), r.random() < 0.2) for k in r.choices(range(400), k=2000)]
    schema = "run_id long, t double, ratio double, skip boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3] if k < 2 else rows[k::3] + [(-1, 10_000.0, 0.0, False)], schema).select("run_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "ratio", "skip").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = results.eta_stream(results.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], OBSERVED).schema, 1), 30.0, "500 seconds", buckets=8)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.run_id, x.ts): x.remaining for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    once = spark.createDataFrame(rows, schema).groupBy("run_id", "t").agg(F.max("ratio").alias("ratio"), F.bool_or("skip").alias("skip"))
    want = {(x.run_id, x.t): x.remaining for x in progress.eta(once, "run_id", "t", 30).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(k is None for k, _ in got) and max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 9


def test_eta_over_several_moves_of_the_watermark(spark, tmp_path):
    """Runs go on from what the state keeps of them: counters, the window's observations and rows that wait."""
    r = random.Random(8)
    rows = [(k % 40, 1000.0 + 5 * (k // 40), min(1.0, k / 2000 + r.random() / 50), r.random() < 0.2) for k in range(1600)]
    schema = "run_id long, t double, ratio double, skip boolean"
    for part in (rows[:500], rows[500:900], rows[900:], [(-1, 10_000.0, 0.0, False)]):
        spark.createDataFrame(r.sample(part, len(part)), schema).select("run_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "ratio", "skip").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run(results.eta_stream(results.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], OBSERVED).schema), 30.0, "20 seconds", buckets=4), tmp_path)
    got = [(x.run_id, x.ts, x.remaining) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {(x.run_id, x.t): x.remaining for x in progress.eta(spark.createDataFrame(rows, schema), "run_id", "t", 30).collect()}
    assert len(got) == len(want) and all(x == pytest.approx(want[a, t]) for a, t, x in got)


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    for rows in ([(1, 100.0, 0.1, False)], [(1, 500.0, 0.3, False)], [(1, 510.0, 0.35, False)], [(1, 200.0, 0.9, False)], [(1, 2000.0, 0.5, False)]):
        written(spark, at(spark, rows), tmp_path / "in", OBSERVED)
        run(results.eta_stream(results.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], OBSERVED).schema), 600.0, "50 seconds"), tmp_path)
    assert sorted(x.ts for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [100.0, 500.0, 510.0]


def test_latest_rows_survive_repeats_and_replays(spark, tmp_path):
    """Several batches with exact repeats and rows that come late; then all once more from the start; then more rows."""
    schema = "id long, seq long, v string"
    shape = spark.createDataFrame([], schema).schema
    r = random.Random(6)
    rows = [(r.randrange(40), k, f"v{k}") for k in range(300)]
    batches = [r.sample(rows[a : a + 75], 75) + rows[max(0, a - 40) : a] for a in range(0, 300, 75)]
    out = str(tmp_path / "out")

    def go(check):
        results.latest_per_key(results.log_stream(spark, str(tmp_path / "in"), shape, 1), "id", ["seq"], out, str(tmp_path / check)).awaitTermination()
        return {x.id: (x.seq, x.v) for x in results.latest_table(spark, out, "id", ["seq"], shape).collect()}

    want = lambda some: {i: max((s, v) for k, s, v in some if k == i) for i in {k for k, _, _ in some}}
    for k, b in enumerate(batches):
        written(spark, b, tmp_path / "in", schema)
        assert go("c") == want(rows[: 75 * k + 75])
    assert go("c") == want(rows) and go("d") == want(rows)
    written(spark, [(99, 1, "new"), (rows[0][0], -5, "old")], tmp_path / "in", schema)
    assert go("c") == want([*rows, (99, 1, "new")])


def test_a_batch_logs_what_it_changes(spark, tmp_path):
    """The log of a batch has the keys that it changes, whatever the table holds; snapshots come when the log has grown as large as the last one."""
    schema = "id long, seq long, v string"
    shape = spark.createDataFrame([], schema).schema
    sizes = []
    for k, rows in enumerate(([(i, 0, "a") for i in range(1000)], [(5, 1, "b"), (6, 1, "b"), (5, 1, "b")], [(2000, 2, "c")], [(5, 0, "late")])):
        written(spark, rows, tmp_path / "in", schema)
        results.latest_per_key(results.log_stream(spark, str(tmp_path / "in"), shape, 1), "id", ["seq"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        sizes.append(spark.read.schema(shape).parquet(str(tmp_path / "out" / "changes" / f"batch={k}")).count())
    assert sizes == [1000, 2, 1, 1]
    assert sorted(p.name for p in (tmp_path / "out" / "snapshots").iterdir()) == ["upto=0"]
    assert {x.id: x.v for x in results.latest_table(spark, str(tmp_path / "out"), "id", ["seq"], shape).where("id IN (5, 7, 2000)").collect()} == {5: "b", 7: "a", 2000: "c"}
