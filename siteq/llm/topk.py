"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are packed into bounded blocks; a block holds, for each dimension, its rows in the order of their values. A
query reads all lists in step, from the end that its own sign prefers, scores each row that it meets for the first
time, and stops once the sum of the values at the reading depth, times the query, is below its k-th result: no unread
row can beat it. Candidate blocks are dealt to slots and query blocks to parts; every part meets every slot through an
equi-join on their numbers. Within a slot a query takes its k-th score so far from block to block, which stops the later
ones sooner. The k best of each slot are merged by a window over at most k rows a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.llm.common import plain, table, written

BLOCK = "block long, n long, dims int, most double, sum double, ids binary, body binary"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold null, NaN or infinity."""
    wide = vector.cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def _blocks(rows_a_block: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_block):
                part = batch.slice(at, rows_a_block)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                col = part.column(1)
                sizes = np.diff(col.offsets.to_numpy())
                dims = int(sizes.max(initial=0))
                body = np.zeros((len(ids), dims), np.int64)  # a shorter vector is zero in the dimensions that it lacks
                body[np.arange(dims) < sizes[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
                order, size = np.argsort(ids, kind="stable"), np.abs(body.astype(np.float64))
                yield pa.record_batch({"block": pa.array([base + k], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "dims": pa.array([dims], pa.int32()), "most": pa.array([size.max(initial=0.0)]), "sum": pa.array([size.sum(axis=1).max(initial=0.0)]), "ids": pa.array([ids[order].tobytes()]), "body": pa.array([_narrow(body[order]).tobytes()])})
                k += 1

    return rows


def _narrow(body: np.ndarray) -> np.ndarray:
    """The values behind a byte that tells their width: 2 or 8 bytes."""
    small = abs(body).max(initial=0) < 1 << 15
    return np.concatenate([np.array([2 if small else 8], np.uint8), body.astype("<i2" if small else "<i8").ravel().view(np.uint8)])


def _wide(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[0] == 2 else "<i8", offset=1).reshape(n, dims).astype(np.int64)


def _exact_type(x: np.ndarray, q: np.ndarray):
    """The quickest type in which every inner product is exact."""
    most = float(abs(x).max(initial=0)) * float(abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Lists:
    """A block of candidates: ids in ascending order, their vectors, and for each dimension the rows by value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.up = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.up, 0)

    def best(self, query: np.ndarray, own: int, k: int, x: np.ndarray, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, by score and then id; x is self.x in a type that is exact for this query. Rows below floor may be missing."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        q, typed = query[used], query.astype(x.dtype)
        down = q > 0
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, last = 0, min(n, 16)
        while True:
            if len(used):
                at = np.arange(depth, last)
                met = self.up[np.where(down, n - 1 - at[:, None], at[:, None]), used]
                fresh = np.zeros(n, bool)
                fresh[met.ravel()] = True
                fresh &= ~seen
            else:
                fresh, last = ~seen, n
            new = np.flatnonzero(fresh)
            seen |= fresh
            new = new[self.ids[new] != own]
            if len(new):
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, (x[new] @ typed).astype(np.int64)])
                if len(rows) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[scores >= least], scores[scores >= least]
                    order = np.lexsort((self.ids[rows], -scores))[:k]
                    rows, scores = rows[order], scores[order]
            if last >= n or seen.all():
                break
            bound = int((self.values[np.where(down, n - last, last - 1), used] * q).sum())
            if len(rows) == k and bound < scores.min() or floor is not None and bound < floor:
                break
            depth, last = last, min(n, 2 * last)
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _match(k: int):
    import pandas as pd

    def rows(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k best of a slot's candidate blocks for each query of a bounded part of the query blocks."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        blocks = [(np.frombuffer(r.ids, np.int64), _wide(r.body, r.n, r.dims)) for r in queries.itertuples()]
        for c in candidates.sort_values("block").itertuples() if blocks else ():
            lists = Lists(np.frombuffer(c.ids, np.int64), _wide(c.body, c.n, c.dims))
            for own, q in blocks:
                q = np.pad(q, ((0, 0), (0, max(0, c.dims - q.shape[1]))))[:, : c.dims]
                x = lists.x.astype(_exact_type(lists.x, q))
                for i, v in zip(own.tolist(), q, strict=True):
                    ids, scores = best.get(i, (np.zeros(0, np.int64),) * 2)
                    at, more = lists.best(v, i, k, x, int(scores[-1]) if len(scores) == k else None)
                    ids, scores = np.concatenate([ids, lists.ids[at]]), np.concatenate([scores, more])
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[order], scores[order]
        cols = [np.repeat(list(best), [len(x[0]) for x in best.values()]), *(np.concatenate([x[c] for x in best.values()]) for c in (0, 1))] if best else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.asarray(c, np.int64) for c in cols), strict=True)))

    return rows


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, rows_a_block: int = 2048, blocks_a_slot: int = 4, blocks_a_part: int = 2, most_tasks: int = 10_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Takes vec_id and embedding. A row whose vector is null or holds null or non-finite components, or whose vec_id is
    null, takes no part. Repeated rows with one vec_id and vector are one; a query is never its own candidate, by
    vec_id. Rows with one vec_id and several vectors are a candidate each; as queries they share one list. Shorter vectors
    count as zero where they end; a vector of any length is used whole. Scores are longs. An empty table gives no rows.
    Other columns are ignored. Scores have 64 bits: if the largest quantised component times the largest sum of a query's
    components, all without sign, reaches 2^63, no result would be sure, and a ValueError says so.
    """
    base = plain(vectors, "vec_id", "embedding").withColumn("vector", quantised(F.col("embedding"), scale)).where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector").distinct()
    packed = written(base.mapInArrow(_blocks(rows_a_block), BLOCK))
    asked = written(base.where(is_query).mapInArrow(_blocks(rows_a_block), BLOCK))
    most, total = (x.agg(F.max(c)).first()[0] or 0.0 for x, c in ((packed, "most"), (asked, "sum")))
    if max(most, total, most * total) >= 0.999 * 2**63:
        raise ValueError(f"inner products may pass 64 bits: components up to {most:g}, a query's sum up to {total:g}")
    slots = max(1, -(-packed.count() // blocks_a_slot))
    parts = max(1, -(-asked.count() // blocks_a_part))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.withColumn("part", deal(parts)).withColumn("slot", each(slots))
    candidates = packed.withColumn("slot", deal(slots)).withColumn("part", each(parts))
    tasks = min(2 * slots * parts, most_tasks)  # by number, so that Spark does not merge small but costly partitions
    candidates, queries = (x.repartition(tasks, "slot", "part") for x in (candidates, queries))
    found = candidates.groupBy("slot", "part").cogroup(queries.groupBy("slot", "part")).applyInPandas(_match(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
