"""Line dedup over a sharded minimal perfect hash of the frequent lines.

Every distinct line hash is counted by a grouped aggregate with map-side sums. The hashes that reach the threshold
are split into shards; each shard is one minimal perfect hash (levels of bit arrays) that indexes compact
fingerprint, count and keeper arrays. Documents probe the arrays. They are broadcast only while their measured size
is within `broadcast_bytes`; beyond it the shards stay where they were built and the lines are dealt to them by
shard, so that no task ever holds more than one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import plain, slices, table, written

#: Levels of a perfect hash; what is left after them is listed apart.
LEVELS = 24


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    from siteq.llm.common import mix

    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: index() gives each key its own number from 0 to n - 1.

    Level by level, keys that share a slot with no other take it; the rest go on to the next level. A key outside
    the set gets any number or -1, so callers compare a stored fingerprint.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, -(-int(len(keys) * gamma) // 64) * 64)
            at = _slot(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            ranks = base + np.cumsum(ones) - ones
            self.levels.append((words, ranks))
            base += int(ones.sum())
            keys = keys[~alone[at]]
        self.rest = np.sort(keys)
        self.base = base
        self.n = base + len(keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(self.levels):
            if not len(left):
                return out
            at = _slot(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = ranks[at[hit] >> 6] + below
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.base + at[hit]
        return out

    def bytes(self) -> int:
        return sum(w.nbytes + r.nbytes for w, r in self.levels) + self.rest.nbytes


class Shard:
    """One shard: the perfect hash, and fingerprint, count and keeper of each line by its number."""

    def __init__(self, line: np.ndarray, check: np.ndarray, docs: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(line)
        at = self.hash.index(line)
        self.check, self.count, self.keeper = np.empty(len(at), np.uint32), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
        self.check[at], self.count[at], self.keeper[at] = (check & 0xFFFFFFFF).astype(np.uint32), np.minimum(docs, 0xFFFFFFFF), keeper

    def probe(self, line: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is in the shard, and its keeper."""
        at = self.hash.index(line)
        found = (at >= 0) & (self.check[at] == (check & 0xFFFFFFFF).astype(np.uint32)) if len(self.check) else np.zeros(len(at), bool)
        return found, self.keeper[at] if len(self.keeper) else np.zeros(len(at), np.int64)

    def bytes(self) -> int:
        return self.hash.bytes() + self.check.nbytes + self.count.nbytes + self.keeper.nbytes


def keys_of(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has `least` code points or more."""
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip().lower()
            if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                yield k, key


def _hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFF


def _line_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 4 << 20):
            line, check, doc = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
                seen = {_hashes(key) for _, key in keys_of(text.encode(), least)}
                line += [h for h, _ in seen]
                check += [c for _, c in seen]
                doc += [d] * len(seen)
            yield pa.record_batch({"line": pa.array(np.array(line, np.uint64).view(np.int64)), "check": pa.array(check, pa.int64()), "doc_id": pa.array(doc, pa.int64())})

    return rows


def frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(line, check, n_docs, keeper) of the line keys that at least min_docs documents hold; keeper is the largest doc_id."""
    rows = plain(docs, "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInArrow(_line_rows(min_chars), "line long, check long, doc_id long")
    if docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).collect():
        rows = rows.distinct()  # rows with the same doc_id are one document
    return rows.groupBy("line", "check").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def _shards(frequent: DataFrame, n: int) -> DataFrame:
    """(shard, bytes, line, check, docs, keeper): each shard's lines as arrays, built in one task a shard."""

    def pack(rows):
        line = rows["line"].to_numpy()
        shard = Shard(line.view(np.uint64), rows["check"].to_numpy(), rows["n_docs"].to_numpy(), rows["keeper"].to_numpy())
        import pandas as pd

        return pd.DataFrame([{"shard": rows["shard"].iloc[0], "size": shard.bytes(), "lines": len(rows), "body": _pack(shard)}])

    return frequent.withColumn("shard", F.pmod("line", F.lit(n)).cast("int")).groupBy("shard").applyInPandas(pack, "shard int, size long, lines long, body binary")


def _pack(x) -> bytes:
    import pickle

    return pickle.dumps(x, protocol=5)


def _unpack(body: bytes):
    import pickle

    return pickle.loads(body)


def _kept(doc_id, text: bytes, drop: list[int]) -> tuple[str, int]:
    lines = text.split(b"\n")
    if drop:
        gone = set(drop)
        text = b"\n".join(x for k, x in enumerate(lines) if k not in gone)
    return text, len(lines)


def _probe_all(doc_ids: list, texts: list[bytes], shards: dict, n: int, least: int) -> list[list[int]]:
    """For each text, the numbers of the lines that go."""
    where, line, check, owner = [], [], [], []
    for i, text in enumerate(texts):
        for k, key in keys_of(text, least):
            h, c = _hashes(key)
            where.append((i, k))
            line.append(h)
            check.append(c)
            owner.append(doc_ids[i])
    drops: list[list[int]] = [[] for _ in texts]
    if where:
        line, check, owner = np.array(line, np.uint64), np.array(check, np.int64), np.array([-1 if x is None else x for x in owner], np.int64)
        part = np.mod(line.view(np.int64), n)
        for s in np.unique(part):
            if (shard := shards.get(int(s))) is not None:
                mine = np.flatnonzero(part == s)
                found, keeper = shard.probe(line[mine], check[mine])
                for m in mine[found & (keeper != owner[mine])]:
                    i, k = where[m]
                    if doc_ids[i] is not None:
                        drops[i].append(k)
    return drops


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, lines_a_shard: int = 500_000, broadcast_bytes: int = 64 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop the lines that many documents hold, except in the document with the largest doc_id.

    Takes doc_id and text; returns doc_id, n_lines, n_dropped, kept (the text left) and kept_sha256, a row for each
    row of docs. A null text is one empty line. Rows without a doc_id hold no line in anyone's count and lose none.
    Rows with the same doc_id count as one document. An empty table gives no rows. Columns named in carry come along;
    others are ignored.
    """
    spark = docs.sparkSession
    frequent = written(frequent_lines(docs, min_chars, min_docs))
    total = frequent.count()
    n = max(1, -(-total // lines_a_shard))
    built = written(_shards(frequent, n))
    size = built.agg(F.sum("size")).first()[0] or 0
    base = plain(docs, "doc_id", "text", *carry)
    out = ", ".join(["doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    if size <= broadcast_bytes:
        arrays = spark.sparkContext.broadcast({r["shard"]: _unpack(bytes(r["body"])) for r in built.collect()})
        return base.mapInArrow(_drop_by_probe(arrays, n, min_chars), out)
    return _drop_by_shard(base, built, n, min_chars, out, carry)


def _rows_out(doc_ids, texts: list[bytes], drops: list[list[int]], carried: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [_kept(d, t, x) for d, t, x in zip(doc_ids, texts, drops, strict=True)]
    return pa.record_batch(
        {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "n_lines": pa.array([n for _, n in kept], pa.int64()),
            "n_dropped": pa.array([len(x) for x in drops], pa.int64()),
            "kept": pa.array([t.decode() for t, _ in kept], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t, _ in kept], pa.string()),
            **carried,
        }
    )


def _drop_by_probe(arrays, n: int, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 4 << 20):
            ids, raw = batch.column(0).to_pylist(), [x.encode() for x in texts.to_pylist()]
            yield _rows_out(ids, raw, _probe_all(ids, raw, arrays.value, n, least), dict(zip(batch.schema.names[2:], batch.columns[2:], strict=True)))

    return rows


def _drop_by_shard(base: DataFrame, built: DataFrame, n: int, least: int, out: str, carry: tuple[str, ...]) -> DataFrame:
    """The way beyond the broadcast limit: line occurrences go to the shard that may hold them and come back by document."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 4 << 20):
            ids, rows, line, check, number = [], [], [], [], []
            for d, r, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts.to_pylist(), strict=True):
                for k, key in keys_of(text.encode(), least):
                    h, c = _hashes(key)
                    ids.append(d)
                    rows.append(r)
                    line.append(h)
                    check.append(c)
                    number.append(k)
            line = np.array(line, np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows, pa.int64()), "line": pa.array(line), "check": pa.array(check, pa.int64()), "number": pa.array(number, pa.int32()), "shard": pa.array(np.mod(line, n).astype(np.int32))})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:  # each shard's arrays come before its lines
            t = batch.to_pydict()
            bodies = [(i, b) for i, b in enumerate(t["body"]) if b is not None]
            cuts = [0, *(i for i, _ in bodies), batch.num_rows]
            loaded = dict(bodies)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a in loaded:
                    shard = (t["shard"][a], _unpack(loaded[a]))
                    a += 1
                mine = [i for i in range(a, b) if shard and t["shard"][i] == shard[0]]
                if not mine:
                    continue
                line = np.array([t["line"][i] for i in mine], np.int64).view(np.uint64)
                found, keeper = shard[1].probe(line, np.array([t["check"][i] for i in mine], np.int64))
                gone = [i for i, f, k in zip(mine, found, keeper, strict=True) if f and k != t["doc_id"][i]]
                yield pa.record_batch({"row": pa.array([t["row"][i] for i in gone], pa.int64()), "number": pa.array([t["number"][i] for i in gone], pa.int32())})

    salts = 16  # a shard's lines go to several tasks, each with a copy of its arrays
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    lines = plain(base, "doc_id", "text", "row").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(occurrences, "doc_id long, row long, line long, check long, number int, shard int")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).withColumn("body", F.lit(None).cast("binary"))
    copies = built.select("shard", "body").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = lines.unionByName(copies, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("body").isNull())
    drops = dealt.mapInArrow(probe, "row long, number int").groupBy("row").agg(F.collect_set("number").alias("drops"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 4 << 20):
            yield _rows_out(batch.column(0).to_pylist(), [x.encode() for x in texts.to_pylist()], [sorted(x or []) for x in batch.column(2).to_pylist()], dict(zip(batch.schema.names[3:], batch.columns[3:], strict=True)))

    return base.join(drops, "row", "left").select("doc_id", "text", "drops", *carry).mapInArrow(cut, out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines of all documents: keys of 40 code points or more in 5 documents or more, without the texts."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS key FROM (
    SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
often AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, i, line, (keeper IS NOT NULL AND keeper <> l.doc_id) AS gone FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
