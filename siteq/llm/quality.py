"""Quality classifier by compression.

Two zstandard dictionaries, one from text labelled good and one from text labelled bad, compress every document. The
difference of the two compressed sizes, over the document's own size, says which kind of text it is more like; a
logistic curve fitted on other labelled rows turns it into a probability. Fitting uses a bounded sample
(`fit_rows` a class, `fit_bytes` of text a class); scoring streams over all documents with two small dictionaries in
the task, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import crc_fold, plain, slices, table

#: Compression level, and the bytes of text at which its own evidence weighs half.
LEVEL, HALF = 6, 150


@dataclass(frozen=True)
class Model:
    """Dictionaries and the curve.

    score = 1 / (1 + exp(-(prior + weight * (slope * gain + bias)))), where weight = size / (size + HALF) lets short
    texts, which say little, fall back on the share of good labels.
    """

    good: bytes
    bad: bytes
    slope: float
    bias: float
    prior: float

    def gains(self):
        """A function of a text: (bytes with the bad dictionary - bytes with the good one) / bytes of the text, or 0."""
        if not (self.good and self.bad):
            return lambda text: 0.0
        compressors = []
        for body in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        good, bad = compressors
        return lambda text: (len(bad.compress(text)) - len(good.compress(text))) / len(text) if text else 0.0

    def score(self, gain: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prior + size / (size + HALF) * (self.slope * gain + self.bias), -30, 30)))


def _dictionary(texts: list[bytes], size: int, piece: int = 600) -> bytes:
    """Pieces of all texts in turn, from changing places of each, up to `size` bytes in all."""
    out, left, turn = [], size, 0
    while left > 0 and turn < 64:
        for k, t in enumerate(texts):
            span = max(1, len(t) - piece + 1)
            at = (k * 2654435761 + turn * 40503 * piece) % span
            out.append(t[at : at + piece][:left])
            left -= len(out[-1]) + 1
            if left <= 0:
                break
        turn += 1
    return b"\n".join(out)


def _curve(gain: np.ndarray, size: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and bias of the logistic curve by Newton steps with a little ridge; prior is a fixed offset."""
    weight = size / (size + HALF)
    scale = float(np.std(gain)) or 1.0
    a = np.stack([weight * gain / scale, weight], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(prior + a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, fit_bytes: int = 8 << 20, dict_bytes: int = 1 << 20, held_fold: int | None = 2) -> Model:
    """Fit on labelled rows outside the held-out fold.

    At most `fit_rows` rows a class, those with the smallest hash of doc_id, and of these as many whole texts (the least of rows
    that share a doc_id) as fit `fit_bytes`; half of them fill the dictionary, half fit the curve, by another bit of the hash. A doc_id whose
    labels differ or that has none, and rows without a text, aren't used. With a class missing, every document gets
    the share of good labels (0.5 without labels). Labels other than 0 and 1 play no part.
    """
    fold = crc_fold("doc_id")
    known = plain(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known if held_fold is None else known.where(fold != held_fold)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    draw = F.xxhash64("doc_id", F.lit(11))
    picked = [known.where(F.col("quality") == q).orderBy(draw, "doc_id").limit(fit_rows) for q in shares]
    if not picked:
        return Model(b"", b"", 0.0, 0.0, 0.0)
    few = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    sample = plain(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id").groupBy("quality", "doc_id").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text"))
    sized = sample.select("quality", "doc_id", draw.alias("draw"), "size").distinct().orderBy("draw", "doc_id", "size").collect()
    keep, room, rows = set(), {0: fit_bytes, 1: fit_bytes}, {0: fit_rows, 1: fit_rows}
    for r in sized:
        q = r["quality"]
        if rows[q] and r["size"] <= room[q]:
            keep.add((r["doc_id"], r["size"]))
            room[q] -= r["size"]
            rows[q] -= 1
    texts = {q: ([], []) for q in (0, 1)}
    ids = F.broadcast(docs.sparkSession.createDataFrame(sorted(keep) or [(0, -1)], "doc_id long, size int"))
    for r in sorted(sample.join(ids, ["doc_id", "size"]).select("quality", "doc_id", "text", draw.alias("draw")).collect(), key=lambda r: (r["draw"], r["doc_id"], r["text"])):
        texts[r["quality"]][(r["draw"] >> 3) & 1].append(r["text"].encode())
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    prior = math.log((n1 + 1) / (n0 + 1))
    if not all(texts[q][half] for q in (0, 1) for half in (0, 1)):
        return Model(b"", b"", 0.0, 0.0, prior)
    model = Model(_dictionary(texts[1][0], dict_bytes), _dictionary(texts[0][0], dict_bytes), 0.0, 0.0, prior)
    gain, rest = model.gains(), [t for q in (0, 1) for t in texts[q][1]]
    y = np.repeat([0.0, 1.0], [len(texts[q][1]) for q in (0, 1)])
    # the sample has its own share of classes: it is the offset while fitting, that of all labels afterwards
    slope, bias = _curve(np.array([gain(t) for t in rest]), np.array([len(t) for t in rest]), y, math.log(y.sum() / (len(y) - y.sum())))
    return replace(model, slope=slope, bias=bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, then score and predicted (score >= threshold), a row for each row of docs.

    A null or empty text gets the share of good labels. A text is compressed whole, however long. Equal texts get equal
    scores, repeated rows one each. Columns named score or predicted are replaced, all others carried. An empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dict_bytes at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.gains()
        for batch, texts in slices(batches, hidden, 4 << 20):
            raw = [t.encode() for t in texts.to_pylist()]
            s = shared.value.score(np.array([gain(t) for t in raw], float), np.array([len(t) for t in raw], float))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    base = docs.drop("score", "predicted")
    hidden = max(["text", *base.columns], key=len) + "_"  # no column's name
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.withColumn(hidden, F.col("text")).mapInArrow(rows, f"{schema}, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32(doc_id) mod 4 is 2 are held out of every fit.

    A null doc_id counts as not held out (its fold is unknown and it never has a label).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted")
