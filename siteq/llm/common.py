"""What the operators share: the shared folder, Arrow batches, and words of whole texts as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, as in tests, and an error on a cluster."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="siteq-checkpoint-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def written(df: DataFrame, level: int = 3) -> DataFrame:
    """df as a Parquet table in the shared folder, at a zstandard level: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteq-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names play no part."""
    return df.select(*(F.col(n) for n in names))


#: Bits of the filter of `mostly`, in rows of so many each.
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15


def marked(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a boolean: true for a key, not null, that is one of wanted's, and for few others. The filter that is broadcast has FILTER_BITS bits at most, however many keys there are."""
    place = f"pmod(xxhash64({key}), {FILTER_BITS}L)"
    row = F.expr(f"coalesce({place} div {ROW_BITS}L, 0L)").alias("_row")  # never null, so that no filter for it gets between the rows and an exchange that others read, too
    bits = wanted.where(f"{key} IS NOT NULL").groupBy(row).agg(F.bitmap_construct_agg(F.expr(f"{place} % {ROW_BITS}L")).alias("_bits"))
    byte = f"cast(conv(hex(substring(_bits, cast({place} % {ROW_BITS}L div 8 as int) + 1, 1)), 16, 10) as int)"
    held = F.expr(f"coalesce({key} IS NOT NULL AND {byte} & shiftleft(1, cast({place} % 8 as int)) <> 0, false)").alias(name)
    return rows.select("*", row).join(F.broadcast(bits), "_row", "left").select(*rows.columns, held)


def mostly(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id is not null and one of wanted's, and few others: a filter of fixed size before a join, which only saves work."""
    return marked(rows, wanted, "doc_id", "_held").where("_held").select(*rows.columns)


def slices(batches: Iterator[pa.RecordBatch], text: str, step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about `step` bytes of the column `text`, whose nulls become empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        col = col.cast(pa.large_string()).fill_null("") if col.null_count or col.type != pa.large_string() else col
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
            yield batch.slice(at, end - at), col.slice(at, end - at)
            at = end


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 5
_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _TABLES[:] = [_powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))]
    return _TABLES[0], _TABLES[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_bytes(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_WORD = _word_bytes(SPACE)


class Words:
    """The words of each text of an Arrow column: byte ranges into `data`, 64-bit hashes, and each text's first word.

    Words of text i are first[i] to first[i + 1]. `lower` folds A-Z before hashing.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separators: bytes | None = None):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        word = (_WORD if separators is None else _word_bytes(separators))[data]
        before, after = np.empty_like(word), np.empty_like(word)
        if len(word):
            before[0], before[1:], after[-1], after[:-1] = False, word[:-1], False, word[1:]
            cuts = bounds[1:-1]
            before[cuts[cuts < len(word)]] = False
            after[cuts[cuts > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.bounds = bounds
        up, down = _tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _SAME)[data] * up[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 of a text run into the next one."""
        h, out = self.hashes, np.zeros(max(0, len(self.hashes) - n + 1), np.uint64)
        factor = 0x2545F4914F6CDD1D
        for k in range(n):
            out += h[k : k + len(out)] * np.uint64(factor)
            factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
        return mix(out)

    def text(self, a: int, b: int) -> bytes:
        """The bytes from word a to before word b, with the white space between."""
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes() if b > a else b""


def crc_fold(doc_id: str, folds: int = 4):
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
