"""Token counts from flat token files by a separator scan.

A token file is a run of 16-bit token ids in which an end-of-document id ends each document; nothing says where
documents start. The scan looks for that id in whole blocks at once with numpy. Documents cross block borders: a
prefix scan over the small per-block summaries (tokens, separators, place of the last separator) gives every block the
number of documents and the start of the open document before it, so blocks are scanned independently.

`token_files` makes such files from documents with a public tokenizer (its path is a parameter). Blocks are kept in a
table (file, block, data), which is how a store of splittable raw files comes to Spark.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.llm.common import plain, slices, table, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The end-of-document id: the one that the vocabulary leaves free.
END = 50256
BLOCK_TOKENS = 1 << 18
# Fixed value: the split of the vocabulary's byte-level tokenizer into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(f"{path}/{vocabulary}", "rb") as f:  # installed with the tokenizers on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("siteq", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_files(docs: DataFrame, tokenizers: str = TOKENIZERS, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """(file, block, data, doc_ids): a flat token file for each task, in blocks of block_tokens ids.

    doc_ids of a block names the documents whose end is in it, in order: the list of what was written, not of where.
    A null text is an empty document; ids are of `dtype`, which has to hold the vocabulary's largest. A text is encoded whole, however
    long. The result is written once, so later reads see one order of documents.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file = encoder(tokenizers), TaskContext.get().partitionId()
        block, held, ids, n = 0, [], [], 0

        def flush(data: np.ndarray, ended: list) -> pa.RecordBatch:
            return pa.record_batch({"file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()), "data": pa.array([data.tobytes()], pa.binary()), "doc_ids": pa.array([ended], pa.list_(pa.int64()))})

        for batch, texts in slices(batches, "text"):
            for d, text in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
                tokens = np.array([*encode(text), END], dtype)
                while n + len(tokens) >= block_tokens:
                    room = block_tokens - n
                    held.append(tokens[:room])
                    tokens = tokens[room:]
                    if not len(tokens):
                        ids.append(d)
                    yield flush(np.concatenate(held), ids)
                    block, held, n = block + 1, [], 0
                    ids = []
                if len(tokens):
                    held.append(tokens)
                    n += len(tokens)
                    ids.append(d)
        if n:
            yield flush(np.concatenate(held), ids)

    out = plain(docs, "doc_id", "text").mapInArrow(rows, "file long, block long, data binary, doc_ids array<long>")
    return written(out)


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) of the documents of flat token files, given as (file, block, data).

    ordinal counts a file's documents from 0; n_tokens leaves out the separator. Tokens after a file's last separator
    are a last document without an end; an empty file has none. A block's data is whole ids; a null block is empty.
    """
    width = np.dtype(dtype).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for body in batch.column(2):
                tokens = np.frombuffer(memoryview(body.as_buffer()) if body.is_valid else b"", dtype)
                ends.append(np.flatnonzero(tokens == end))
                sizes.append(len(tokens))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in ends])])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ends) if ends else [], pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], names=["file", "block", "size", "ends"])

    assert width in (1, 2, 4, 8)
    found = written(plain(blocks, "file", "block", "data").mapInArrow(scan, "file long, block long, size long, ends array<long>"))
    # the prefix scan sees a block's summary only, a row of five numbers
    summaries = found.select("file", "block", "size", F.size("ends").alias("n_ends"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last_end"))
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    summaries = summaries.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    summaries = summaries.select(
        "file", "block", "start", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.max(F.col("start") + F.col("last_end") + 1).over(before), F.lit(0)).alias("open"), F.lead("block").over(w).isNull().alias("is_last"),
    )
    same = found["file"].eqNullSafe(summaries["file"]) & found["block"].eqNullSafe(summaries["block"])
    base = found.join(summaries, same).drop(summaries["file"], summaries["block"])
    # a file's unended tail is a document of its last block
    stop = F.col("start") + F.col("size")
    closed = F.transform("ends", lambda e: F.col("start") + e)
    tail_from = F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1) + 1).otherwise(F.col("open"))
    stops = F.when(F.col("is_last") & (tail_from < stop), F.concat(closed, F.array(stop))).otherwise(closed)
    each = base.withColumn("stops", stops).select("file", "n_before", "open", "stops", F.posexplode("stops").alias("k", "stop"))
    since = F.when(F.col("k") > 0, F.element_at("stops", F.col("k")) + 1).otherwise(F.col("open"))
    return each.select("file", (F.col("n_before") + F.col("k")).alias("ordinal"), (F.col("stop") - since).alias("n_tokens"))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of all documents, counted from flat token files that are made of them first."""
    blocks = token_files(table(spark, sf_dir, "documents"), tokenizers)
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = blocks.select("file", "block", "doc_ids").withColumn("n_before", F.coalesce(F.sum(F.size("doc_ids")).over(w), F.lit(0)))
    names = names.select("file", F.posexplode("doc_ids").alias("k", "doc_id"), "n_before").select("file", (F.col("n_before") + F.col("k")).alias("ordinal"), "doc_id")
    return count_tokens(blocks).join(names, ["file", "ordinal"]).select("doc_id", "n_tokens")
