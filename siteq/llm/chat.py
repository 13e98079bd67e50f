"""Chat formatting by columnar byte assembly.

A conversation becomes one byte string: each turn is a header, the escaped text and a trailer. The segments of a
whole Arrow batch are laid out at once: their lengths are summed into offsets, and one scatter copies headers and
contents into a preallocated buffer that is the data of the result column. Turns are dealt by conversation and sorted
there by Spark; a conversation longer than `part_bytes` goes out as several numbered parts, so no conversation has to
fit in memory.

Template. User-like turns: `[INST] role\\ntext[/INST]`; assistant turns: `<s> role\\ntext</s>`. In texts and roles a
backslash is doubled and the control strings become two-character codes, as does a line end in a role, so a control string in the output is always
the template's own and unescape() gives back every text. The loss mask covers exactly the escaped assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import plain, table

# Control strings and the codes that stand for them inside texts.
CONTROL = {"<s>": "\\s", "</s>": "\\e", "[INST]": "\\i", "[/INST]": "\\j"}
OPEN = {True: b"<s> ", False: b"[INST] "}
CLOSE = {True: b"</s>", False: b"[/INST]"}
ASSISTANT = "assistant"

#: Fixed value: the code of a line end in a role, which ends at one.
LINE_END = "\\n"
_CODES = {v[1]: k for k, v in CONTROL.items()} | {"\\": "\\", LINE_END[1]: "\n"}


def escape(texts: pa.Array) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    for string, code in CONTROL.items():
        out = pc.replace_substring(out, string, code)
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CODES[m[1]], text)


def _scatter(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], total: int) -> np.ndarray:
    """One buffer of `total` bytes from pieces (source bytes, start in source, length, place in the buffer) by turn."""
    out = np.empty(total, np.uint8)
    for data, start, length, place in pieces:
        n = int(length.sum())
        if n:
            within = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
            out[np.repeat(place, length) + within] = data[np.repeat(start, length) + within]
    return out


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted parts of the turns first[i] to first[i + 1]; the assistant turns, and where their texts start and end in the part."""
    assistant = np.array(pc.equal(role, ASSISTANT).to_numpy(zero_copy_only=False), bool)
    roles, texts = _bytes(pc.replace_substring(escape(role), "\n", LINE_END)), _bytes(escape(text))
    heads = np.frombuffer(OPEN[True] + OPEN[False], np.uint8)
    tails = np.frombuffer(CLOSE[True] + CLOSE[False], np.uint8)
    head = np.where(assistant, 0, len(OPEN[True])), np.where(assistant, len(OPEN[True]), len(OPEN[False]))
    tail = np.where(assistant, 0, len(CLOSE[True])), np.where(assistant, len(CLOSE[True]), len(CLOSE[False]))
    line = np.zeros(len(role), np.int64), np.ones(len(role), np.int64)
    sizes = np.stack([head[1], roles[2], line[1], texts[2], tail[1]])
    ends = np.cumsum(sizes.T.ravel()).reshape(-1, 5)
    places = ends - sizes.T
    sources = [(heads, *head), roles, (np.frombuffer(b"\n", np.uint8), *line), texts, (tails, *tail)]
    total = int(ends[-1, -1]) if len(ends) else 0
    buffer = _scatter([(d, s, n, places[:, k]) for k, (d, s, n) in enumerate(sources)], total)
    offsets = np.append(places[:, 0], total)[first]
    parts = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)])
    mine = np.flatnonzero(assistant)
    base = offsets[np.searchsorted(first, mine, "right") - 1]
    return parts, mine, places[mine, 3] - base, ends[mine, 3] - base


FORMATTED = "conv_id long, part long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"


def _format(part_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), -1
        for whole in batches:
            at = 0
            sizes = np.cumsum(np.array(pc.binary_length(whole.column(3)).to_numpy(zero_copy_only=False), np.int64)) if whole.num_rows else np.zeros(0, np.int64)
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + part_bytes, "right")))
                batch = whole.slice(at, end - at)
                at = end
                conv = batch.column(0)
                ids = conv.to_pylist()
                first = np.array([k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]] + [len(ids)])
                parts, mine, starts, ends = assemble(batch.column(2), batch.column(3), first)
                cut = np.searchsorted(mine, first)
                numbers = []
                for k in first[:-1]:
                    part = part + 1 if ids[k] == last else 0
                    last = ids[k]
                    numbers.append(part)
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64())) for x in (starts, ends)]
                yield pa.record_batch([conv.take(pa.array(first[:-1])), pa.array(numbers, pa.int64()), pa.array(np.diff(first)), parts.cast(pa.binary()), *lists], names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"])

    return rows


def format_chats(turns: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """Formatted conversations: conv_id, part, n_turns, formatted, loss_starts, loss_ends (bytes within the part).

    Takes conv_id, turn, role and text; other columns are ignored. Turns go by turn (nulls first), then role, then
    text, so that ties have one order; repeated rows stay. A null text or role is empty. Rows without a conv_id are one
    conversation, with a null id. An empty table gives no rows. Parts of a conversation, in order, are its whole text;
    part_bytes bounds what one part holds, except that a turn is never split.
    """
    base = plain(turns, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text").mapInArrow(_format(part_bytes), FORMATTED)


_TURN = re.compile(r"(<s>|\[INST\]) (.*?)\n(.*?)(</s>|\[/INST\])", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    return [(unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, now = [], None

    def done():
        conv, n, turns, loss, chars, size = now
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["part"] == 0:
                if now is not None:
                    done()
                now = [r["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            raw = r["formatted"]
            text = raw.decode()
            turns = read_back(text)
            now[1] += len(turns)
            for role, said in turns:
                now[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
                said = unescape(raw[a:b].decode())
                now[3].update(said.encode())
                now[4] += len(said)
            now[5] += len(text)
        if len(rows) >= 1000:
            yield _digest_batch(rows)
            rows.clear()
    if now is not None:
        done()
    yield _digest_batch(rows)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations, with conversation -1 added: its texts are control strings.

    The digests stream over the parts in the order that format_chats leaves them in, within the same task.
    """
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    turns = plain(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(extra)
    return format_chats(turns).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<s>', chr(92) || 's'), '</s>', chr(92) || 'e'), '[INST]', chr(92) || 'i'), '[/INST]', chr(92) || 'j'))
    + length(replace(replace(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<s>', chr(92) || 's'), '</s>', chr(92) || 'e'), '[INST]', chr(92) || 'i'), '[/INST]', chr(92) || 'j'))
    + CASE WHEN role = 'assistant' THEN 9 ELSE 15 END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
