"""Substring dedup: suffix automata of reference passages, and matching statistics of the documents against them.

A word goes if a window of `window` words covers it that also occurs in a document with a smaller id. Suffix automata
of whole reference shards, broadcast to every document, would cost documents times shards, so passages are brought
together first. Each window is named by its minimiser, the smallest hash of its inner grams: equal windows have equal
minimisers. Minimisers of one document only are dropped. Where several documents share one, the runs of windows under
it become pieces; the pieces of a minimiser meet in one place in order of doc_id, the earlier ones are kept as a suffix
automaton, and later ones are streamed through it. What matches for `window` words or more goes. The automaton compares the words
themselves, so hashes decide only where pieces meet.

Hot passages are thinned before both shuffles without losing a case: a task that has seen a minimiser in two documents
knows that it is shared and sends it on once, and a piece whose very words the task has seen in a smaller document is
settled there and then.

A minimiser whose pieces hold more than HOT words together is hot: its pieces fall into their windows, and each window
is a piece under the hash of its very words. So a place never holds more than HOT words that differ, while the copies
of one window are thinned to about one a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import Words, marked, plain, slices, table

#: Most pieces that a task remembers; then it starts anew, which only sends more on.
MEMORY = 200_000
#: Most words of all pieces of a minimiser that meet in one place.
HOT = 50_000


class Automaton:
    """Suffix automaton over words, grown text by text; statistics() gives the longest match that ends at each word."""

    __slots__ = ("length", "link", "next")

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, q, w)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def _split(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if (to := nxt[state].get(w)) is not None:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal ranges of words covered by matches of `least` words or more."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= least:
            if out and out[-1][1] >= end - n:
                out[-1] = (min(out[-1][0], end - n), end)
            else:
                out.append((end - n, end))
    return out


def _minimisers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window that lies within one text, and its smallest inner gram hash."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = words.grams(gram)
    least = grams[:n].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, grams[k : k + n], out=least)
    within = np.ones(n, bool)
    for end in words.first[1:-1]:
        within[max(0, end - window + 1) : end] = False
    at = np.flatnonzero(within)
    return at, least[at]


ANCHOR = "route long not null, anchor long not null, doc_id long, n int"


def _anchors(window: int, gram: int):
    """(route, anchor, doc_id, n): distinct minimisers of each document. One row of each goes to its own place, the rest anywhere.

    n in that one row is how many words the pieces here have, negative where several documents share the minimiser; it's 0 in the rest.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _portions(slices(batches, "text"), 48 << 20):
            docs, found, lengths = [], [], []
            for ids, words in ((i, Words(t)) for i, t in zip(batch, texts, strict=True)):
                at, least = _minimisers(words, window, gram)
                owner = np.searchsorted(words.first, at, "right") - 1
                keep = np.ones(len(at), bool)
                keep[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                docs.append(ids[owner[keep]])
                found.append(least[keep])
                lengths.append(np.diff(np.append(np.flatnonzero(keep), len(at))) + window - 1)
            doc, anchor, length = np.concatenate(docs), np.concatenate(found), np.concatenate(lengths)
            order = np.lexsort((doc, anchor))
            doc, anchor, length = doc[order], anchor[order], length[order]
            words_of = np.add.reduceat(length, np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))) if len(anchor) else length
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            doc, anchor = doc[new], anchor[new]
            lead = np.ones(len(doc), bool)
            lead[1:] = anchor[1:] != anchor[:-1]
            sizes = np.diff(np.append(np.flatnonzero(lead), len(lead)))
            n = np.zeros(len(lead), np.int32)
            n[lead] = np.where(sizes > 1, -words_of, words_of)
            route = np.where(lead, anchor.view(np.int64), doc)
            yield pa.record_batch({"route": pa.array(route), "anchor": pa.array(anchor.view(np.int64)), "doc_id": pa.array(doc), "n": pa.array(n)})

    return rows


def _portions(parts, size: int):
    """Groups of slices: lists of id arrays and of texts with about `size` bytes together."""
    ids, texts, n = [], [], 0
    for batch, text in parts:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        texts.append(text)
        n += text.nbytes
        if n >= size:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id) of the anchors that several documents have; rows come by anchor among those of one place."""

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch({"anchor": pa.array(np.concatenate([r[0] for r in rows])), "doc_id": pa.array(np.concatenate([r[1] for r in rows]))})

    held = None
    for batch in batches:
        anchor, doc, n = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (1, 2, 3))
        known = n <= 0
        if held is not None:
            anchor, doc, known = np.append(held[0], anchor), np.append(held[1], doc), np.append(held[2], known)
        if not len(anchor):
            continue
        lead = np.ones(len(anchor), bool)
        lead[1:] = anchor[1:] != anchor[:-1]
        starts = np.flatnonzero(lead)
        many = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        many |= np.logical_or.reduceat(known, starts)
        sizes = np.diff(np.append(starts, len(lead)))
        take = np.repeat(many, sizes)
        # the last anchor may go on in the next batch: one row of it is held back, known if it is shared by now
        last = starts[-1]
        take[-1] = False
        held = anchor[-1:], doc[-1:], np.array([many[-1]])
        if not many[-1]:
            take[last:] = False
            held = anchor[last:], doc[last:], known[last:]
        yield out([(anchor[take], doc[take])])
    if held is not None and (held[2].any() or held[1].min() < held[1].max()):
        yield out([held[:2]])


PIECE = "route long, anchor long, doc_id long, row long, start int, n int, words string"


def _pieces(window: int, gram: int):
    """Runs of windows under a shared minimiser: (route, anchor, doc_id, start, n words, words); without words where they're settled. Those of hot minimisers by window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}

        def settled(raw: bytes, doc: int) -> bool:
            seen = memory.get(raw)
            if seen is not None and seen < doc:
                return True
            if len(memory) >= MEMORY:
                memory.clear()
            memory[raw] = doc
            return False

        for batch, texts in slices(batches, "text"):
            words = Words(texts)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts_of = batch.column(4).to_pylist()
            lists, hot_lists = batch.column(2), batch.column(3)
            at, least = _minimisers(words, window, gram)
            owner = np.searchsorted(words.first, at, "right") - 1
            shared, hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
            ends = np.searchsorted(owner, np.arange(len(ids) + 1))
            for k in range(len(ids)):
                a, b = ends[k], ends[k + 1]
                if a < b and lists[k].is_valid:
                    shared[a:b] = np.isin(least[a:b], lists[k].values.to_numpy().view(np.uint64))
                    if len(hot_lists[k].values):
                        hot[a:b] = np.isin(least[a:b], hot_lists[k].values.to_numpy().view(np.uint64))
            run = np.ones(len(at), bool)
            run[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(run)
            last = np.append(first[1:], len(at)) - 1 if len(first) else first
            keep = shared[first] if len(first) else np.zeros(0, bool)
            first, last = first[keep], last[keep]
            order = np.argsort(ids[owner[first]], kind="stable")  # the smallest document first settles the most
            first, last = first[order], last[order]
            out: list[tuple] = []
            for f, t in zip(first.tolist(), last.tolist(), strict=True):
                doc, a, n = int(ids[owner[f]]), int(at[f]), int(at[t] - at[f] + window)
                parts = words.text(a, a + n).split()
                raw = b" ".join(parts)
                start, anchor, row = a - int(words.first[owner[f]]), int(least[f].view(np.int64)), texts_of[owner[f]]
                if settled(raw, doc):
                    out.append((doc, 0, doc, row, start, n, None))
                elif not hot[f]:
                    out.append((anchor, anchor, doc, row, start, n, raw))
                else:
                    for k in range(n - window + 1):
                        raw = b" ".join(parts[k : k + window])
                        if n > window and settled(raw, doc):
                            out.append((doc, 0, doc, row, start + k, window, None))
                        else:
                            place = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)
                            out.append((place, place, doc, row, start + k, window, raw))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.record_batch([*arrays[:6], arrays[6].cast(pa.string())], names=["route", "anchor", "doc_id", "row", "start", "n", "words"])

    return rows


def _matched(window: int):
    """(doc_id, row, start, stop) of the words that go; pieces come by anchor and doc_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = doc = None
        known: dict[str, tuple[int, list[tuple[int, int]]]] = {}  # first document with these words, and the spans found there
        automaton, waiting = Automaton(), []

        def settle():
            for words in waiting:
                automaton.add(words)
            waiting.clear()

        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            cols = [c.to_pylist() for c in batch.columns]
            for a, d, row, start, n, text in zip(*cols[1:], strict=True):
                if text is None:
                    out.append((d, row, start, start + n))
                    continue
                if a != anchor:
                    anchor, doc, known, automaton = a, d, {}, Automaton()
                    waiting.clear()
                elif d != doc:
                    settle()
                    doc = d
                first, found = known.get(text, (None, []))
                if first is None:
                    words = text.split(" ")
                    found = spans(automaton.statistics(words), window) if len(automaton.next) > 1 else []
                    known[text] = d, found
                    waiting.append(words)
                elif first < d:
                    found = [(0, n)]
                out += [(d, row, start + x, start + y) for x, y in found]
            ids, rows_, starts, stops = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows_, pa.int64()), "start": pa.array(starts, pa.int32()), "stop": pa.array(stops, pa.int32())})

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text", 4 << 20):
        n, gone, kept = [], [], []
        for text, cuts, row in zip(texts.to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            words = text.encode().split()
            n.append(len(words))
            if cuts.is_valid:
                stay = np.ones(len(words), bool)
                for c in cuts.as_py():
                    if c["row"] == row:
                        stay[c["start"] : c["stop"]] = False
                gone.append(int((~stay).sum()))
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def placed_pieces(known: DataFrame, window: int, gram: int, hot_words: int) -> DataFrame:
    """PIECE rows of documents that have ids (doc_id, text, row), each piece where those that it has to be compared with are."""
    anchors = known.mapInArrow(_anchors(window, gram), ANCHOR)
    routed = anchors.repartition("route")
    shared = routed.sortWithinPartitions("anchor").mapInArrow(_shared, "anchor long, doc_id long")
    # an anchor's own place has all its counts; every column is used and keys are not null, so no filter or projection keeps both from reading one exchange
    hot = routed.groupBy("route", "anchor").agg(F.sum(F.abs("n")).alias("words"), F.min("n").alias("least"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    hot = hot.where((F.col("words") > hot_words) & ((F.col("least") < 0) | (F.col("low") < F.col("high")))).select("anchor")
    # a filter of fixed size names the hot anchors; one that it names besides is split as well, for all documents alike
    lists = marked(shared, hot, "anchor", "is_hot").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"))
    # both joins read the same exchange of the texts by doc_id: Spark plans it once and uses it twice
    return known.join(lists, "doc_id", "left").select("doc_id", "text", "anchors", "hot", "row").mapInArrow(_pieces(window, gram), PIECE)


def dedup_substrings(docs: DataFrame, window: int = 13, gram: int = 5, hot_words: int = HOT) -> DataFrame:
    """Remove the words covered by a window of words that also occurs in a document with a smaller doc_id.

    Takes doc_id and text; words are runs of anything but ASCII white space, unchanged. Returns doc_id, n_words,
    n_removed, kept (the words left, joined by one space) and kept_sha256, a row for each row of docs. A null text has
    no words; documents shorter than the window lose none. A null doc_id takes no part: nothing is compared with it and
    it loses nothing. Rows that share a doc_id are compared with other documents only, never with each other. An empty table gives no rows. Other columns are ignored.
    """
    base = plain(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))  # tells rows with one doc_id apart
    known = base.where("doc_id IS NOT NULL")
    pieces = placed_pieces(known, window, gram, hot_words)
    cuts = pieces.repartition("route").sortWithinPartitions("anchor", "doc_id").mapInArrow(_matched(window), "doc_id long, row long, start int, stop int")
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "stop")).alias("cuts"))
    out = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    nameless = base.where("doc_id IS NULL").withColumn("cuts", F.lit(None).cast("array<struct<row bigint, start int, stop int>>"))
    return known.join(cuts, "doc_id", "left").select("doc_id", "text", "cuts", "row").mapInArrow(_cut, out).union(nameless.select("doc_id", "text", "cuts", "row").mapInArrow(_cut, out))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_substrings of all documents with windows of 13 words, without the words left."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
owner AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
late AS (SELECT doc_id, i FROM win JOIN owner USING (g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
marked AS (SELECT word.doc_id, word.i, word, gone.i IS NOT NULL AS out FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
