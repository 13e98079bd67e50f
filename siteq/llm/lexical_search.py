"""Ranked lexical search with Block-Max MaxScore over an index in the shared folder.

The index is built where the documents are: a task turns what it reads into shards of bounded size, and each shard is one row. It holds, for each
term, the documents with the term in blocks of up to 128, packed as differences in as few bytes as they need, and beside the packed block what bounds it:
its last document and, for each frequency that occurs in it, the shortest document with that frequency. From these follow the exact largest
weights of block and list once the number and the mean length of all documents are known, without opening a block.

A query goes through a shard's lists from the largest bound to the smallest. Once the bounds of the lists that are left add up to less than the
k-th score so far, no document that stands in these lists only can be among the k best: the lists before are essential, and their documents the candidates. Of the
other lists, block maxima alone are added up first; a candidate whose sum stays below the k-th score is rejected and its blocks stay packed. The
k best of a query go from shard to shard of a task, and those of all tasks are merged by a window. All of a shard's work is numpy on whole
lists or blocks, in 64-bit integers, so results do not depend on how documents are dealt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.llm.common import Words, plain, slices, table, written

#: Terms are runs of ASCII letters, digits and non-ASCII characters.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Postings of a block; documents and bytes of text of a shard, unless one text is longer.
BLOCK, SHARD_DOCS, SHARD_BYTES = 128, 1 << 14, 16 << 20
#: Bytes of query text that are searched at once, and distinct query terms up to which the index holds these only.
QUERY_BYTES, MOST_TERMS = 8 << 20, 1 << 20
K = 20
#: Columns of an index row: ids and lengths by document; terms and their first blocks; by block the last document, where it is packed and
#: in how many bytes a number, and the frequencies with their shortest documents.
ARRAYS = {
    "ids": np.int64, "missing": np.bool_, "lengths": np.int64, "terms": np.int64, "first": np.int64, "last": np.int32, "at": np.int64, "wide": np.uint8, "narrow": np.uint8,
    "top_first": np.int64, "top_tf": np.int32, "top_length": np.int64, "packed": np.uint8,
}
INDEX = "n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in ARRAYS)
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def pack(ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> dict:
    """An index row: documents of a shard, and its postings in any order, each pair of term and document once."""
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order]
    new = np.append(True, term[1:] != term[:-1])[: len(term)]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(term)))
    blocks = -(-sizes // BLOCK)  # of each list
    first = np.append(0, np.cumsum(blocks))
    cuts = np.repeat(starts, blocks) + BLOCK * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    ends = np.append(cuts[1:], len(term))[: len(cuts)]
    gaps = doc - np.where(new, -1, np.append(-1, doc[:-1])[: len(doc)])
    wide, narrow = (_width(np.maximum.reduceat(x, cuts)) if len(cuts) else np.zeros(0, np.uint8) for x in (gaps, tf))
    parts, at = [], np.zeros(len(cuts), np.int64)
    for k, (a, z, w, n) in enumerate(zip(cuts.tolist(), ends.tolist(), wide.tolist(), narrow.tolist(), strict=True)):
        parts += [gaps[a:z].astype(_WIDTHS[w]).tobytes(), tf[a:z].astype(_WIDTHS[n]).tobytes()]
        at[k] = (z - a) * (w + n)
    # the shortest document of each block and frequency
    block = np.repeat(np.arange(len(cuts)), ends - cuts)
    by = np.lexsort((lengths[doc], tf, block))
    best = by[np.append(True, (block[by][1:] != block[by][:-1]) | (tf[by][1:] != tf[by][:-1]))[: len(by)]]
    row = {
        "ids": ids, "missing": missing, "lengths": lengths, "terms": term[starts], "first": first, "last": doc[ends - 1], "at": np.append(0, np.cumsum(at)), "wide": wide, "narrow": narrow,
        "top_first": np.searchsorted(block[best], np.arange(len(cuts) + 1)), "top_tf": tf[best], "top_length": lengths[doc[best]], "packed": np.frombuffer(b"".join(parts), np.uint8),
    }
    return {"n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())} | {c: row[c].astype(kind).tobytes() for c, kind in ARRAYS.items()}


def _index_rows(vocabulary, shard_docs: int, shard_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, posts, size = vocabulary.value if vocabulary else None, [], [], 0

        def row() -> pa.RecordBatch:
            ids, missing, lengths = (np.concatenate(x) for x in zip(*docs, strict=True))
            packed = pack(ids, missing, lengths, *(np.concatenate(x) for x in zip(*posts, strict=True)))
            return pa.record_batch([pa.array([packed[c]], pa.int64() if c.startswith("n_") else pa.binary()) for c in packed], names=list(packed))

        for batch, texts in slices(batches, "text"):
            for at in range(0, len(texts), shard_docs):
                part, ids = texts.slice(at, shard_docs), batch.column(0).slice(at, shard_docs)
                w = Words(part, lower=True, separators=SEPARATORS)
                lengths, term = np.diff(w.first), w.hashes.view(np.int64)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                if known is not None:
                    place = np.minimum(np.searchsorted(known, term), len(known) - 1) if len(known) else np.zeros(len(term), np.int64)
                    held = known[place] == term if len(known) else np.zeros(len(term), bool)
                    doc, term = doc[held], term[held]
                names, term = np.unique(term, return_inverse=True)
                pair, tf = np.unique(doc * np.int64(max(1, len(names))) + term, return_counts=True)
                base = sum(len(d[0]) for d in docs)
                if docs and (base + len(lengths) > shard_docs or size + len(w.data) > shard_bytes):
                    yield row()
                    docs, posts, size, base = [], [], 0, 0
                docs.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), lengths))
                posts.append((names[pair % max(1, len(names))], base + pair // max(1, len(names)), tf))
                size += len(w.data)
        if docs:
            yield row()

    return rows


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of docs (doc_id, text), written to the shared folder; with a vocabulary of term hashes, of postings of these terms only.

    Lengths and counts are of all terms of all documents in any case.
    """
    known = docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary)) if vocabulary is not None else None
    return written(plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_index_rows(known, shard_docs, shard_bytes), INDEX))


class Shard:
    """An index row with the weights that follow from the number of documents and of terms of the whole corpus."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        for c, kind in ARRAYS.items():
            setattr(self, c, np.frombuffer(row[c], kind))
        self.n_docs, self.n_terms = n_docs, n_terms
        self.norms = self._norm(self.lengths)
        self.block_max = np.maximum.reduceat(self._weight(self.top_tf.astype(np.int64), self._norm(self.top_length)), self.top_first[:-1]) if len(self.last) else np.zeros(0, np.int64)
        self.list_max = np.maximum.reduceat(self.block_max, self.first[:-1]) if len(self.terms) else np.zeros(0, np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _norm(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + (25 * lengths * self.n_docs) // max(1, self.n_terms)

    @staticmethod
    def _weight(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weights of a block of a term's list, which is unpacked when it is first asked for."""
        if b not in self.open:
            wide, narrow, raw = int(self.wide[b]), int(self.narrow[b]), self.packed[self.at[b] : self.at[b + 1]]
            n = len(raw) // (wide + narrow)
            before = -1 if b == self.first[term] else int(self.last[b - 1])
            docs = before + np.cumsum(np.frombuffer(raw[: n * wide].tobytes(), _WIDTHS[wide]).astype(np.int64))
            tf = np.frombuffer(raw[n * wide :].tobytes(), _WIDTHS[narrow]).astype(np.int64)
            self.open[b] = docs, self._weight(tf, self.norms[docs])
        return self.open[b]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold all of the shard's k best with a score of `least` or more, and above 0."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1) if len(self.terms) else np.zeros(len(terms), np.int64)
        here = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        bounds = self.list_max[at] * weights
        order = np.argsort(bounds, kind="stable")
        at, weights, left = at[order].tolist(), weights[order].tolist(), np.append(0, np.cumsum(bounds[order])).tolist()
        scores, i, rising, least = np.zeros(len(self.lengths), np.int64), len(at), least <= 1, max(least, 1)
        while i and left[i] >= least:  # essential lists
            i -= 1
            t, w = at[i], weights[i]
            for b in range(int(self.first[t]), int(self.first[t + 1])):
                docs, weight = self.block(t, b)
                scores[docs] += w * weight
            if rising and i:  # without a score to beat, the k-th of the sums so far is one
                some = scores[scores > 0]
                if len(some) >= k:
                    least = max(least, int(np.partition(some, len(some) - k)[len(some) - k]))
        docs = np.flatnonzero((scores > 0) & (scores + left[i] >= least))
        known = scores[docs]
        # what the other lists can add to each candidate: the maximum of the block where it would stand
        places, most = [], []
        for j in range(i):
            t = at[j]
            a, z = int(self.first[t]), int(self.first[t + 1])
            b = a + np.searchsorted(self.last[a:z], docs)
            places.append(b)
            most.append(np.where(b < z, self.block_max[np.minimum(b, z - 1)] * weights[j], 0))
        bound = known + sum(most) if most else known
        for j in reversed(range(i)):
            keep = np.flatnonzero(bound >= least)
            if len(keep) < len(docs):
                docs, known, bound, places, most = docs[keep], known[keep], bound[keep], [p[keep] for p in places[: j + 1]], [m[keep] for m in most[: j + 1]]
            asked = np.flatnonzero(most[j] > 0)
            gain = np.zeros(len(docs), np.int64)
            cuts = np.flatnonzero(np.diff(places[j][asked], prepend=-1)) if len(asked) else np.zeros(0, np.int64)
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(asked)], strict=False):
                some = asked[a:z]  # candidates of one block
                held, weight = self.block(at[j], int(places[j][some[0]]))
                spot = np.minimum(np.searchsorted(held, docs[some]), len(held) - 1)
                gain[some] = np.where(held[spot] == docs[some], weight[spot] * weights[j], 0)
            known, bound = known + gain, bound - most[j] + gain
        keep = known >= least
        return docs[keep], known[keep]


class Best:
    """The k best documents so far of a query, by falling score, then rising id, those without one last."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.missing = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that a document needs."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = np.append(self.score, score), np.append(self.ids, ids), np.append(self.missing, missing)
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.ids, self.missing = score[order], ids[order], missing[order]


def _search_rows(queries, n_docs: int, n_terms: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = queries.value, [Best(k) for _ in queries.value]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ARRAYS}, n_docs, n_terms)
                for (_, _, terms, weights), b in zip(asked, best, strict=True):
                    docs, scores = shard.search(terms, weights, k, b.least)
                    if len(docs):
                        b.add(scores, shard.ids[docs], shard.missing[docs])
        for (q, item, _, _), b in zip(asked, best, strict=True):
            if n := len(b.score):
                yield pa.record_batch([pa.array([q] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(b.ids, pa.int64(), mask=b.missing), pa.array(b.score)], names=["q", "item_id", "doc_id", "score"])

    return rows


def _list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each shard: a list's blocks are full but for the last one."""
    for batch in batches:
        for row in range(batch.num_rows):
            terms, first, at, wide, narrow = (np.frombuffer(batch.column(k)[row].as_py(), ARRAYS[c]) for k, c in enumerate(("terms", "first", "at", "wide", "narrow")))
            last = first[1:] - 1
            tail = (at[last + 1] - at[last]) // (wide[last].astype(np.int64) + narrow[last])
            yield pa.record_batch({"term": pa.array(terms), "df": pa.array((last - first[:-1]) * BLOCK + tail)})


def _query_terms(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.large_string()), lower=True, separators=SEPARATORS)
    return [w.hashes[a:z].view(np.int64) for a, z in zip(w.first, w.first[1:], strict=False)]


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches, "text"):
        yield pa.record_batch({"term": pa.array(np.unique(Words(texts, lower=True, separators=SEPARATORS).hashes).view(np.int64))})


def search(docs: DataFrame, items: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES, most_terms: int = MOST_TERMS, **index) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text), fewer if fewer score above 0.

    A score is the sum over the item's terms, repeats included, of w * (10^9 * tf div (1000 * tf + 12 * m)), in whole numbers: w is 1000 * ln((2N + 2) / (2df + 1)) rounded down, m is
    75 + 25 * n * N div L, of N documents with a term, L terms in all, n terms of the document, tf of them this one, which df documents hold. Equal scores go by doc_id,
    null ids last. Terms are compared by 64-bit hash, letters A-Z without case. A null or empty text has no terms: such an item has no rows, such a document is never found. Documents are rows: those that share an id are found each.
    Items are the distinct pairs of id and text. Empty tables give no rows. Texts of any length are indexed whole. Other columns are ignored.

    The size of the items is measured: query_bytes of their text are searched at once, more in so many passes over the index, and an index of the items' terms only is
    made if they are most_terms or fewer, else one of all terms. Neither changes the result.
    """
    spark = docs.sparkSession
    items = written(plain(items, "item_id", "text").where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    terms = written(items.select("text").mapInArrow(_distinct_terms, "term long").distinct())
    vocabulary = np.array([r["term"] for r in terms.collect()], np.int64) if terms.count() <= most_terms else None
    held = build_index(docs, vocabulary, **index)
    n_docs, n_terms = (int(x or 0) for x in held.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    frequency = written(held.select("terms", "first", "at", "wide", "narrow").mapInArrow(_list_sizes, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")))
    groups, found = max(1, -(-size // query_bytes)), None
    for g in range(groups):
        part = items.where(F.pmod("item", F.lit(groups)) == g).orderBy("item_id", "text").collect()  # query_bytes of text
        counts = [Counter(t.tolist()) for t in _query_terms([r["text"] for r in part])]
        mine = spark.createDataFrame([(t,) for t in set().union(*counts)], "term long")
        weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in frequency.join(mine, "term").collect()}
        asked = []
        for n, (r, c) in enumerate(zip(part, counts, strict=True)):
            names = sorted(t for t in c if t in weight)
            asked.append((g << 32 | n, r["item_id"], np.array(names, np.int64), np.array([weight[t] * c[t] for t in names], np.int64)))
        best = held.mapInArrow(_search_rows(spark.sparkContext.broadcast(asked), n_docs, n_terms, k), "q long, item_id long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))  # k rows of each task
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item, over all documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
i AS (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, s.n),
v AS (SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * p.n * s.n) // s.l))) AS x FROM p JOIN f USING (term), s),
a AS (SELECT item_id, r, doc_id, sum(c * x)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM a WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {K}
"""
