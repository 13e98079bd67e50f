"""Benchmark decontamination by BM25 with block-max WAND, then question and answer overlap.

Test items are an inverted index: for each term the items that hold it, with its BM25 weight over the item's own
best score, so that a passage's score for an item lies between 0 and 1 and one threshold serves all. Items are grouped in blocks; a
term's largest weight in a block bounds it for all items there. Every passage of every document is a query: passages
are windows of words that overlap enough to hold any item whole. The bounds of all passages of a batch come from one
cumulative sum a block; blocks whose bound reaches the threshold are opened, and in these the cursors of the passage's
terms go from pivot to pivot: an item is scored only when the bounds of the terms up to it can reach the threshold.
Items above it are verified on the words themselves: most of the question's and of the answer's word triples, or nearly all
of the whole item's, must be in the passage.

Document frequencies, the number of items and their mean length are taken over all items, and the length of passages
follows from an item's own length alone, so scores do not depend on how the index is split. The test items are small next
to the corpus: their size is measured, an index holds `index_bytes` of item text at most, and larger sets are indexed
and searched in parts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import Words, mix, plain, slices, table, written

#: Words are runs of letters, digits and non-ASCII characters.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
K1, B = 1.2, 0.75
#: Items of up to so many words share the length of passages, as do those of up to each further doubling.
SHORT = 64


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), separators=SEPARATORS)


def question_answer(text: str, least: int = 4) -> tuple[int, int]:
    """Words of the question and of the answer: the last sentence, or the last `least` words if it has fewer. With too little left, all words are both."""
    count = lambda t: len([w for w in re.split("[" + re.escape(SEPARATORS.decode()) + "]+", t) if w])
    total = count(text)
    ends = [m.end() for m in re.finditer(r"[.!?:][\s]+|\n", text.rstrip())]
    answer = max(count(text[ends[-1] :]) if ends else 0, least)
    return (total - answer, answer) if total - answer >= least else (total, total)


def step_of(n_words: int) -> int:
    """Words that passages of items with n_words advance by: the least doubling of SHORT that is no less."""
    return max(SHORT, 1 << (n_words - 1).bit_length())


class Statistics:
    """Document frequency of each term, number of items and their mean length, over all items."""

    def __init__(self, df: dict[int, int], n_items: int, mean: float):
        self.df, self.n_items, self.mean = df, n_items, mean


class Index:
    """Items that share a length of passages: terms, their weights by item, block maxima, and the word triples to verify."""

    def __init__(self, ids: np.ndarray, texts: list[str], known: Statistics, step: int, most_blocks: int = 32, least_block: int = 8):
        order = np.argsort([len(t) for t in texts], kind="stable")
        self.ids, texts = ids[order], [texts[k] for k in order]
        w = _words(pa.array(texts, pa.large_string()))
        item = np.repeat(np.arange(len(texts)), np.diff(w.first))
        self.terms, at = np.unique(w.hashes, return_inverse=True)
        pair, tf = np.unique(item * np.int64(len(self.terms)) + at, return_counts=True)
        item, term = pair // len(self.terms), pair % len(self.terms)
        sizes = np.diff(w.first)
        df = np.array([known.df[t] for t in self.terms.view(np.int64).tolist()], float)
        idf = np.log1p((known.n_items - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / known.mean))
        weight /= np.bincount(item, weight, len(texts))[item]
        a_block = max(least_block, -(-len(texts) // most_blocks))
        self.n_blocks, self.a_block, self.step = -(-len(texts) // a_block), a_block, step
        self.bounds = np.zeros((len(self.terms) + 1, self.n_blocks))  # the last row is for words outside the index
        np.maximum.at(self.bounds, (term, item // a_block), weight)
        # a block's postings by term, then item
        order = np.lexsort((item, term, item // a_block))
        item, term, weight = item[order], term[order], weight[order]
        cuts = np.searchsorted(item // a_block, np.arange(self.n_blocks + 1))
        self.blocks = [(term[a:b], item[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.parts = []
        for k, text in enumerate(texts):
            h = w.hashes[w.first[k] : w.first[k + 1]]
            q, a = question_answer(text)
            self.parts.append((_triples(h[: min(q, len(h))]), _triples(h[max(0, len(h) - a) :]), _triples(h)))

    def walk(self, block: int, held: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """(item, score) of a block's items with a score of `least` or more for a passage that holds the terms `held`.

        Each term of the passage has a cursor in its list of items. The pivot is the first item at which the bounds of the
        terms up to it add up to `least`; cursors before it skip to it, and with all of them there it is scored.
        """
        term, item, weight = (x[held[self.blocks[block][0]]] for x in self.blocks[block])
        cuts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)).tolist() if len(term) else [0]
        items, weights = item.tolist(), weight.tolist()
        cursors = [[items[a], a, z, float(self.bounds[term[a], block])] for a, z in zip(cuts, cuts[1:], strict=False)]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= least - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                return
            if cursors[0][0] == pivot:
                here = [c for c in cursors if c[0] == pivot]
                score = math.fsum(weights[c[1]] for c in here)
                if score >= least:
                    yield pivot, score
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                while c[1] < c[2] and items[c[1]] < target:
                    c[1] += 1
                c[0] = items[c[1]] if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def search(self, words: Words, least: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, end word, item, score) of passages and items with a score of `least` or more."""
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        term = np.where(self.terms[at] == words.hashes, at, len(self.terms))
        step, span, sizes = self.step, 2 * self.step, np.diff(words.first)
        counts = np.maximum(1, -(-(sizes - step) // step)) * (sizes > 0)
        text = np.repeat(np.arange(len(counts)), counts)
        start = words.first[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
        middle, end = (np.minimum(start + k, words.first[text + 1]) for k in (step, span))
        # a passage is two steps of words; a term counts once: where it is new in the first step, or new in both
        at = np.arange(len(term))
        own = at - (at - np.repeat(words.first[:-1], sizes)) % step
        order = np.argsort(term.astype(np.uint16) if len(self.terms) < 1 << 16 else term, kind="stable")
        before = np.full(len(term), -1)
        same = term[order[1:]] == term[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        known = term < len(self.terms)
        one, two = np.flatnonzero(known & (before < own)), np.flatnonzero(known & (before < own - step))
        cuts = [np.searchsorted(one, x) for x in (start, middle)], [np.searchsorted(two, x) for x in (middle, end)]
        for b in range(self.n_blocks):
            bound = 0.0
            for places, (x, y) in zip((one, two), cuts, strict=True):
                sums = np.concatenate([[0.0], np.cumsum(self.bounds[term[places], b])])
                bound = bound + sums[y] - sums[x]
            for k in np.flatnonzero(bound >= least - 1e-9):
                held = np.zeros(len(self.terms) + 1, bool)
                held[term[start[k] : end[k]]] = True
                for item, score in self.walk(b, held, least):
                    yield int(text[k]), int(start[k]), int(end[k]), item, score


def _triples(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct hashes of n words in a row; of all words, if they're fewer."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + h[k : k + len(out)])
    return np.unique(out)


def _leaks(indexes, least_score: float, least_question: float, least_answer: float, least_whole: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            words, best = _words(texts), {}
            ids = batch.column(0).to_pylist()
            for index in indexes.value:
                for text, a, b, item, score in index.search(words, least_score):
                    here = _triples(words.hashes[a:b])
                    q, ans, whole = (float(np.isin(part, here).mean()) for part in index.parts[item])
                    if q >= least_question and ans >= least_answer or whole >= least_whole:
                        key = text, int(index.ids[item])
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, ans))
            cols = list(zip(*((ids[t], i, *v) for (t, i), v in best.items()), strict=True)) if best else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return rows


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, words) for each distinct term of an item, which has `words` words in all."""
    for batch, texts in slices(batches, "text"):
        w = _words(texts)
        for k, item in enumerate(batch.column(0).to_pylist()):
            h = w.hashes[w.first[k] : w.first[k + 1]]
            t = np.unique(h).view(np.int64)
            yield pa.record_batch({"item": pa.array(np.full(len(t), item, np.int64)), "term": pa.array(t), "words": pa.array(np.full(len(t), len(h), np.int64))})


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, least_question: float = 0.6, least_answer: float = 0.6, least_whole: float = 0.8, index_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of documents that hold a test item.

    Takes doc_id and text, and item_id and text. score is the best passage's BM25 score over the item's own; overlaps
    are the shares of word triples of the item's question and answer in that passage. A passage that holds least_whole of
    all triples of the item counts whatever its parts; one that shares no term with an item never does. Letters are
    compared without case, punctuation is left out. Null texts and items without a word match nothing; repeated rows are
    found once each; a null doc_id keeps its rows. A text of any length is searched whole. Empty tables give no rows.
    Other columns are ignored. index_bytes changes the number of passes, not the result.
    """
    items = plain(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    items = written(items)
    terms = written(items.select("item", "text").mapInArrow(_term_rows, "item long, term long, words long"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_items, mean = terms.select("item", "words").distinct().agg(F.count("*"), F.avg("words")).first()
    groups = max(1, -(-size // index_bytes))
    group = F.pmod("item", F.lit(groups))
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    base, out, found = plain(docs, "doc_id", "text"), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double", None
    for g in range(groups):
        part = items.where(group == g).orderBy("item_id", "text").collect()  # index_bytes of text
        df = {r["term"]: r["df"] for r in frequency.join(terms.where(group == g).select("term").distinct(), "term").collect()}  # its terms
        lengths = np.diff(_words(pa.array([r["text"] for r in part], pa.large_string())).first).tolist()
        indexes = []
        for step in sorted({step_of(n) for n in lengths if n}):
            mine = [r for r, n in zip(part, lengths, strict=True) if n and step_of(n) == step]
            indexes.append(Index(np.array([r["item_id"] for r in mine], np.int64), [r["text"] for r in mine], Statistics(df, n_items, mean), step))
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        hits = base.mapInArrow(_leaks(shared, least_score, least_question, least_answer, least_whole), out)
        found = hits if found is None else found.unionByName(hits)
    return found


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item; documents without one have no row."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
