"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Equal sets, by two 64-bit sums and their size, are one node, named by the first sum or, where
different sets share that, by the second, whichever document holds it. The rest is filter and verify, over groups of similar nodes instead of single ones:

1. Every node lists the first few of its shingles in one order of all shingles, the rare ones first: as many that
   two sets that link share at least `hits` of them. Shingles that no other node lists are dropped.
2. Leaders: among the nodes of a shingle one of about their size leads; nodes are compared with their leaders
   only, and those that link form groups.
3. Matrix: a shingle's row names the groups, in blocks of similar size, whose union of listed shingles holds it.
   Counting a node's hits on a block bounds its overlap with any member, and so does what a node lists alone
   before a shingle; only blocks with enough hits are opened.
4. An opened block first compares sketches: the number of shingles in each of `BINS` bins of their hash. The sum of the
   smaller counts is never less than the overlap, so no link is lost, and few pairs that do not link pass.
5. Texts are read for what passed only. A block keeps the union of its members' whole sets. A node whose overlap
   with that union is too small for the threshold is done; otherwise it is compared with the members, up to the first
   link, since all members are one component already.

The order of shingles comes from counts over all documents, of which the `order_size` largest are kept; it moves work
about but any order gives the same links. A second round of leaders, drawn by hash, joins groups that the first left apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.llm.common import Words, mix, mostly, plain, slices, table, written
from siteq.llm.components import components

#: Sets that a task remembers as sent, and shingles that it counts at once.
MEMORY, AT_ONCE = 200_000, 6 << 20
#: Rows of a shingle that later ones are compared with; those beyond lead themselves and are left to the matrix.
LEADERS = 8
#: Bins of a sketch, and the largest count that one holds; a set with more in a bin has no sketch and always passes.
BINS, MOST = 64, (1 << 16) - 1
#: Shares of the rows of a hot group in a join.
SALTS = 16
#: Documents with a shingle for each task that its rows are dealt to, and first sums that several sets may share.
HOT_ROWS, MOST_TWINS = 50_000, 100_000


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of all its words, if they're fewer."""
    grams = words.grams(n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            yield g[keep]
        elif b > a:
            h = words.hashes[a:b]
            yield mix(np.bitwise_xor.reduce(h * np.arange(3, 2 * len(h) + 3, 2, dtype=np.uint64)).reshape(1) + np.uint64(len(h)))
        else:
            yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set."""
    a, b = mix(s), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def _name(sign: tuple[int, int], twins: frozenset[int]) -> int:
    """A node's name: the first sum of its set, or the second where several sets share the first."""
    return sign[1] if sign[0] in twins else sign[0]


def _node(twins: frozenset[int]) -> Column:
    return F.when(F.col("s1").isin(*twins), F.col("s2")).otherwise(F.col("s1")) if twins else F.col("s1")


def _twins(reps: DataFrame) -> frozenset[int]:
    """First sums that several sets share: none below some 10^9 sets, a handful beyond."""
    found = reps.groupBy("s1").agg(F.count("*").alias("k")).where("k > 1").select("s1").limit(MOST_TWINS + 1).collect()
    if len(found) > MOST_TWINS:
        raise RuntimeError("too many sets share a 64-bit sum")
    return frozenset(r["s1"] for r in found)


def _sketch(s: np.ndarray) -> bytes | None:
    """Shingles in each bin of the hash's lowest bits, as 16-bit counts."""
    counts = np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) <= MOST else None


DESCRIBED = "doc_id long, n long, s1 long, s2 long, sketch binary"


def _describe(n: int, least: int = 3):
    """Rows (doc_id, shingles, s1, s2, sketch) of documents; rows (null, count, shingle, null, null) of shingles that come up `least` times in what a task counts at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def batch_of(doc, size, s1, s2, sketch):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip((doc, size, s1, s2, sketch), kinds, strict=True)], names=["doc_id", "n", "s1", "s2", "sketch"])

        def counts():
            g = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held.clear()
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            many = np.diff(np.append(at, len(g)))
            keep = many >= least
            none = [None] * int(keep.sum())
            return batch_of(none, many[keep], g[at[keep]].view(np.int64), none, none)

        for batch, texts in slices(batches, "text"):
            sets = list(shingle_sets(Words(texts, lower=True), n))
            signs = [_signature(s) for s in sets]
            yield batch_of(batch.column(0), [len(s) for s in sets], [x[0] for x in signs], [x[1] for x in signs], [_sketch(s) for s in sets])
            held += sets
            total += sum(map(len, sets))
            if total >= AT_ONCE:
                yield counts()
                total = 0
        yield counts()

    return rows


class Rule:
    """Jaccard at least num / den, and the listed part of a set for which links share `hits` shingles."""

    def __init__(self, num: int, den: int, hits: int):
        self.num, self.den, self.hits = num, den, hits

    def overlap(self, size: int) -> int:
        """The least overlap of a set of this size with any that it links with."""
        return -(-size * self.num // self.den)

    def listed(self, size: int) -> int:
        need = self.overlap(size)
        return size - need + min(self.hits, need)

    def may(self, n: int, best: int, m: int, other: int) -> bool:
        """Whether sets of sizes n and m can link when they overlap in `best` and `other` at most."""
        return (self.num + self.den) * min(best, other) >= self.num * (n + m)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or self.den * len(a) < self.num * len(b):
            return False
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return self.den * both >= self.num * (len(a) + len(b) - both)


LISTED = "shingle long, node long, n int, pos int, salts int"


def _list(n: int, rule: Rule, order, twins):
    """(shingle, node, n, pos, salts) of the listed shingles of each set in order; equal sets of one task are listed once. salts: tasks for a shingle's rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = order.value
        sent: set[tuple[int, int]] = set()
        for batch, texts in slices(batches, "text"):
            out, ids, sizes, salts = [], [], [], []
            for s in shingle_sets(Words(texts, lower=True), n):
                if not len(s) or (sign := _signature(s)) in sent:
                    continue
                if len(sent) >= MEMORY:
                    sent.clear()
                sent.add(sign)
                ids.append(_name(sign, twins.value))
                sizes.append(len(s))
                p, deal = rule.listed(len(s)), np.ones(len(s), np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hit = common[at] == s
                    rare = s[~hit][:p]
                    by = np.argsort(often[at[hit]], kind="stable")[: p - len(rare)]
                    s = np.concatenate([rare, s[hit][by]])
                    deal[len(rare) : len(s)] = 1 + often[at[hit]][by] // HOT_ROWS
                out.append(s[:p])
                salts.append(deal[: len(out[-1])])
            if out:
                lengths = [len(x) for x in out]
                yield pa.record_batch({"shingle": pa.array(np.concatenate(out).view(np.int64)), "node": pa.array(np.repeat(np.array(ids, np.int64), lengths)), "n": pa.array(np.repeat(np.array(sizes, np.int32), lengths)), "pos": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])), "salts": pa.array(np.concatenate(salts))})

    return rows


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repeated rows and the shingles that only one node lists, unless their rows are dealt to several tasks; rows come by shingle and node."""
    held, seen = None, None  # a shingle's only row so far; the shingle and node of the last row that has gone on
    for batch in batches:
        if held is not None and batch.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        shingle, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.append(seen is None or seen != (shingle[0], node[0]), (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]))
        if not first.any():
            continue
        batch, shingle, node = batch.filter(pa.array(first)), shingle[first], node[first]
        new = np.append(True, shingle[1:] != shingle[:-1])
        alone = new & np.append(new[1:], True)
        alone &= batch.column(4).to_numpy() == 1
        if seen is not None:
            alone &= shingle != seen[0]
        held = batch.slice(batch.num_rows - 1) if alone[-1] else None
        seen = None if alone[-1] else (shingle[-1], node[-1])
        yield batch.filter(pa.array(~alone))


MATRIX = "shingle long, node long, n int, best int"


def _lead(rule: Rule):
    """Adds the leader to the rows of each shingle: the first row that it may link with. Those that share most come first.

    A shingle all of whose rows were compared and of which no two may link is dropped, unless they were dealt to several tasks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders, waiting = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for *row, salts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                shingle, node, n, best = row
                if shingle != last:
                    last, leaders, waiting = shingle, [], []
                lead = next((d for d, size, most in leaders if rule.may(n, best, size, most)), None)
                if lead is None and len(leaders) < LEADERS:
                    leaders.append((node, n, best))
                    if salts == 1 and len(leaders) < LEADERS and (waiting or len(leaders) == 1):
                        waiting.append((*row, node))
                        continue
                out += waiting
                waiting = []
                out.append((*row, node if lead is None else lead))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shingle", "node", "n", "best", "leader"])

    return rows


def _near(rule: Rule):
    """(block, a, b) of a query and each member of its cell that its sketch lets it link with; a cell's members come before its queries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sizes, counts = None, [], [], []
        stacked = None
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for block, part, is_query, node, n, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, part) != cell:
                    cell, nodes, sizes, counts, stacked = (block, part), [], [], [], None
                own = np.frombuffer(sketch, "<u2").astype(np.int64) if sketch is not None else np.full(BINS, 1 << 40)
                if not is_query:
                    nodes.append(node)
                    sizes.append(n)
                    counts.append(own)
                    continue
                if not nodes:
                    continue
                if stacked is None:
                    stacked = np.array(nodes, np.int64), np.array(sizes, np.int64), np.stack(counts)
                most = np.minimum(np.minimum(stacked[2], own).sum(axis=1), np.minimum(stacked[1], n))
                found += [(block, node, b) for b in stacked[0][(rule.num + rule.den) * most >= rule.num * (stacked[1] + n)].tolist() if b != node]
            yield pa.record_batch({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(("block", "a", "b"))})

    return rows


def _open(n: int, rule: Rule, twins):
    """(a, b) of a query and the first member that it links with; a cell's members come before its queries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, union = None, [], None
        for batch, texts in slices(batches, "text"):
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for (block, part, is_query, node), s in zip(keys, shingle_sets(Words(texts, lower=True), n), strict=True):
                if (block, part) != cell:
                    cell, members, union = (block, part), [], None
                if not len(s) or _name(_signature(s), twins.value) != node:
                    continue  # another row of the document that stands for the node
                if not is_query:
                    members.append((node, s))
                    continue
                if not members:
                    continue
                if union is None:
                    union = members[0][1] if len(members) == 1 else np.unique(np.concatenate([m for _, m in members]))
                    smallest = min(len(m) for _, m in members)
                bound = int((union[np.minimum(np.searchsorted(union, s), len(union) - 1)] == s).sum())
                if rule.den * bound < rule.num * max(len(s), smallest):
                    continue
                if (b := next((d for d, m in members if d != node and rule.links(s, m)), None)) is not None:
                    found.append((node, b))
            yield pa.record_batch({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows


def _cells(asked: DataFrame, members: DataFrame, a_cell: int) -> DataFrame:
    """(block, cell, is_query, node): a block's queries go to cells of about a_cell, each with the members."""
    cells = asked.groupBy("block").agg(F.ceil(F.count("*") / a_cell).cast("int").alias("cells"))
    queries = asked.join(cells, "block").select("block", F.pmod(F.xxhash64("node"), "cells").cast("int").alias("cell"), F.lit(1).alias("is_query"), "node")
    held = members.join(cells, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("is_query"), "node")
    return queries.union(held)


def _texts_of(nodes: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
    """(node, text) of the documents that stand for the nodes."""
    wanted = written(nodes.distinct().join(reps.select("node", "doc_id"), "node"))
    return mostly(known, wanted).join(wanted, "doc_id").select("node", "text")


def _compare(asked: DataFrame, members: DataFrame, reps: DataFrame, known: DataFrame, n: int, rule: Rule, twins, a_cell: int = 128) -> DataFrame:
    """Links (a, b) of asked (block, node) with members (block, node): by sketches first, then by the texts of what they left."""
    rows = _cells(asked, members, a_cell).join(reps.select("node", "n", "sketch"), "node").select("block", "cell", "is_query", "node", "n", "sketch")
    near = written(rows.repartition("block", "cell").sortWithinPartitions("block", "cell", "is_query").mapInArrow(_near(rule), "block long, a long, b long"))
    asked, members = near.select("block", F.col("a").alias("node")).distinct(), near.select("block", F.col("b").alias("node")).distinct()
    texts = _texts_of(near.select(F.explode(F.array("a", "b")).alias("node")), reps, known)
    rows = _cells(asked, members, a_cell).join(texts, "node").select("block", "cell", "is_query", "node", "text")
    return written(rows.repartition("block", "cell").sortWithinPartitions("block", "cell", "is_query").mapInArrow(_open(n, rule, twins), "a long, b long"))


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, hits: int = 3, order_size: int = 1 << 18, min_count: int = 24, a_block: int = 128, leader_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set, and the least doc_id that links reach.

    Takes doc_id and text. Words are runs of anything but ASCII white space, with A-Z folded; a set holds the distinct
    n-word shingles, or the whole sequence of fewer words. Two sets link when den * intersection >= num * union. A null
    text or one without words is the empty set, linked with nothing. Rows with one doc_id are one document, linked by the
    links of all of them, with a row each. A null doc_id takes no part and has a null component. An empty table
    gives no rows. Other columns are ignored. Shingles are compared by 64-bit hashes, whole sets by two of them and their size.
    """
    spark = docs.sparkSession
    rule = Rule(num, den, hits)
    base = plain(docs, "doc_id", "text")
    known = base.where("doc_id IS NOT NULL AND text IS NOT NULL")
    described = written(known.mapInArrow(_describe(n), DESCRIBED))
    sets = described.where("doc_id IS NOT NULL")
    # equal sets are one node, for which the least document stands
    reps = written(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min_by(F.struct("doc_id", "sketch"), "doc_id").alias("x")).select("s1", "s2", F.col("n").cast("int").alias("n"), "x.*"))
    twins = _twins(reps)
    reps = reps.select(_node(twins).alias("node"), "doc_id", "n", "sketch")
    if twins and reps.select("node").distinct().count() < reps.count():
        raise RuntimeError("different sets share both sums")
    sets, twins = sets.withColumn("node", _node(twins)), spark.sparkContext.broadcast(twins)
    # the most common shingles, order_size at most, go to the end of the order
    common = described.where("doc_id IS NULL").groupBy("s1").agg(F.sum("n").alias("many")).where(F.col("many") >= min_count)
    common = common.orderBy(F.desc("many"), "s1").limit(order_size).toArrow()
    shingle, many = common.column("s1").to_numpy().view(np.uint64), common.column("many").to_numpy()
    at = np.argsort(shingle)
    order = spark.sparkContext.broadcast((shingle[at], many[at]))
    listed = known.mapInArrow(_list(n, rule, order, twins), LISTED)
    part = F.pmod(F.xxhash64("node"), "salts")  # a hot shingle's rows go to several tasks
    shared = written(listed.repartition("shingle", part).sortWithinPartitions("shingle", "node").mapInArrow(_several, LISTED))
    need = F.least(F.lit(hits), F.ceil(F.col("n") * num / den)).cast("int")
    alive = shared.groupBy("node", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need).select("node", "k")
    # what a node lists alone before a shingle is in no other that lists this shingle: it bounds their overlap
    alone = F.col("pos") - F.row_number().over(Window.partitionBy("node").orderBy("pos")) + 1
    bounded = shared.join(alive, "node").withColumn("best", F.col("n") - alone).where(F.col("best") * den >= F.col("n") * num)
    matrix = written(bounded.repartition("shingle", part).sortWithinPartitions("shingle", F.desc("k"), "node").select("shingle", "node", "n", "best", "salts").mapInArrow(_lead(rule), MATRIX + ", leader long"))
    links = None
    for turn in range(leader_rounds):
        asked = written(matrix.where("node <> leader").groupBy("node", "n", F.col("leader").alias("block")).agg(F.count("*").alias("k")).where(F.col("k") >= need).select("block", "node"))
        members = asked.select("block").distinct().select("block", F.col("block").alias("node"))
        more = _compare(asked, members, reps, known, n, rule, twins)
        links = more if links is None else written(links.union(more))
        matrix = _regroup(matrix.select("shingle", "node", "n", "best"), links)
        if turn == leader_rounds - 1:
            break
        # other leaders: in each shingle and size the row with the least hash for this turn
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
        lead = matrix.groupBy("shingle", band.alias("band")).agg(F.min_by(F.struct("node", "group"), F.xxhash64("group", F.lit(turn))).alias("x"))
        matrix = written(matrix.withColumn("band", band).join(lead, ["shingle", "band"]).withColumn("leader", F.when(F.col("group") == F.col("x.group"), F.col("node")).otherwise(F.col("x.node"))).drop("x", "band"))
    links = links.union(_across(matrix, reps, known, n, rule, twins, need, a_block))
    return _answer(base, sets, reps, links)


def _regroup(matrix: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of shingles that several groups list, with each node's group.

    A group is what links reach from a node in two steps to the least end, so equal groups are one component.
    """
    to = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("one"))
    two = to.join(to.select(F.col("node").alias("one"), F.col("one").alias("two")), "one", "left").select("node", F.coalesce("two", "one").alias("group"))
    labelled = matrix.join(two, "node", "left").withColumn("group", F.coalesce("group", "node"))
    several = labelled.groupBy("shingle").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("shingle")
    return written(labelled.join(several, "shingle"))


def _salted(rows: DataFrame, per_group: DataFrame, keys: list[str], by: str = "node", how: str = "inner") -> DataFrame:
    """rows joined with one row for each group; a hot group's rows go to SALTS tasks, dealt by the column `by`."""
    spread = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [*keys, "salt"], how).drop("salt")


def _across(matrix: DataFrame, reps: DataFrame, known: DataFrame, n: int, rule: Rule, twins, need, a_block: int) -> DataFrame:
    """Links between groups: nodes of the smaller group ask the blocks of the larger one that enough of their shingles hit."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(rule.den / rule.num)))
    nodes = written(matrix.select("node", "group", "n").distinct().withColumn("band", band))
    sizes = written(nodes.groupBy("group").agg(F.count("*").alias("size")))
    per = written(nodes.groupBy("group", "band").agg(F.ceil(F.count("*") / a_block).cast("int").alias("parts")))
    place = F.xxhash64("group", "band", F.pmod(F.xxhash64("node"), "parts"))
    nodes = written(_salted(_salted(nodes, sizes, ["group"]), per, ["group", "band"]).select("node", "group", "size", "band", place.alias("block")))
    rows = written(matrix.drop("group").join(nodes, "node").select("shingle", "node", "n", "best", "group", "size", "band", "block"))
    least = rows.groupBy("block").agg(F.min("n").alias("to_n"))
    unions = rows.groupBy("shingle", "block", F.col("group").alias("to"), F.col("size").alias("to_size"), F.col("band").alias("to_band")).agg(F.max("best").alias("to_best")).join(least, "block")
    asks = rows.select("shingle", "node", "n", "best", "group", "size", "band")
    smaller = (F.col("size") < F.col("to_size")) | ((F.col("size") == F.col("to_size")) & (F.col("group") > F.col("to")))
    may = (rule.num + rule.den) * F.least("best", "to_best") >= rule.num * (F.col("n") + F.col("to_n"))
    asked = asks.join(unions, "shingle").where(smaller & may & (F.abs(F.col("band") - F.col("to_band")) <= 1)).groupBy("node", "n", "block").agg(F.count("*").alias("k")).where(F.col("k") >= need)
    return _compare(written(asked.select("block", "node")), nodes.select("block", "node"), reps, known, n, rule, twins)


def _answer(base: DataFrame, sets: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each row of base: those that have a set from `sets`, the others as the empty set.

    Components are those of the documents that stand for nodes, and of documents with several rows, which tie their sets together.
    """
    of = reps.select("node", "doc_id")
    between = links.join(of.withColumnRenamed("doc_id", "x"), F.col("a") == F.col("node")).drop("node").join(of.withColumnRenamed("doc_id", "y"), F.col("b") == F.col("node")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = sets.select("doc_id", "n", "node")
    copies = rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = written(_salted(rows, copies, ["node", "n"], "doc_id", "left").select("doc_id", "n", F.coalesce("least", "doc_id").alias("first")))
    again = rows.groupBy("doc_id").agg(F.min("first").alias("x"), F.max("first").alias("y")).where("x <> y")
    again = again.select(F.col("doc_id").alias("a"), F.explode(F.array("x", "y")).alias("b"))
    reach = components(between.union(again)).withColumnRenamed("id", "first")
    some = rows.join(reach, "first", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))
    empty = base.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(empty)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components of all documents, with the four-word shingles and the similarity of 0.85 that the query asks for."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
two AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
