"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are packed into blocks of a fixed length, in the order of a keyed hash of its documents. A source
fills as many output slots as its target asks for. Slots belong to output shards: a keyed permutation of all slot
numbers deals the slots of all sources over the shards, so the source counts of a shard are a multinomial draw given the
totals of the whole mix, and the totals meet the targets to within a block. The j-th slot of a source takes block
permutation(j mod blocks) of a permutation of its own for each pass. The inverse permutations tell each piece of a block
the slots that it goes to, so the words are dealt with one shuffle by shard and no join, and written shard by shard.

The permutations are swap-or-not networks: every round maps x to key - x or leaves it, by a hash of the larger of the
two. They need no table, work for any size, each row computes its own place, and the rounds backwards are the inverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.llm.common import mostly, plain, table, written

WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, size: Column, key: Column, rounds: int = 8, inverse: bool = False) -> Column:
    """The place of x, 0 <= x < size, in the pseudorandom permutation of 0 to size - 1 that key names, or in its inverse."""
    size, key = size.cast("long"), F.xxhash64(key)
    keys = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.pmod(F.xxhash64(key, r), size))

    def turn(place: Column, k: Column) -> Column:
        other = F.pmod(k - place, size)
        swap = F.xxhash64(k, F.greatest(place, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(place)

    return F.aggregate(F.reverse(keys) if inverse else keys, x.cast("long"), turn)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Adds number (from 0, by source, null last) and target to a row for each source with its source_size.

    Shares of the total go by weight; a source stops at `most` times its size and the excess goes to the others by
    weight. That is target = min(most * size, level * weight) for one level, found by sorting sources by the level at
    which they stop. The windows run over one row a source.
    """
    everything = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("number", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.pmod(F.col("number"), F.lit(len(weights)))
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), pick.cast("int") + 1))
    rows = rows.withColumns({"cap": F.col("source_size") * float(most), "stops_at": F.col("source_size") * float(most) / F.col("weight")})
    by_stop = everything.orderBy("stops_at", "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_cap": F.coalesce(F.sum("cap").over(by_stop), F.lit(0.0)), "_weight": F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0)), "_total": F.sum("source_size").over(everything), "_weights": F.sum("weight").over(everything)})
    level = (F.col("_total") - F.col("_cap")) / (F.col("_weights") - F.col("_weight"))
    rows = rows.withColumn("_level", F.when(level <= F.col("stops_at"), level))
    rows = rows.withColumn("_level", F.min_by("_level", F.when(F.col("_level").isNotNull(), F.col("stops_at"))).over(everything))
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "n_docs", "number", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block_words: int = 256, shard_slots: int = 1024, docs_a_bucket: int = 5_000, seed: int = 5, few_sources: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (documents, slots, pieces).

    documents: doc_id, source, size, source_size, target, taken for each row of docs, where taken is counted in slots.
    slots: the mixed text, read from the shared folder: number, shard, slot, pass, block, text (the block's words
    joined by one space) parts (doc_id, start of the document in its source, words) in the order of the text, and source. A shard lies
    in one file, in order of slot. pieces: number, block, doc_id, first word, words: which words of which documents make up a block.
    Takes doc_id, source and text. A null or empty text has size 0 and is never taken; a null source is a source of its
    own; repeated rows count as often as they come. All sources together are the total to fill. The same input gives
    the same mix. An empty table gives no rows. Other columns are ignored.
    """
    sized = plain(docs, "doc_id", "source", "text").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    counted = written(sized)
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = targets(sizes, weights, most)
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    want = F.when(F.col("source_size") > 0, F.round(F.col("target") * n_blocks / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumns({"n_blocks": n_blocks, "n_slots": F.least(want, most * n_blocks), "buckets": F.ceil(F.col("n_docs") / docs_a_bucket).cast("long")})
    before = Window.partitionBy(F.lit(0)).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    plan = written(plan.withColumns({"first_slot": F.coalesce(F.sum("n_slots").over(before), F.lit(0)), "all_slots": F.sum("n_slots").over(Window.partitionBy(F.lit(0)))}))
    small = F.broadcast(plan) if plan.count() <= few_sources else plan

    # where each document's words start in its source: prefix sums over buckets, then within a bucket
    keys = ("number", "source_size", "target", "n_blocks", "n_slots", "first_slot", "all_slots")
    numbered = counted.join(small, counted["source"].eqNullSafe(plan["source"])).select("doc_id", counted["source"], "size", "draw", *keys, F.pmod("draw", "buckets").alias("bucket"))
    totals = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(totals.select("number", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("bucket_start")))
    within = Window.partitionBy("number", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.join(starts, ["number", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = written(placed.drop("bucket", "bucket_start"))

    # pieces: a document's words cut at the ends of blocks
    end = F.col("start") + F.col("size")
    numbers = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    first = lambda b: F.greatest(F.col("start"), b * block_words) - F.col("start")
    count = lambda b: F.least(end, (b + 1) * block_words) - F.col("start") - first(b)
    blocks = placed.where("size > 0").withColumn("block", F.explode(numbers))
    pieces = blocks.select("number", "block", "doc_id", "start", first(F.col("block")).alias("first_word"), count(F.col("block")).alias("words"))

    # the same pieces with their words; one array a document, bound once by the outer transform. Spark broadcasts the places
    # while they are small and else shuffles the texts by doc_id, of those documents that the mix takes something of.
    # Equal rows have one text and several places.
    own = lambda turn: F.concat_ws(" ", F.lit(seed), "number", turn)
    in_first = F.exists(numbers, lambda b: permuted(b, F.col("n_blocks"), own(F.lit(0)), inverse=True) < F.col("n_slots"))
    some = placed.where("size > 0 AND n_slots > 0").where((F.col("n_slots") >= F.col("n_blocks")) | in_first)
    at = written(some.groupBy("doc_id", "draw", "size", *keys).agg(F.collect_list("start").alias("starts")))
    named, nameless = plain(docs, "doc_id", "text").where("text IS NOT NULL"), F.col("doc_id").isNull()
    texts = mostly(named, at).union(named.where(nameless)).select(F.col("doc_id").alias("_id"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_draw"), "text")
    whole = texts.join(at, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_draw") == F.col("draw"))).drop("_id", "_draw")
    again = F.size("starts") > 1
    whole = whole.where(~again).union(whole.where(again).dropDuplicates(["doc_id", "draw"])).withColumn("start", F.explode("starts"))
    cut = lambda w: F.transform(numbers, lambda b: F.struct(b.alias("block"), count(b).alias("words"), F.array_join(F.slice(w, (first(b) + 1).cast("int"), count(b).cast("int")), " ").alias("text")))
    words = F.flatten(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), cut))
    held = ("doc_id", "number", "start", "n_blocks", "n_slots", "first_slot", "all_slots")
    filled = whole.select(*held, F.explode(words).alias("piece")).select(*held, "piece.*")

    # each piece goes to its block's slot of every pass that the source still fills
    filled = filled.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_slots - 1) div n_blocks"))))
    filled = filled.withColumn("_j", F.col("pass") * F.col("n_blocks") + permuted(F.col("block"), F.col("n_blocks"), own(F.col("pass")), inverse=True)).where("_j < n_slots")
    filled = filled.withColumn("slot", permuted(F.col("first_slot") + F.col("_j"), F.col("all_slots"), F.lit(f"{seed} slots"))).withColumn("shard", F.expr(f"slot div {shard_slots}"))
    # a document has one piece of a block at most, so starts give the order of a block's pieces
    dealt = filled.select("shard", "slot", "number", "pass", "block", "start", "doc_id", "words", "text").repartition("shard")
    parts = F.array_sort(F.collect_list(F.struct("start", "doc_id", "words", "text")))
    dealt = dealt.groupBy("shard", "slot").agg(*(F.first(c).alias(c) for c in ("number", "pass", "block")), parts.alias("parts"))
    part = lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["words"].alias("words"))
    dealt = dealt.select("shard", "slot", "number", "pass", "block", F.array_join("parts.text", " ").alias("text"), F.transform("parts", part).alias("parts"))
    slots = written(dealt.sortWithinPartitions("shard", "slot"), level=9)

    taken = slots.select("number", F.explode("parts").alias("part")).groupBy("number", "part.start").agg(F.sum("part.words").alias("taken"))
    # Spark takes exploded rows for as few as their source, so it is told to shuffle the join
    some = placed.where("size > 0").join(taken.hint("merge"), ["number", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    documents = some.unionByName(none).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    names = plan.select("number", "source")
    slots = slots.join(F.broadcast(names) if small is not plan else names, "number")
    return documents, slots, pieces


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes, counted in the written mix."""
    return mix(table(spark, sf_dir, "documents"))[0].drop("source")
