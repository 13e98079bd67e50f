"""What happens at the limits of names, sizes and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from siteq.llm import jaccard_join, secrets, substring_dedup, topk
from siteq.llm.common import marked

from .test_operators import corpus, frame, jaccard_by_hand, windows_by_hand


def near_copies(seed=8, n=40):
    """Texts that all hold one frequent passage, so that its shingles are in every document, and near copies of half of them."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    out = []
    for k in range(n):
        w = [*passage, *(f"q{r.randrange(10**6)}" for _ in range(r.choice([4, 8, 20, 60])))]
        out.append(" ".join(w))
        if k % 2:
            w[r.randrange(60, len(w))] = "changed"
            out.append(" ".join(w))
    return out


def test_sets_with_one_first_sum_stay_apart(spark, monkeypatch):
    """Different sets whose first sums are forced to be equal are nodes of their own, with all their links."""
    real = jaccard_join._signature
    monkeypatch.setattr(jaccard_join, "_signature", lambda s: (real(s)[0] & 7, real(s)[1]))
    texts = [*corpus(), *near_copies()]
    got = jaccard_join.jaccard_components(frame(spark, texts), 4, 85, 100, min_count=3, a_block=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_by_hand(dict(enumerate(texts, 10)), 4, 85, 100)


def test_sets_with_both_sums_equal_are_refused(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_signature", lambda s: (7, 7))
    with pytest.raises(RuntimeError, match="sums"):
        jaccard_join.jaccard_components(frame(spark, ["a b c d e", "b c d e f g"]))


@pytest.mark.parametrize("hot_rows", [1, 7])
def test_shingles_of_every_document_are_dealt_out(spark, monkeypatch, hot_rows):
    """A passage that all documents share: its shingles' rows go to several tasks, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot_rows)
    texts = near_copies() + ["p1 p2 p3 p4 p5", "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16 p17 p18", "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16 p17 p18"]
    got = jaccard_join.jaccard_components(frame(spark, texts), 4, 85, 100, min_count=3, a_block=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_by_hand(dict(enumerate(texts, 10)), 4, 85, 100)


def test_products_beyond_64_bits_are_refused(spark):
    frames = lambda rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    for rows in ([[1e300, 1.0], [5e16, 5e16]], [[3e17, 1.0], [2.0, 2.0]], [[1e8, 1e8], [1e8, 1e8]]):
        with pytest.raises(ValueError, match="64 bits"):
            topk.top_k(frames(rows), F.lit(True))
    large = [[1e7, -1e7], [9e6, 1.0], [-1e7, 3.0]]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(frames(large), F.lit(True)).collect()}
    q = [[int(64 * x) for x in v] for v in large]
    assert got == {(i, j): sum(a * b for a, b in zip(q[i], q[j], strict=True)) for i in range(3) for j in range(3) if i != j}


def test_a_placeholder_excuses_the_words_around_it_only(spark):
    r = random.Random(11)
    key = lambda n: "".join(r.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    inside, around = key(35) + "1234567" + key(35), "myExample1234567Key"
    got = {x.doc_id: x.n_entropy for x in secrets.scan(frame(spark, [f"x {inside} y", f"x {around}/{around} y"], [1, 2])).collect()}
    assert got == {1: 1, 2: 0}


def test_marked_keys(spark):
    """All wanted keys are marked and few others, with nulls on both sides."""
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    wanted = rows.where("k % 100 = 7 OR k IS NULL")
    found = marked(rows, wanted, "k", "held").collect()
    assert len(found) == 20_000 and all(r.held for r in found if r.k and r.k % 100 == 7)
    assert not any(r.held for r in found if r.k is None) and sum(r.held for r in found) < 260
    assert not any(r.held for r in marked(rows, wanted.where("false"), "k", "held").collect())


def test_hot_anchors_by_filter(spark):
    """Places with few words in all count as hot, and the result stays."""
    texts = dict(enumerate(corpus(), 10))
    want = windows_by_hand(texts)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(frame(spark, corpus()), hot_words=3).collect()}
    assert got == {d: v[1] for d, v in want.items()}
