"""The pipeline's stages on a small corpus with every odd case, each against brute force on its own input."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siteq.llm import quality

from .test_operators import WORD, jaccard_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, row string"


def rows_of(seed=9):
    r = random.Random(seed)
    good = lambda n: " ".join(r.choice(["meadow", "river", "stone", "walks", "under", "light", "quiet", "evening"]) + str(r.randrange(30)) for _ in range(n))
    bad = lambda n: " | ".join(r.choice(["BUY", "NOW", "!!!", "$$$", "click"]) for _ in range(n))
    line = "This common line of more than forty characters comes in many documents."
    texts = []
    for k in range(90):
        t = good(r.choice([30, 80, 200])) if k % 5 else bad(60)
        if k % 5 == 1:
            t = line + "\n" + t
        texts.append(t)
    texts += [texts[11], texts[12].upper(), " ".join(texts[13].split()[:-1])]  # copies and a near copy
    texts.append(good(20_000))
    out = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t), -1, 0.5, "x") for k, t in enumerate(texts)]
    item = "What is the name of the tall tower that stands beside the old harbour of the northern town? It is called the lantern."
    out += [(200, good(50) + " " + item + " " + good(50), "en", "s1", 1, -1, 0.5, "x"), (None, item, None, "s2", 1, -1, 0.5, "x"), (None, good(40), None, None, None, -1, 0.5, "x")]
    out += [(201, None, None, None, None, -1, 0.5, "x"), (202, "", "en", "s1", 0, -1, 0.5, "x"), (203, good(30), "en", "s3", 5, -1, 0.5, "x")]
    out.append(out[-1])  # a repeated row
    return out, item


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows, item = rows_of()
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int("BUY" not in r[1] and "click" not in r[1]), 0) for r in rows if r[0] is not None and r[0] < 90]
    spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, world, tmp_path):
    docs = spark.read.parquet(f"{world}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, world)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.asDict() for r in out.collect()]
        if k < 4:
            assert tuple(out.columns) == P.COLUMNS
        CHECKS[name](spark, world, before, after)
        docs = out.withColumn("component_id", F.lit(7)).withColumn("row", F.lit("x")) if k < 4 else out


def key(r):
    return tuple(r[c] for c in P.COLUMNS)


def good_ones(spark, d, before, after):
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    model = quality.fit(frame, spark.read.parquet(f"{d}/labels.parquet"))
    gain = model.gains()
    raw = [(r["text"] or "").encode() for r in before]
    scores = model.score(np.array([gain(t) for t in raw], float), np.array([len(t) for t in raw], float))
    assert Counter(map(key, after)) == Counter(key(r) for r, s in zip(before, scores, strict=True) if s >= 0.7)
    assert len(after) < len(before) and not any("click" in (r["text"] or "") for r in after)


def lines(spark, d, before, after):
    clean = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holds = defaultdict(set)
    for r in before:
        for x in (r["text"] or "").split("\n"):
            holds[clean(x)].add(r["doc_id"])
    gone = {x: max(i for i in ids if i is not None) for x, ids in holds.items() if len(x) >= 40 and len(ids - {None}) >= 5}
    want = Counter()
    for r in before:
        kept = "\n".join(x for x in (r["text"] or "").split("\n") if r["doc_id"] is None or clean(x) not in gone or gone[clean(x)] == r["doc_id"])
        want[r["doc_id"], kept, r["lang"], r["source"], len(kept)] += 1
    assert gone and Counter(map(key, after)) == want


def copies(spark, d, before, after):
    texts = {r["doc_id"]: r["text"] for r in before if r["doc_id"] is not None}
    of = jaccard_by_hand(texts, 5, 4, 5)
    want = Counter(key(r) for r in before if r["doc_id"] is None or of[r["doc_id"]][1] == r["doc_id"])
    assert Counter(map(key, after)) == Counter({k: 1 if k[0] is not None and k[1] is not None else n for k, n in want.items()})
    assert len(after) < len(before)


def leaks(spark, d, before, after):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    item = words(rows_of()[1])
    holds = lambda t: any(words(t)[i : i + len(item)] == item for i in range(len(words(t))))
    assert Counter(map(key, after)) == Counter(key(r) for r in before if not holds(r["text"]))
    assert len(before) - len(after) == 2


def mixed(spark, d, before, after):
    assert Counter((r["doc_id"], r["size"]) for r in after) == Counter((r["doc_id"], len(re.findall(WORD, r["text"] or ""))) for r in before)
    total, taken = Counter(), Counter()
    for r in after:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert {r["source"]: r["source_size"] for r in after} == dict(total)
    assert all(abs(taken[r["source"]] - r["target"]) <= 256 for r in after)


CHECKS = dict(zip((n for n, _ in P.STAGES), (good_ones, lines, copies, leaks, mixed), strict=True))


def test_empty_tables(spark, world, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{world}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "size", "taken"} <= set(out.columns)
