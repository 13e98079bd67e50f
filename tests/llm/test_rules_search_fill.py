"""Quality rules, lexical search and fill-in-the-middle against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siteq.llm import fill_middle, lexical_search, quality_rules

from .test_operators import SCHEMA, corpus, empty, frame, sha

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def texts():
    return dict(zip(range(10, 10**6), corpus(), strict=False))


# ---------------------------------------------------------------- 11


def measures_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark, docs, texts):
    more = ["a b c a b c", "a b a b a b a", "x x x x", "x\nx\n\n x\nx", "# * $ % & | < >", "é é é é", "\n\n", "w\x0bw\x0cw\rw w w", " lead", "trail ", "😀 😀 😀 😀"]
    ids = {10**6 + k: t for k, t in enumerate(more)}
    found = quality_rules.measure(docs.unionByName(frame(spark, more, ids))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in found} == {d: measures_by_hand(t) for d, t in (texts | ids).items()}


def test_very_long_texts_are_measured_whole(spark):
    r = random.Random(5)
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(300_000))
    same = "again and again " * 100_000
    found = {x["doc_id"]: x for x in quality_rules.measure(frame(spark, [long, same, long + " " + long[:40]])).collect()}
    assert found[10]["n_words"] == 300_000 and found[10]["n_repeat_words"] == measures_by_hand(long)[5]
    assert found[11]["n_repeat_words"] == 300_000 and found[11]["base_failed"]
    assert found[12]["n_repeat_words"] == measures_by_hand(long + " " + long[:40])[5] > 0


def verdicts_by_hand(rows, reach, least_docs):
    """rows: (lang, source, measures); the sketch of a list of values is the middles of their buckets."""
    middle = lambda v: math.floor(2 * 1.01 ** math.ceil(math.log(v) / math.log(1.01)) / 2.01) if v else 0
    parts = lambda m: {k: 10**6 * dict(zip(("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"), m, strict=False))[over] // m[0 if under == "n_words" else 3] for k, (over, under, *_) in quality_rules.MEASURES.items()}
    groups = defaultdict(list)
    for lang, source, m in rows:
        if m[0]:
            for key in ((0, lang, source), (1, lang), (3,)):
                groups[key].append(parts(m))
    out = []
    for lang, source, m in rows:
        key = next((k for k in ((0, lang, source), (1, lang)) if len(groups[k]) >= least_docs), (3,))
        ok = not m[6]
        for name, (_, _, least, both) in quality_rules.MEASURES.items():
            values = sorted(middle(p[name]) for p in groups[key])
            q1, q3 = (values[math.ceil(len(values) * q / 4) - 1] for q in (1, 3)) if values else (0, 0)
            spread = reach * max(q3 - q1, least)
            if ok and (parts(m)[name] > q3 + spread or both and parts(m)[name] < q1 - spread):
                ok = False
        out.append(ok)
    return out


@pytest.mark.parametrize(("reach", "least_docs"), [(6, 100), (1, 12), (1, 3)])
def test_thresholds_follow_the_groups(spark, reach, least_docs):
    """Sources of different sizes and habits, null languages and sources, repeated rows, columns with clashing names."""
    r = random.Random(1)
    rows = []
    for k in range(400):
        lang, source = r.choice(["en", "de", None]), r.choice(["big", "big", "big", "a", "b", None])
        size = {"big": 5, "a": 9}.get(source, 3)
        words = ["".join(r.choice("abcdefgh") for _ in range(max(1, int(r.gauss(size, 1))))) + ("#" * r.randrange(3) if source == "b" or k % 17 == 0 else "") for _ in range(r.choice([20, 60, 90]))]
        rows.append((k // 2 if k % 9 == 0 else k, " ".join(words) + ("\nsame\nsame" if k % 5 == 0 else ""), lang, source, 0, 1, 2, "x", 0.5, "y"))
    found = quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA).repartition(5), reach, least_docs).collect()
    want = verdicts_by_hand([(x[2], x[3], measures_by_hand(x[1])) for x in rows], reach, least_docs)
    assert sorted((x["doc_id"], x["n_words"], x["kept"]) for x in found) == sorted((x[0], len(WORD.findall(x[1])), ok) for x, ok in zip(rows, want, strict=True))
    assert 0 < sum(want) < 400 and all(bool(x["failed"]) == (not x["kept"]) for x in found if not x["base_failed"])


def test_sketches_merge_to_the_sketch_of_all(spark, docs):
    measured = quality_rules.measure(docs)
    whole = quality_rules.sketches(measured).collect()
    parts = quality_rules.sketches(measured.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(measured.where("doc_id % 2 = 1"))).groupBy("lang", "source", "measure", "bucket").sum("n").collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, parts), key=repr)


def test_rules_of_an_empty_table(spark):
    assert quality_rules.apply_rules(empty(spark)).collect() == []


def test_clean_documents_stay(spark, sf):
    """Of rows labelled good that pass the base rules, the thresholds drop none; of those labelled bad, most."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/labels.parquet").collect()}
    rows = [r for r in quality_rules.op11_quality_rules(spark, sf.replace("0.001", "0.1")).collect() if not r["base_failed"]]
    kept = {q: [r["kept"] for r in rows if labels.get(r["doc_id"]) == q] for q in (0, 1)}
    assert len(kept[1]) > 1000 and sum(kept[1]) / len(kept[1]) > 0.995 and sum(kept[0]) / len(kept[0]) < 0.5


# ---------------------------------------------------------------- 12


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def search_by_hand(docs, items, k):
    """docs, items: lists of (id, text)."""
    split = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in split:
            m = 100 - 25 + (25 * n * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)


ITEMS = [(1, "w1 w2 the THE the"), (2, "w5 Été 😀"), (3, None), (4, ""), (5, "?!"), (6, "nothing of the kind"), (7, "absent words only zzzz"), (7, "w9 w10 w11"), (None, "w3-w4"), (8, "one"), (9, "w1 " * 40 + "w7")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "q", 0) for i, t in ITEMS + ITEMS[:2]], "item_id long, text string, doc_id string, score int")


@pytest.mark.parametrize(("k", "shard_docs", "query_bytes", "most_terms"), [(20, 1 << 14, 1 << 23, 1 << 20), (3, 7, 1 << 23, 1 << 20), (5, 16, 20, 1 << 20), (4, 10, 1 << 23, 2), (1000, 9, 64, 0)])
def test_search(spark, items, k, shard_docs, query_bytes, most_terms):
    """Ties, repeated ids and rows, null ids, texts and items; shards, parts of the items and an index of all terms change nothing."""
    texts = [*corpus(), "w1 w1 tie", "w1 w1 tie", "w1 w1 tie"]
    ids = [*range(10, 7 + len(texts)), 5, 5, None]
    rows = frame(spark, texts, ids).repartition(4)
    found = lexical_search.search(rows, items, k, query_bytes, most_terms, shard_docs=shard_docs)
    assert searched(found) == search_by_hand(list(zip(ids, texts, strict=True)), ITEMS, k)


def test_search_of_empty_tables(spark, docs, items):
    assert lexical_search.search(empty(spark), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def shard_of(texts, shard_docs=1 << 14):
    import pyarrow as pa

    rows = lexical_search._index_rows(None, shard_docs, 1 << 30)(iter([pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})]))
    return [{c: b.column(b.schema.get_field_index(c))[0].as_py() for c in b.schema.names} for b in rows]


def test_blocks_are_rejected_before_they_are_unpacked(spark):
    """A rare term and frequent ones: of the frequent lists only blocks with a candidate are opened, and the scores are those of brute force."""
    r = random.Random(2)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd"]) for _ in range(r.randrange(3, 60))) + (" rare" if k % 700 == 0 else "") for k in range(6000)]
    (row,) = shard_of(texts)
    shard = lexical_search.Shard(row, row["n_docs"], row["n_terms"])
    want = search_by_hand(list(enumerate(texts)), [(1, "rare aa bb")], 5)
    (terms,) = lexical_search._query_terms(["rare aa bb"])
    df = Counter(t for x in texts for t in set(x.split()))
    weights = np.array([math.floor(1000 * math.log(12002 / (2 * df[t] + 1))) for t in ("rare", "aa", "bb")], np.int64)
    docs, scores = shard.search(terms, weights, 5, 1)
    best = lexical_search.Best(5)
    best.add(scores, docs, np.zeros(len(docs), bool))
    assert [(d, s) for d, s in zip(best.ids.tolist(), best.score.tolist(), strict=True)] == [x[2:] for x in sorted(want, key=lambda x: x[1])]
    assert len(shard.open) < len(shard.last) / 3
    # with the k-th score known, a second shard like it opens no more than the lists that can still beat it
    again = lexical_search.Shard(row, row["n_docs"], row["n_terms"])
    again.search(terms, weights, 5, best.least)
    assert len(again.open) <= len(shard.open)


def test_packed_lists_come_back(spark):
    """Gaps and frequencies of one, two and four bytes; lists of one block, of a full one and of several."""
    n = 200_000
    lengths = np.arange(1, n + 1) % 900 + 1
    doc = np.concatenate([np.arange(0, n, 3), np.array([0, 70_000, 140_100]), np.arange(128), np.array([5])])
    term = np.repeat([7, -9, 11, 12], [len(range(0, n, 3)), 3, 128, 1])
    tf = np.concatenate([np.arange(0, n, 3) % 5 + 1, [1, 300, 70_000], np.ones(128, int), [70_000]])
    row = lexical_search.pack(np.arange(n), np.zeros(n, bool), lengths, term, doc, tf)
    shard = lexical_search.Shard(row, row["n_docs"], row["n_terms"])
    for t in (7, -9, 11, 12):
        k = int(np.flatnonzero(shard.terms == t)[0])
        blocks = [shard.block(k, b) for b in range(int(shard.first[k]), int(shard.first[k + 1]))]
        docs, weights = (np.concatenate(x) for x in zip(*blocks, strict=True))
        want = shard._weight(tf[term == t], shard.norms[doc[term == t]])
        assert docs.tolist() == doc[term == t].tolist() and weights.tolist() == want.tolist()
        assert shard.list_max[k] == want.max() and [int(w.max()) for _, w in blocks] == shard.block_max[shard.first[k] : shard.first[k + 1]].tolist()


# ---------------------------------------------------------------- 13


def filled_by_hand(doc_id, text, sentinels=("<P>", "<S>", "<M>"), seed="1", plain=10, spm=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


FILLS = ["<P>", "a<S>b", "<M", "<<P", "x<", ">y", "$1\\2", "\\", "a\nb\r\nc d", "😀" * 9, "é", "\x00\x01", "<S<M<P"]


@pytest.mark.parametrize("options", [{}, {"seed": "x", "plain_percent": 0, "spm_percent": 50, "sentinels": ("$1", "\\2", "😀!")}])
def test_fill_middle(spark, options):
    texts = [*corpus(), *FILLS * 6]
    ids = [None, 0, -7, *range(10, 7 + len(texts))]
    ids[5] = ids[6]  # repeated id
    by_hand = {"seed": options.get("seed", "1"), "plain": options.get("plain_percent", 10), "spm": options.get("spm_percent", 20), "sentinels": options.get("sentinels", ("<P>", "<S>", "<M>"))}
    rows = fill_middle.fill_middle(frame(spark, texts, ids), **options)
    back = fill_middle.restore(rows["output"], rows["form"], by_hand["sentinels"])
    found = sorted(((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["back"]) for r in rows.withColumn("back", back).collect()), key=repr)
    assert found == sorted(((d, filled_by_hand(d, t, **by_hand), t or "") for d, t in zip(ids, texts, strict=True)), key=repr)
    assert {f[1][1] for f in found} == {"plain", "psm", "spm"}


def test_fill_middle_of_very_long_texts(spark):
    """Texts of millions of code points, block sizes and their neighbours: constant stack, every unit counted."""
    texts = ["ab😀\n" * 600_000, *("é" * k for k in (1, 2, 4095, 4096, 4097, 8192, 10_000))]
    rows = fill_middle.fill_middle(frame(spark, texts), plain_percent=0)
    found = {r["doc_id"]: r for r in rows.withColumn("back", fill_middle.restore(rows["output"], rows["form"])).collect()}
    for d, t in enumerate(texts, 10):
        assert (found[d]["n"], found[d]["back"], found[d]["output"]) == (len(t), t, filled_by_hand(d, t, plain=0)[4])


def test_units_can_be_lines(spark):
    text = "".join(f"line {k}\n" for k in range(5000))
    r = fill_middle.fill_middle(frame(spark, [text], [3]), unit=r"[^\n]*\n", plain_percent=0, spm_percent=0).first()
    lines = text.splitlines(keepends=True)
    a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
    assert r["n"] == 5000 and r["output"] == "<P>" + "".join(lines[:a]) + "<S>" + "".join(lines[b:]) + "<M>" + "".join(lines[a:b])


def test_sentinels_that_could_run_together_are_refused(spark, docs):
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aXa", "b", "c"), ("ab", "ba", "c"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.fill_middle(docs, sentinels=bad)


def test_fill_middle_query(spark, sf):
    rows = fill_middle.op13_fill_middle(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        want = filled_by_hand(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == want[:4] and r["output_sha256"] == sha(want[4]) and r["restored_sha256"] == sha(texts[r["doc_id"]] or "")
    assert fill_middle.fill_middle(empty(spark)).collect() == []
