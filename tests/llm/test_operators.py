"""The ten operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siteq.llm import chat, components, decontaminate, jaccard_join, line_dedup, mixing, quality, secrets, substring_dedup, token_counts, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, start int, size string, score double, shingle string"
WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=3, n=60):
    """Texts with near copies, shared passages and lines, white space of every kind, nulls and empty ones."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ñandú", "😀", "THE", "the"]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, line = words(30), "A common line that stands in very many documents. " + " ".join(words(6))
    out = [None, "", " \t\n", "one", "two words", "a b c", "a b c d", "Same text here twice over", "Same text here twice over"]
    for k in range(n):
        w = words(r.choice([5, 20, 60, 150]))
        if k % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(10) : r.randrange(15, 30)]
        text = "".join(x + r.choice([" ", "  ", "\n", "\t", " \x0b"]) for x in w)
        if k % 5 == 0:
            text = r.choice(["", "\n"]) + r.choice([line, line.upper() + " ", "\t" + line]) + "\n" + text
        out.append(text)
        if k % 6 == 0:
            out.append(text)
        if k % 3 == 0:  # a near copy
            c = list(w)
            c[r.randrange(len(c))] = "changed"
            out.append(" ".join(c).swapcase() if k % 2 else " ".join(c))
    out.append(" ".join(words(12_000)))
    return out


def frame(spark, texts, ids=None):
    ids = range(10, 10 + len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, 0, 1, 2, "x", 0.5, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def texts():
    return dict(zip(range(10, 10**6), corpus(), strict=False))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 10


def lines_by_hand(texts, chars=40, least=5):
    key = lambda s: s.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for d, t in texts.items():
        for s in (t or "").split("\n"):
            if len(key(s)) >= chars:
                holders[key(s)].add(d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        stay = [s for s in lines if not (len(holders.get(key(s), ())) >= least and max(holders[key(s)]) != d)]
        out[d] = (len(lines), len(lines) - len(stay), sha("\n".join(stay)))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup(docs, texts, limit):
    got = line_dedup.dedup_lines(docs, broadcast_bytes=limit, lines_a_shard=2)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()} == lines_by_hand(texts)
    assert any(v[1] for v in lines_by_hand(texts).values())


def test_line_dedup_odd_tables(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    line = "x" * 50
    got = line_dedup.dedup_lines(frame(spark, [line] * 6 + [None], [1, 1, 1, 1, None, None, 2])).collect()
    assert [r.n_dropped for r in got] == [0] * 7  # one document by id, and those without an id don't count


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    h = line_dedup.PerfectHash(keys)
    assert sorted(h.index(keys)) == list(range(len(keys)))
    assert h.bytes() < 1.2 * len(keys)
    assert len(line_dedup.PerfectHash(keys[:0]).index(keys)) == len(keys)


# ---------------------------------------------------------------- 7


def windows_by_hand(texts, n=13):
    words = {d: re.findall(WORD, t or "") for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring_dedup(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == windows_by_hand(texts)
    assert sum(v[1] for v in got.values()) > 300


def test_substring_dedup_odd_tables(spark):
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0
    long = " ".join(f"v{k}" for k in range(20))
    got = substring_dedup.dedup_substrings(frame(spark, [long, long + " end", None, long, "a " * 40], [5, 5, 6, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (6, 0), (7, 0)]


def test_substring_dedup_passage_repeated_inside_a_document(spark):
    passage, part = [[f"{x}{k}" for k in range(16)] for x in "pq"]
    line = lambda k, w: " ".join([f"left{k}", *w, f"right{k}"])
    texts = {1: line(1, passage) + " " + line(2, part), 2: line(3, passage) + " " + line(3, passage), 3: " ".join([line(4, passage)] * 3 + [line(5, part)] * 2)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, texts.values(), texts)).collect()}
    assert got == windows_by_hand(texts)
    assert [got[d][1] for d in texts] == [0, 32, 80]


@pytest.mark.parametrize("hot_words", [0, 300])
def test_substring_dedup_hot_minimisers(spark, docs, texts, hot_words):
    phrase, r = [f"p{k}" for k in range(14)], random.Random(4)
    many = {1000 + k: " ".join([f"a{k}", "b", *phrase[r.randrange(5) :], f"c{k}", *phrase, "d"]) for k in range(150)}
    both = docs.select("doc_id", "text").union(frame(spark, many.values(), many).select("doc_id", "text"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(both, hot_words=hot_words).collect()}
    assert got == windows_by_hand(texts | many)
    pieces = substring_dedup.placed_pieces(both.selectExpr("doc_id", "text", "xxhash64(text) AS row"), 13, 5, hot_words).where("words IS NOT NULL")
    differ = pieces.groupBy("anchor").agg({"words": "collect_set"}).collect()
    assert max(sum(len(w.split()) for w in r[1]) for r in differ) <= max(hot_words, 13)


def test_automaton():
    a = substring_dedup.Automaton()
    r = random.Random(2)
    known = []
    for _ in range(40):
        words = [r.choice("abc") for _ in range(r.randrange(1, 12))]
        want = []
        for end in range(1, len(words) + 1):
            want.append(max((n for n in range(end + 1) if any(words[end - n : end] == k[i : i + n] for k in known for i in range(len(k)))), default=0))
        assert a.statistics(words) == want
        a.add(words)
        known.append(words)


# ---------------------------------------------------------------- 6


def jaccard_by_hand(texts, n, num, den):
    sets = {}
    for d, t in texts.items():
        w = re.findall(WORD, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("n", "num", "den", "rounds"), [(4, 85, 100, 5), (5, 4, 5, 1), (2, 1, 2, 2)])
def test_jaccard(docs, texts, n, num, den, rounds):
    got = jaccard_join.jaccard_components(docs, n, num, den, leader_rounds=rounds, min_count=3, a_block=2)
    want = jaccard_by_hand(texts, n, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_odd_tables(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    got = jaccard_join.jaccard_components(frame(spark, ["a b c d e", "A B C D E", "", None, "a b c d e"], [3, 4, 5, 6, None])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (3, 2, 3), (4, 2, 3), (5, 0, 5), (6, 0, 6)]


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


# ---------------------------------------------------------------- 1


def labelled(spark, seed=1):
    r = random.Random(seed)
    good = lambda: " ".join(r.choice(["meadow", "river", "stone", "walks", "the", "a", "under", "light"]) for _ in range(60)) + "."
    bad = lambda: " | ".join(r.choice(["BUY", "NOW", "!!!", "$$$", "click"]) for _ in range(60))
    rows = [(k, (good() if k % 4 else bad()), int(k % 4 > 0)) for k in range(400)]
    docs = frame(spark, [t for _, t, _ in rows] + [None, ""], [k for k, _, _ in rows] + [900, 901])
    labels = spark.createDataFrame([(k, q, 0, 1.0) for k, _, q in rows] + [(None, 1, 0, 1.0), (5, None, 0, 1.0)], "doc_id long, quality int, toxic int, score double")
    return docs, labels, {k: q for k, _, q in rows}


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [k for k in truth if __import__("zlib").crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k].score >= 0.5) == truth[k] for k in held]) > 0.95
    assert got[900].score == got[901].score and 0.6 < got[900].score < 0.9  # the share of good labels


def test_quality_ignores_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_quality_by_hand(spark):
    """Scores follow from the sizes that zstandard gives with each dictionary, one text at a time."""
    import zstandard

    docs, labels, _ = labelled(spark)
    model = quality.fit(docs, labels)
    long = "meadow BUY river NOW " * 40_000
    rows = quality.score(docs.union(frame(spark, [long], [990])), model).collect()
    size = lambda d, t: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(t))
    for r in [x for x in rows if x.text][::40] + [x for x in rows if x.doc_id == 990]:
        raw = r.text.encode()
        gain = (size(model.bad, raw) - size(model.good, raw)) / len(raw)
        want = 1 / (1 + math.exp(-(model.prior + len(raw) / (len(raw) + quality.HALF) * (model.slope * gain + model.bias))))
        assert math.isclose(r.score, want, rel_tol=1e-6), (r.doc_id, r.score, want)


def test_quality_clashing_columns(spark):
    docs, labels, _ = labelled(spark)
    from pyspark.sql import functions as F

    model = quality.fit(docs, labels)
    odd = docs.withColumn("_text", F.lit("BUY")).withColumn("text_", F.lit(1)).withColumn("predicted", F.lit("x"))
    pick = lambda df: {r.doc_id: (r.score, r.predicted) for r in quality.score(df, model).collect()}
    assert pick(odd) == pick(docs) and {"_text", "text_"} <= set(quality.score(odd, model).columns)
    twice = docs.union(docs)
    assert quality.fit(twice, labels) == model and quality.score(twice, model).count() == 2 * docs.count()


def test_quality_odd_tables(spark):
    docs, labels, _ = labelled(spark)
    none = labels.where("false")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score(empty(spark), quality.fit(empty(spark), labels)).count() == 0
    one = quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()
    assert len({r.score for r in one}) == 1


# ---------------------------------------------------------------- 2


def test_topk(spark):
    r = random.Random(5)
    vectors = {k: [r.choice([-1, 1]) * r.random() ** 3 for _ in range(6)] for k in range(300)}
    for k in range(60, 90):
        vectors[k] = vectors[60]  # ties
    vectors[7] = [0.5] * 3
    vectors[20] = [0.0] * 6
    rows = [(k, v, 1) for k, v in vectors.items()] + [(5, vectors[5], 1), (400, None, 1), (401, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (None, vectors[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, rows_a_block=64)
    q = {k: [math.floor(64 * float(np.float32(x))) for x in v] for k, v in vectors.items()}
    want = {}
    for a in (k for k in q if k % 20 == 0):
        s = sorted(((-sum(x * y for x, y in zip(q[a], q[b], strict=False)), b) for b in q if b != a))[:7]
        want |= {(a, i): (b, -s) for i, (s, b) in enumerate(s, 1)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()} == want
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    few = topk.top_k(df.where("vec_id IN (1, 20)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(20, 1, 1)]


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    x = np.zeros((5000, 2), np.int64)
    x[:, 0], x[:, 1] = rng.permutation(5000), rng.permutation(5000)
    lists = topk.Lists(np.arange(5000), x)
    reads = []
    lists.up = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: (reads.append(1), np.ndarray.__getitem__(self, k))[1]})(lists.up.shape, lists.up.dtype, lists.up.copy())
    at, score = lists.best(np.array([1, 1]), -1, 5, x.astype(float))
    assert score.tolist() == sorted((x.sum(1)).tolist(), reverse=True)[:5] and len(reads) < 8


# ---------------------------------------------------------------- 3


def test_token_counts(spark, docs, texts):
    encode = token_counts.encoder(token_counts.TOKENIZERS)
    for size in (7, 64, 1 << 18):
        blocks = token_counts.token_files(docs, block_tokens=size)
        names = defaultdict(list)
        for r in blocks.orderBy("file", "block").collect():
            names[r.file] += r.doc_ids
        got = {names[r.file][r.ordinal]: r.n_tokens for r in token_counts.count_tokens(blocks).collect()}
        assert got == {d: len(encode(t or "")) for d, t in texts.items()}


def test_token_counts_of_raw_blocks(spark):
    files = {0: [9, 9, 1, 9, 2, 3], 1: [], 2: [9], 3: [1, 2, 3, 4], 4: [1, 9]}
    rows = []
    for f, ids in files.items():
        for b in range(0, max(len(ids), 1), 2):
            rows.append((f, b, bytearray(np.array(ids[b : b + 2], "<u4").tobytes()), "x"))
    rows.append((5, 0, None, "x"))
    df = spark.createDataFrame(rows, "file long, block long, data binary, size string").repartition(2)
    got = sorted((r.file, r.ordinal, r.n_tokens) for r in token_counts.count_tokens(df, end=9, dtype="<u4").collect())
    assert got == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 2), (2, 0, 0), (3, 0, 4), (4, 0, 1)]
    assert token_counts.count_tokens(df.where("false"), end=9).count() == 0


# ---------------------------------------------------------------- 4


def secrets_by_hand(t):
    base = []
    for m in re.finditer(secrets.ASSIGN, t, re.A):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found = []
    for k, kind in ((3, "entropy_hex"), (4, "entropy_base64")):
        _, one, bits = secrets.CLASSES[kind]
        w = secrets.WINDOW
        for m in re.finditer(f"{one}{{{w},}}", t):
            if any(re.search(p, m[0]) for p in secrets.ALLOWED):
                continue
            for i in range(w, len(m[0]) + 1):
                h = -sum(c / w * math.log2(c / w) for c in Counter(m[0][i - w : i]).values())
                if h >= bits - 1e-7:
                    a, b = m.start() + i - w, m.start() + i
                    if found and found[-1][1] == k and found[-1][2] >= a and found[-1][0] >= m.start():
                        a = found.pop()[0]
                    found.append((a, k, b))
    touch = lambda x, y: x[0] < y[2] and y[0] < x[2]
    found = [e for e in found if not any(touch(e, b) for b in base)]
    found = [e for e in found if e[1] == 3 or not any(b[1] == 3 and touch(e, b) for b in found)]
    text = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    return [sum(b[1] == k for b in base) for k in range(3)] + [sha(text(base)), text(base + found)]


def test_secrets(spark):
    r = random.Random(1)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    cases = [None, "", 'password=token"=abcdef', "secret=token=abcdef x", 'PASSWORD : "hunter22"', "api_key=abc api_key=abcdefg", "AKIA", "AKIA" + "B" * 16 + " AKIA" + "B" * 15, "😀 token=😀 token=abcdef1 " + "0a" * 20 + "é", "ſecret=abcdef1 toKen=abcdef1"]
    for _ in range(60):
        cases.append("".join(r.choice(["token=", "secret: ", "é ", "😀", "\n", " word ", "AKIA", '"', "example"]) + "".join(r.choice(r.choice([alpha, "0123456789abcdef", "ABCDEF0123456789"])) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 5))))
    cases.append("word " * 20_000 + "token=abcdefgh")
    # long runs of every class, and very many matches
    cases += ["abcd/1234/" * 1000 + "+", "path/2024/" * 100_000, "x" * 1_000_000, "0" * 1_000_000, "/=_-" * 50_000 + "1a", "Ab" * 50_000 + "1"]
    cases += ["".join(r.choices(a, k=30_000)) for a in (alpha, "0123456789abcdef", "0123456789ABCDEFabcdef", "abcdefghijklmnopqrstuvwxyz", "AKI0123456789")]
    cases.append("AKIA" * 20_000)
    cases += [" ".join(f"token={k:06d}" for k in range(3000)), "é ".join("AKIA" + f"{k:020d}" for k in range(700))]
    got = {x.doc_id: [x.n_assign, x.n_access, x.n_hex, x.base_sha256, x.spans] for x in secrets.scan(frame(spark, cases, range(len(cases)))).collect()}
    assert got == {k: secrets_by_hand(t or "") for k, t in enumerate(cases)}
    assert any("entropy" in v[4] for v in got.values())
    assert secrets.scan(empty(spark)).count() == 0


def test_secrets_allow_list(spark):
    r = random.Random(7)
    tokens = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", n // 2) + r.sample("0123456789", 10) + r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n - n // 2 - 10)) for n in range(20, 41)]
    for k, t in enumerate(tokens):
        tokens[k] = "".join(r.sample(t, len(t)))
    tokens += ["k3j9x0z8q7w2v5b1n4m6", "key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "9f86d081884c7d659a2f", "k3j9x-0z8q7-w2v5b-1n4m6"]
    beside = [f"{a}{d}{t}" for a in ("sample", "example", "1234567") for d in "/_=-" for t in ("k3j9x0z8q7w2v5b1n4m6", "Qz7Rk2Wm9Xt4Lp8Vb3Nc")]
    fine = ["docs/2024/how-to-get-it-done/chapter_12", "static/myCamelCase/fontWeight-400", "3f2b8c1e-9d47-4a6b-8e05-71c2d9a4f6b3", "example4f9k2mzq8w3rt7yxb", "your-secret-key_1234567_goes/here", "path/of/words=" * 20_000 + "2024"]
    cases = tokens + beside + fine
    got = {x.doc_id: x.n_entropy for x in secrets.scan(frame(spark, [f"x {c} y" for c in cases], range(len(cases)))).collect()}
    assert [c for k, c in enumerate(cases) if (got[k] > 0) != (c not in fine)] == []


# ---------------------------------------------------------------- 5


def test_mixing(spark, docs, texts):
    out, slots, pieces = mixing.mix(docs, block_words=8, docs_a_bucket=5, shard_slots=64)
    rows = {r.doc_id: r for r in out.collect()}
    assert {d: r["size"] for d, r in rows.items()} == {d: len(re.findall(WORD, t or "")) for d, t in texts.items()}
    sizes = Counter()
    for r in rows.values():
        sizes[r.source] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]:
        for s in over:
            target[s] = 3.0 * sizes[s]
        open_ -= set(over)
        left = sum(sizes.values()) - sum(target.values())
    for s in open_:
        target[s] = left * weight[s] / sum(weight[x] for x in open_)
    taken = Counter()
    for r in rows.values():
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    dealt = slots.collect()
    assert sorted(r.slot for r in dealt) == list(range(len(dealt)))
    assert max(Counter((r.number, r["pass"], r.block) for r in dealt).values()) == 1
    assert {r["n"] for r in pieces.groupBy("number", "block").agg({"words": "sum"}).withColumnRenamed("sum(words)", "n").collect()} <= set(range(1, 9))
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), block_words=8, docs_a_bucket=5, shard_slots=64)[0].collect()}
    assert again == {d: r.taken for d, r in rows.items()}


def test_mixing_writes_the_mixed_text(docs, texts):
    out, slots, pieces = mixing.mix(docs, block_words=8, docs_a_bucket=5, shard_slots=64)
    words, blocks, taken = {d: re.findall(WORD, t or "") for d, t in texts.items()}, defaultdict(list), Counter()
    for p in sorted(pieces.collect(), key=lambda p: (p.number, p.block, p.start)):
        blocks[p.number, p.block] += words[p.doc_id][p.first_word : p.first_word + p.words]
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and rows
    for r in rows:
        assert r.text == " ".join(blocks[r.number, r.block]) and r.shard == r.slot // 64
        taken.update({p.doc_id: 0 for p in r.parts})
        for p in r.parts:
            taken[p.doc_id] += p.words
    assert slots.inputFiles()
    assert {r.doc_id: r.taken for r in out.collect()} == {d: taken[d] for d in texts}


def test_mixing_repeated_rows(spark):
    texts = ["a b c d e f g", "a b c d e f g", "h i j", "k l m n o p q r s t", "h i j", None]
    from pyspark.sql import functions as F

    one = frame(spark, texts, [1, 1, 1, 2, None, 1]).withColumn("source", F.lit("s"))
    out, slots, _ = mixing.mix(one, weights=(1.0,), block_words=4, docs_a_bucket=2, shard_slots=2)
    assert sorted((r.doc_id or 0, r["size"], r.taken) for r in out.collect()) == sorted((d, n, n) for d, n in ((1, 7), (1, 7), (1, 3), (2, 10), (0, 3), (1, 0)))
    assert Counter(w for r in slots.collect() for w in r.text.split()) == Counter(w for t in texts if t for w in t.split())


def test_shards_draw_from_all_sources(spark):
    texts = [" ".join(f"s{k % 3}" for _ in range(400)) for k in range(60)]
    _, slots, _ = mixing.mix(frame(spark, texts), weights=(3, 2, 1), block_words=8, shard_slots=250)
    rows = slots.collect()
    shares, shards = Counter(r.number for r in rows), defaultdict(Counter)
    for r in rows:
        shards[r.shard][r.number] += 1
    full = [c for c in shards.values() if sum(c.values()) == 250]
    assert len(full) > 5
    for c in full:  # hypergeometric counts: within five deviations of the share of all
        for k, n in shares.items():
            p = n / len(rows)
            assert abs(c[k] - 250 * p) < 5 * math.sqrt(250 * p * (1 - p)) + 1
    assert len({tuple(sorted(c.items())) for c in full}) > 1


def test_mixing_odd_tables(spark):
    assert mixing.mix(empty(spark))[0].count() == 0
    got = mixing.mix(frame(spark, [None, "", " "], [1, 1, None]))[0].collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3


# ---------------------------------------------------------------- 8


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\s", "<\\s>", "", None, "é😀\n", "<s> x\ny</s>", "[INST", "]"]
    rows, k = [], 0
    for conv in (3, 4, None):
        for turn in range(12):
            rows.append((conv, turn if turn < 10 else None, ["user", "assistant", "system", None][k % 4], said[k % len(said)], "x"))
            k += 7 if turn % 2 else 1
    rows += rows[:2]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)
    for size in (8 << 20, 30):
        parts = defaultdict(list)
        for r in chat.format_chats(df, part_bytes=size).collect():
            parts[r.conv_id].append(r)
        for conv in (3, 4, None):
            want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
            mine = sorted(parts[conv], key=lambda r: r.part)
            assert [t for r in mine for t in chat.read_back(r.formatted.decode())] == [x[1:] for x in want]
            loss = [chat.unescape(bytes(r.formatted)[a:b].decode()) for r in mine for a, b in zip(r.loss_starts, r.loss_ends, strict=True)]
            assert loss == [x[2] for x in want if x[1] == "assistant"]
    assert chat.format_chats(df.where("false")).count() == 0
    odd = [(1, 0, "us\ner\\n", "a" * 300_000 + "</s>"), (1, 1, "assistant", "\n"), (1, 2, "assistant\n", "x")]
    one = chat.format_chats(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).collect()
    assert chat.read_back(one[0].formatted.decode()) == [x[2:] for x in odd] and len(one[0].loss_starts) == 1


# ---------------------------------------------------------------- 9


def test_decontaminate(spark):
    r = random.Random(6)
    vocabulary = ["the", "of", "and", "to"] * 30 + [f"word{k}" for k in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {k: " ".join(words(r.choice([12, 30, 90]))) + ". " + " ".join(words(6)).capitalize() + "." for k in range(30)}
    texts, want = [], set()
    for k in range(80):
        w = words(r.choice([3, 60, 400]))
        if k % 3 == 0:
            item = k % 30
            at = r.randrange(len(w))
            w[at:at] = [f"({x}!)" for x in (items[item].upper() if k % 2 else items[item]).split()]
            want.add((k, item))
        texts.append(" ".join(w))
    bench = spark.createDataFrame([*((k, t, 1) for k, t in items.items()), (98, None, 1), (99, " ?! ", 1), (None, "x", 1)], "item_id long, text string, score int")
    docs = frame(spark, [*texts, None, ""], range(len(texts) + 2))
    for size in (8 << 20, 1500):
        got = decontaminate.find_leaks(docs, bench, index_bytes=size).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
        assert all(x.score > 0.5 and x.question_overlap > 0.6 for x in got)
    assert decontaminate.find_leaks(empty(spark), bench).count() == decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_index_size_changes_nothing(spark):
    r = random.Random(8)
    vocabulary = [f"word{k}" for k in range(150)]
    items = {k: [r.choice(vocabulary) for _ in range(r.choice([8, 20, 70, 140]))] for k in range(24)}
    texts = []
    for k in range(60):  # passages with a part of an item
        w = items[k % 24]
        n = max(4, int(len(w) * r.choice([0.4, 0.55, 0.7, 0.9])))
        at = r.randrange(len(w) - n + 1)
        texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(30))] + w[at : at + n]))
    texts.append(" ".join(r.choice(vocabulary) for _ in range(30_000)) + " " + " ".join(items[3]))
    docs, bench = frame(spark, texts, range(len(texts))), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = [sorted(map(tuple, decontaminate.find_leaks(docs, bench, least_score=0.3, least_question=0.3, least_answer=0.1, index_bytes=size).collect())) for size in (8 << 20, 3000, 400)]
    assert found[0] == found[1] == found[2] and len(texts) - 1 in {x[0] for x in found[0]}
    assert len({round(x[2], 2) for x in found[0]}) > 10  # of many different scores
    # a threshold of almost nothing, and against brute force: every item that shares a third of its triples as a whole
    assert decontaminate.find_leaks(docs, bench, least_score=1e-6, index_bytes=400).count() > 0


def test_short_answers(spark):
    item = "How many legs does an ordinary garden spider have when it is fully grown and healthy? Eight legs."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = ["Intro. " + item.replace("Eight legs", "Eight limbs"), "Nothing of that kind stands here."]
    assert [x.doc_id for x in decontaminate.find_leaks(frame(spark, texts, [5, 6]), bench).collect()] == [5]


def test_bounds_lose_nothing():
    import pyarrow as pa

    r = random.Random(7)
    word = lambda: f"w{int(r.random() ** 3 * 300)}"
    items = [" ".join(word() for _ in range(r.randrange(1, 25))) for _ in range(50)]
    count, df, mean = [Counter(i.split()) for i in items], Counter(w for i in items for w in set(i.split())), np.mean([len(i.split()) for i in items])
    hashes = {w: int(decontaminate._words(pa.array([w], pa.large_string())).hashes.view(np.int64)[0]) for w in df}
    index = decontaminate.Index(np.arange(50), items, decontaminate.Statistics({hashes[w]: n for w, n in df.items()}, 50, mean), 24)
    docs = [" ".join(word() for _ in range(r.randrange(0, 200))) for _ in range(30)]
    words = decontaminate._words(pa.array(docs, pa.large_string()))
    got = {(t, a, int(index.ids[i])): s for t, a, _, i, s in index.search(words, 0.4)}
    weight = [{w: math.log1p((50 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, n in c.items()} for c in count]
    want = {}
    for t, d in enumerate(docs):
        w = d.split()
        for a in range(0, max(1, len(w) - index.step) if w else 0, index.step):
            here = set(w[a : a + 2 * index.step])
            for k, x in enumerate(weight):
                if (s := sum(v for q, v in x.items() if q in here) / sum(x.values())) >= 0.4:
                    want[(t, int(words.first[t]) + a, k)] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
