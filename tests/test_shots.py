"""Visual clusters and nearest centres against brute force."""

import random

from siteq.operators import shots as S


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def shots(n, seed=5):
    """Hashes around a few points, some repeated, in three templates of which one is missing, with ties of height."""
    draw = random.Random(seed)
    points = [draw.getrandbits(64) for _ in range(9)]
    rows = []
    for i in range(n):
        h = draw.choice(points)
        for _ in range(draw.randrange(9)):
            h ^= 1 << draw.randrange(64)
        rows.append((draw.choice(["a", "a", "b", None]), i, h - 2**64 if h >= 2**63 else h, draw.randrange(20)))
    return rows


def test_greedy_clusters(spark):
    rows = shots(300)
    want, centres = {}, {}
    for t, i, h, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        known = centres.setdefault(t, [])
        k = next((k for k, c in enumerate(known) if bits(c, h) <= 6), len(known))
        known += [h] if k == len(known) else []
        want[i] = k
    schema = "template string, id long, hash long, height long"
    for block in (2, 256):
        got = S.greedy_clusters(spark.createDataFrame([*rows, ("a", 999, None, 1)], schema), 6, block, 8).collect()
        assert {r["id"]: r["cluster"] for r in got} == want and len(got) == len(rows)
    assert S.greedy_clusters(spark.createDataFrame([], schema)).collect() == []


def test_assign_nearest(spark):
    rows = shots(120)
    near = [(s, f"t{k}", h) for k, (_, _, h, _) in enumerate(rows[:40]) for s in ("a", "b") if k % 3 or s == "a"]
    want = {}
    for s, i, h, _ in rows[40:]:
        best = min(((bits(h, c), t) for q, t, c in near if q == s), default=(99, ""))
        want[i] = (best[1], f"gorsel({best[0]})") if best[0] <= 5 else (None if s is None else f"{s}/[kesik]", "yok")
    lost = spark.createDataFrame([(i, s, h) for s, i, h, _ in rows[40:]], "id long, section string, hash long")
    centres = spark.createDataFrame(near, "section string, template string, centre long")
    for chunk in (3, 1024):
        assert {r["id"]: (r["template"], r["how"]) for r in S.assign_nearest(lost, centres, 5, chunk).collect()} == want
