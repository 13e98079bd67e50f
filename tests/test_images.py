"""Picture measurements: files of every kind against the pixels that they were made of, and hashes against plain arithmetic."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteq.operators import shots
from siteq.sources import images


def written(x, depth, colour, interlaced=False, palette=None, seed=0, parts=1):
    """A PNG file of values (h, w, samples), with a filter drawn for each row; byte by byte, as the format is defined."""
    draw = random.Random(seed)

    def rows(part):
        h, w, n = part.shape
        size, out, before = max(1, n * depth // 8), b"", None
        for r in range(h):
            if depth == 16:
                raw = b"".join(int(v).to_bytes(2) for v in part[r].ravel())
            else:
                bits = "".join(f"{int(v):0{depth}b}" for v in part[r].ravel())
                raw = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
            kind, coded = draw.randrange(5), bytearray()
            above = before or bytes(len(raw))
            for k, v in enumerate(raw):
                a, b, c = (raw[k - size] if k >= size else 0), above[k], (above[k - size] if k >= size else 0)
                p = min((a, b, c), key=lambda y: (abs(a + b - c - y), (a, b, c).index(y)))
                coded.append((v - (0, a, b, (a + b) // 2, p)[kind]) & 255)
            out += bytes([kind]) + bytes(coded)
            before = raw
        return out

    h, w, _ = x.shape
    if interlaced:
        data = b"".join(rows(part) for x0, y0, dx, dy in images.PASSES if (part := x[y0::dy, x0::dx]).size)
    else:
        data = rows(x)
    chunk = lambda kind, body: len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)
    data = zlib.compress(data)
    cuts = [len(data) * k // parts for k in range(parts + 1)]
    head = w.to_bytes(4) + h.to_bytes(4) + bytes([depth, colour, 0, 0, int(interlaced)])
    plte = chunk(b"PLTE", bytes(palette)) if palette is not None else b""
    return images.START + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + plte + b"".join(chunk(b"IDAT", data[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)) + chunk(b"IEND", b"")


def grey(r, g, b):
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_all_kinds_of_files(colour, depth, interlaced):
    draw = np.random.default_rng(depth * 10 + colour)
    for h, w in ((1, 1), (3, 5), (13, 9), (9, 16)):
        n = images.SAMPLES[colour]
        x = draw.integers(0, 1 << depth, (h, w, n))
        palette = draw.integers(0, 256, 3 << depth).tolist() if colour == 3 else None
        got = images.decode_grey(written(x, depth, colour, interlaced, palette, seed=h, parts=3))
        eight = x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1))
        for r in range(h):
            for c in range(w):
                rgb = palette[3 * x[r, c, 0] : 3 * x[r, c, 0] + 3] if colour == 3 else eight[r, c, :3] if colour in (2, 6) else None
                assert got[r, c] == (grey(*(int(v) for v in rgb)) if rgb is not None else eight[r, c, 0])


def test_tall_pictures():
    """More rows than are put together at once."""
    x = np.random.default_rng(1).integers(0, 256, (images.STRIP + 40, 7, 3))
    got = images.decode_grey(written(x, 8, 2))
    assert (got == (x @ np.array(images.LUMA) + 32768 >> 16)).all()


def resized_by_hand(x, width, height):
    """Triangle filter in plain floats, columns first."""

    def along(values, to):
        n, out = len(values), []
        scale = n / to
        wide = max(1.0, scale)
        for i in range(to):
            w = [max(0.0, 1 - abs(k + 0.5 - (i + 0.5) * scale) / wide) for k in range(n)]
            out.append(min(255, max(0, math.floor(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w) + 0.5))))
        return out

    rows = [along(list(map(int, r)), width) for r in x]
    return list(zip(*(along(c, height) for c in zip(*rows, strict=True)), strict=True))


@pytest.mark.parametrize("shape", [(16, 17), (8, 9), (50, 33), (5, 4), (1, 1), (200, 90)])
def test_resize(shape):
    x = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
    for w, h in ((9, 8), (17, 16)):
        got = images.resize(x, w, h)
        assert np.abs(got.astype(int) - np.array(resized_by_hand(x, w, h))).max() <= 1  # a half may round the other way
    assert (images.resize(x, shape[1], shape[0]) == x).all()


def test_reduced_pictures():
    flat = np.full((3000, 1400), 77, np.uint8)
    assert images.reduced(flat).shape == (549, 256) and (images.reduced(flat) == 77).all()
    assert images.reduced(flat[:10, :256]).shape == (10, 256) and images.reduced(flat[:1]).shape == (1, 256)
    halves = np.repeat(np.array([[0, 200]], np.uint8), 600, axis=1).repeat(900, axis=0)
    assert abs(images.reduced(halves).std() - 100) < 1.5


def test_measure_files(spark, tmp_path):
    """Files in nested folders by the binaryFile source: good ones, damaged ones, none at all."""
    x = np.random.default_rng(5).integers(0, 256, (16, 17, 1))
    good = written(x, 8, 0)
    bad = {"empty": b"", "text": b"no picture", "cut": good[:-30], "flipped": good[:60] + bytes([good[60] ^ 1]) + good[61:], "huge": good[:16] + (1 << 30).to_bytes(4) + good[20:]}
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "good.png").write_bytes(good)
    (tmp_path / "a" / "other.txt").write_bytes(good)
    for name, body in bad.items():
        (tmp_path / f"{name}.png").write_bytes(body)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in images.measure_images(images.read_images(spark, str(tmp_path))).collect()}
    del bad["empty"]
    assert set(rows) == {"good.png", *(f"{n}.png" for n in bad)}
    r = rows["good.png"]
    bits = "".join("1" if x[i, j, 0] > x[i, j + 1, 0] else "0" for i in range(16) for j in range(16))
    assert (r.width, r.height, r.bytes, r.error, r.dh256, r.std) == (17, 16, len(good), "", f"{int(bits, 2):064x}", round(float(x.std()), 2)) and len(r.dh64) == 16
    assert all(rows[f"{n}.png"].error and rows[f"{n}.png"].width == 0 and rows[f"{n}.png"].dh64 == "" for n in bad)
    null = images.measure_images(spark.createDataFrame([("x", None)], "path string, content binary")).first()
    assert null.error and null.bytes == 0
    assert images.measure_images(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_measures_feed_the_audit_of_shots(spark):
    """From files to device statistics, flags, equal looks and clusters."""
    draw = np.random.default_rng(9)
    looks = [draw.integers(0, 256, (16, 17, 1)) for _ in range(3)]
    blank = np.full((16, 17, 1), 9)
    files = [(f"p{k}-{k:08x}__desktop.png", bytearray(written(blank if k == 7 else looks[k % 3], 8, 0))) for k in range(20)] + [("q-00000001__desktop.png", bytearray(b"x"))]
    m = images.measure_images(spark.createDataFrame(files, "path string, content binary"))
    m = m.select("*", shots.parse_shot_name(F.col("path")).alias("n")).select("*", "n.page", "n.device", F.lit(None).cast("string").alias("template"))
    m = m.withColumns({"hash": shots.hash_bits(F.col("dh64")), "look": F.nullif("dh256", F.lit("")), "error": F.nullif("error", F.lit("")), "pos": F.monotonically_increasing_id(), "id": F.col("path")})
    stats = shots.device_stats(m)
    flags = shots.shot_flags(m, stats)
    got = {r.path: list(r["flags"]) for r in flags.collect()}
    assert got["q-00000001__desktop.png"] == ["BOZUK_DOSYA"] and got["p7-00000007__desktop.png"] == ["BOS_SAYFA"] and got["p1-00000001__desktop.png"] == []
    assert sorted(r.n_pages for r in shots.same_look(flags).collect()) == [6, 6, 7]
    clusters = {r.id: r.cluster for r in shots.greedy_clusters(m.where("error IS NULL"), eps=4).collect()}
    assert len({clusters[f"p{k}-{k:08x}__desktop.png"] for k in (0, 3, 6)}) == 1 and len(set(clusters.values())) == 4
