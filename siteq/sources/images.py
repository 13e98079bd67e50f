"""PNG files as rows of measurements (E1): size, spread of grey and two difference hashes, with an error for what cannot be read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Start of the files, samples of a pixel by colour type, passes of interlaced files (first column and row, steps), weights of red, green and blue in 65536.
START = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
LUMA = (19595, 38470, 7471)
#: Pixels that a file may have; columns of the reduced picture that the spread is taken of; rows that are put together at once; bits of a weight.
MOST_PIXELS, REDUCED, STRIP, BITS = 178_956_970, 256, 512, 22

MEASURED = "path string, width long, height long, bytes long, std double, dh64 string, dh256 string, error string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the PNG files below a path. Spark passes over files of no bytes: these have no row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)


def _chunks(body: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(START)
    while at + 12 <= len(body):
        size, kind = int.from_bytes(body[at : at + 4]), body[at + 4 : at + 8]
        data, check = body[at + 8 : at + 8 + size], body[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            break
        if zlib.crc32(kind + data) != int.from_bytes(check):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("the file ends early")


def _along_diagonals(x: np.ndarray, kinds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Pixels of rows whose values are differences to what is left, above and above left: all pixels of a diagonal follow from the two diagonals before."""
    n, w, size = x.shape
    cut, out = np.zeros((w + n - 1, n, size), np.int16), np.zeros((w + n + 1, n + 1, size), np.int16)
    for r in range(n):
        cut[r : r + w, r] = x[r]
    out[1 : w + 1, 0] = before
    kind = kinds.astype(np.int16)[:, None]
    for d in range(w + n - 1):
        a, z = max(0, d - w + 1), min(n, d + 1)
        left, up, corner, k = out[d + 1, a + 1 : z + 1], out[d + 1, a:z], out[d, a:z], kind[a:z]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.where(k == 4, nearest, np.where(k == 3, (left + up) >> 1, np.where(k == 2, up, np.where(k == 1, left, 0))))
        out[d + 2, a + 1 : z + 1] = (cut[d, a:z] + guess) & 255
    rows = np.arange(n)[:, None]
    return out[rows + np.arange(w)[None, :] + 2, rows + 1].astype(np.uint8)


def _rows(raw: np.ndarray, size: int) -> np.ndarray:
    """The bytes of all rows; the first of each row tells how its others are written, `size` bytes are a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("a row has an unknown filter")
    out = np.zeros_like(rows)
    before = np.zeros(rows.shape[1], np.uint8)
    for a in range(0, len(rows), STRIP):
        z = min(len(rows), a + STRIP)
        if kinds[a:z].max() > 2:
            out[a:z] = _along_diagonals(rows[a:z].reshape(z - a, -1, size), kinds[a:z], before.reshape(-1, size)).reshape(z - a, -1)
        else:
            for r in range(a, z):
                out[r] = (rows[r], rows[r].reshape(-1, size).cumsum(axis=0, dtype=np.uint8).ravel(), rows[r] + before)[kinds[r]]
                before = out[r]
        before = out[z - 1]
    return out


def _samples(raw: bytes, at: int, w: int, h: int, depth: int, samples: int) -> tuple[np.ndarray, int]:
    """Values (h, w, samples) of a picture whose rows start at `at`, and where they end. Values of 16 bits keep the upper 8."""
    wide = (w * samples * depth + 7) // 8
    end = at + h * (wide + 1)
    if len(raw) < end:
        raise ValueError("pixels are missing")
    rows = _rows(np.frombuffer(raw, np.uint8, end - at, at).reshape(h, wide + 1), max(1, samples * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : w * samples]
    return rows.reshape(h, w, samples), end


def decode_grey(body: bytes) -> np.ndarray:
    """Grey values (height, width) of a PNG file; transparency is left out."""
    if body[:8] != START:
        raise ValueError("no PNG file")
    data, palette, head = [], None, None
    for kind, x in _chunks(body):
        if kind == b"IHDR":
            head = x
        elif kind == b"PLTE":
            palette = np.frombuffer(x, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(x)
    w, h, depth, colour, _, _, interlaced = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), *head[8:13]
    if not 0 < w * h <= MOST_PIXELS or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError(f"a picture of {w} x {h}, colour type {colour}, {depth} bits")
    samples = SAMPLES[colour]
    raw = zlib.decompressobj().decompress(b"".join(data), h * ((w * samples * depth + 7) // 8 + 1) + 8 * h + 64 * 7)
    if interlaced:
        pixels, at = np.zeros((h, w, samples), np.uint8), 0
        for x0, y0, dx, dy in PASSES:
            part = pixels[y0::dy, x0::dx]
            if part.size:
                part[:], at = _samples(raw, at, part.shape[1], part.shape[0], depth, samples)
    else:
        pixels, _ = _samples(raw, 0, w, h, depth, samples)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("a colour is not in the palette")
        pixels = palette[pixels[:, :, 0]]
    elif depth < 8:
        pixels = pixels * np.uint8(255 // ((1 << depth) - 1))
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return ((sum(pixels[:, :, k].astype(np.int32) * LUMA[k] for k in range(3)) + (1 << 15)) >> 16).astype(np.uint8)


def _weights(n: int, to: int, cubic: bool) -> np.ndarray:
    """Weights (to, n) in whole BITS-bit parts with which n values become `to`: a triangle or a cubic as wide as what a value stands for."""
    scale = n / to
    wide = max(scale, 1.0)
    x = np.abs((np.arange(n)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * scale) / wide)
    inner = 1.5 * x**3 - 2.5 * x**2 + 1  # Keys' cubic with a = -1/2
    outer = -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    w = np.where(x < 1, inner, np.where(x < 2, outer, 0.0)) if cubic else np.maximum(0.0, 1 - x)
    w /= w.sum(axis=1, keepdims=True)
    return np.floor(0.5 + w * (1 << BITS))


def resize(grey: np.ndarray, width: int, height: int, cubic: bool = False) -> np.ndarray:
    """Grey values of another size, columns first, with 8-bit values in between. Products and sums stay below 2^53, so they are exact in doubles."""
    half = 1 << (BITS - 1)
    step = lambda x: np.clip(np.floor((x + half) / (1 << BITS)), 0, 255)
    across = step(grey.astype(np.float64) @ _weights(grey.shape[1], width, cubic).T)
    return step(_weights(grey.shape[0], height, cubic) @ across).astype(np.uint8)


def reduced(grey: np.ndarray) -> np.ndarray:
    """At most REDUCED columns, and rows in proportion: whole boxes of pixels first, while twice the size is left, then a cubic."""
    h, w = grey.shape
    if w <= REDUCED:
        return grey
    to = max(1, round(REDUCED * h / w))
    bx, by = max(1, w // (2 * REDUCED)), max(1, h // (2 * to))
    if bx > 1 or by > 1:
        sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), np.arange(0, h, by), axis=0), np.arange(0, w, bx), axis=1)
        counts = np.diff(np.append(np.arange(0, h, by), h))[:, None] * np.diff(np.append(np.arange(0, w, bx), w))[None, :]
        grey = ((sums + counts // 2) // counts).astype(np.uint8)
    return resize(grey, REDUCED, to, cubic=True)


def difference_hash(grey: np.ndarray, width: int, height: int) -> str:
    """A bit for each value of a width x height grid but a row's last, set where it is larger than the next, in hexadecimal."""
    x = resize(grey, width, height)
    return np.packbits(x[:, :-1] > x[:, 1:]).tobytes().hex()


def measure_images(files: DataFrame) -> DataFrame:
    """(path, width, height, bytes, std, dh64, dh256, error) of PNG files (path, content), as read_images gives them.

    std is the deviation of the grey values of the picture reduced to 256 columns, to two places; dh64 and dh256 are hashes of grids of 9 x 8 and 17 x 16 values of it, by
    triangle filter. A file that cannot be read, a null one included, has sizes and std 0, empty hashes, and the error's first 200 characters; others an empty one.
    Pictures of any size up to MOST_PIXELS are read whole, one at a time.
    """

    def one(path: str | None, body: bytes | None) -> dict:
        row = {"path": path, "width": 0, "height": 0, "bytes": len(body or b""), "std": 0.0, "dh64": "", "dh256": "", "error": ""}
        try:
            grey = decode_grey(body or b"")
            small = reduced(grey)
            return row | {"width": grey.shape[1], "height": grey.shape[0], "std": round(float(small.std()), 2), "dh64": difference_hash(small, 9, 8), "dh256": difference_hash(small, 17, 16)}
        except (ValueError, TypeError, IndexError, zlib.error) as e:  # whatever a damaged file can cause
            return row | {"error": (str(e) or type(e).__name__)[:200]}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([one(p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)])

    return files.select("path", "content").mapInArrow(rows, MEASURED)
