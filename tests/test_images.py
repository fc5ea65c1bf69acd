"""Pixels against plain loops, PNG files in all forms, and tables of files with damage."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from auditloom.functions import pixels
from auditloom.sources import images


def some_image(seed, width, height, samples=3):
    rng = np.random.default_rng(seed)
    return np.clip(rng.normal(128, 70, (height, width, samples)), 0, 255).astype(np.uint8)


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def raw_png(width, height, depth, colour, lines, more=b"", interlaced=0):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + more + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 3])
@pytest.mark.parametrize("width,height", [(1, 1), (7, 12), (40, 3)])
def test_png_round_trip_with_all_row_filters(width, height, samples):
    image = some_image(width, width, height, samples)
    assert np.array_equal(pixels.read_png(pixels.png(image)), image)


def test_png_forms():
    bits = pixels.read_png(raw_png(5, 2, 1, 0, [b"\xa8", b"\x50"]))
    assert bits[:, :, 0].tolist() == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]]
    assert pixels.read_png(raw_png(3, 1, 4, 0, [b"\x0f\x80"]))[0, :, 0].tolist() == [0, 255, 136]
    assert pixels.read_png(raw_png(2, 1, 16, 2, [bytes(range(12))]))[0].tolist() == [[0, 2, 4], [6, 8, 10]]
    assert pixels.read_png(raw_png(2, 1, 8, 6, [bytes(range(8))]))[0].tolist() == [[0, 1, 2], [4, 5, 6]]
    assert pixels.read_png(raw_png(2, 1, 8, 4, [b"\x01\x02\x03\x04"]))[0].tolist() == [[1], [3]]
    assert pixels.read_png(raw_png(4, 1, 2, 3, [b"\x1b"], chunk(b"PLTE", bytes(range(12)))))[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]


GOOD = pixels.png(some_image(1, 8, 8))


@pytest.mark.parametrize("content,reason", [
    (b"", "empty file"), (GOOD[:5], "truncated file"), (GOOD[:-3], "truncated file"), (GOOD[:40], "truncated file"), (b"\xff\xd8\xff" + GOOD, "not a PNG file: jpeg"), (b"BM123", "not a PNG file: bmp"), (b"hello", "not a PNG file: unknown"),
    (GOOD[:50] + bytes([GOOD[50] ^ 1]) + GOOD[51:], "checksum differs"), (GOOD[:18] + b"\x01" + GOOD[19:], "checksum differs"),
    (raw_png(2, 2, 8, 0, [b"ab"]), "damaged pixels"), (raw_png(0, 2, 8, 0, [b"ab"]), "no header"), (raw_png(2, 1, 8, 0, [b"ab"], interlaced=1), "unsupported form"), (raw_png(2, 1, 8, 3, [b"ab"]), "unsupported form"),
    (raw_png(1, 1, 8, 3, [b"\x09"], chunk(b"PLTE", b"abc")), "damaged pixels"), (raw_png(1 << 30, 1 << 30, 8, 0, [b"a"]), "too large"),
    (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"no zlib") + chunk(b"IEND", b""), "damaged pixels"),
])
def test_reasons_of_bad_images(content, reason):
    with pytest.raises(pixels.BadImage) as e:
        pixels.read_png(content)
    assert str(e.value) == reason


def kernel(kind, x):
    if kind == "lanczos":
        return 1.0 if x == 0 else math.sin(math.pi * x) * math.sin(math.pi * x / 3) * 3 / (math.pi * x) ** 2 if -3 <= x < 3 else 0.0
    if kind == "bilinear":
        return max(0.0, 1 - abs(x))
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def line(values, to, kind):
    reach, out = {"lanczos": 3, "bilinear": 1, "bicubic": 2}[kind], []
    scale = len(values) / to
    stretch = max(scale, 1)
    for o in range(to):
        centre = (o + 0.5) * scale
        places = range(max(0, int(centre - reach * stretch + 0.5)), min(len(values), int(centre + reach * stretch + 0.5)))
        w = [kernel(kind, (p - centre + 0.5) / stretch) for p in places]
        fixed = [int(x / sum(w) * 2**22 + math.copysign(0.5, x)) for x in w]
        out.append(max(0, min(255, (sum(values[p] * f for p, f in zip(places, fixed)) + 2**21) >> 22)))
    return out


def plain_resize(grid, width, height, kind):
    rows = [line(r, width, kind) if width != len(r) else r for r in grid]
    if height != len(rows):
        rows = [list(r) for r in zip(*[line(list(c), height, kind) for c in zip(*rows)])]
    return rows


@pytest.mark.parametrize("kind", ["lanczos", "bilinear", "bicubic"])
@pytest.mark.parametrize("size,to", [((24, 32), (9, 8)), ((9, 8), (9, 8)), ((5, 40), (64, 7)), ((1, 1), (3, 2)), ((33, 9), (9, 9))])
def test_resize_against_loops(kind, size, to):
    image = some_image(3, *size, samples=1)
    assert pixels.resize(image, *to, kind)[:, :, 0].tolist() == plain_resize(image[:, :, 0].tolist(), *to, kind)


def test_signature_against_loops():
    for seed in range(30):
        image = some_image(seed, random.Random(seed).randrange(3, 60), 31)
        luma = [[(r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 for r, g, b in row] for row in image.tolist()]
        small = plain_resize(luma, 9, 8, "lanczos")
        bits = [int(small[y][x] > small[y][x + 1]) for y in range(8) for x in range(8)]
        assert pixels.dhash(image) % 2**64 == sum(b << i for i, b in enumerate(bits))
        assert pixels.dhash(image, first_high=True) % 2**64 == int("".join(map(str, bits)), 2)


def test_colours_against_loops():
    image = np.concatenate([some_image(5, 64, 60), np.repeat(np.arange(0, 256, dtype=np.uint8)[:, None], 3, 1).reshape(4, 64, 3)])
    f = np.float32
    want = []
    for r, g, b in image.reshape(-1, 3).tolist():
        top, low = max(r, g, b), min(r, g, b)
        h = s = 0
        if top > low:
            d = f(top - low)
            rc, gc, bc = f(top - r) / d, f(top - g) / d, f(top - b) / d
            x = bc - gc if r == top else f(2) + rc - bc if g == top else f(4) + gc - rc
            h, s = int(float(f(math.fmod(float(x) / 6.0 + 1.0, 1.0))) * 255.0), int(float(d / f(top)) * 255.0)
        want.append([h, s, top])
    assert pixels.hsv(image).reshape(-1, 3).tolist() == want
    histogram = pixels.hsv_histogram(image)
    counts = [0] * 40
    for h, s, top in want:
        for at in (h * 24 // 256, 24 + s * 8 // 256, 32 + top * 8 // 256):
            counts[at] += 1
    assert histogram.tolist() == [c / 4096 for c in counts]
    for seed in range(5):  # of any size
        found = pixels.hsv_histogram(some_image(seed, 17 + seed, 200, 1 + 2 * (seed % 2)))
        assert [found[a:b].sum() for a, b in ((0, 24), (24, 32), (32, 40))] == pytest.approx([1, 1, 1])


@pytest.mark.parametrize("width,height", [(20, 30), (30, 20), (16, 16), (5, 9), (64, 3)])
def test_model_inputs(width, height):
    image, size = some_image(7, width, height), 16
    planes = [image[:, :, c].tolist() for c in range(3)]

    def short(to):
        w, h = (to, max(round(to * height / width), to)) if width <= height else (max(round(to * width / height), to), to)
        return [plain_resize(p, w, h, "bilinear") for p in planes]

    def middle(p):
        top, left = max((len(p) - size) // 2, 0), max((len(p[0]) - size) // 2, 0)
        return [r[left : left + size] for r in p[top : top + size]]

    def boxed(fill):
        scale = min(size / width, size / height)
        w, h = max(round(width * scale), 1), max(round(height * scale), 1)
        out = []
        for p in planes:
            inner, canvas = plain_resize(p, w, h, "bilinear"), [[fill] * size for _ in range(size)]
            for y, r in enumerate(inner):
                canvas[(size - h) // 2 + y][(size - w) // 2 : (size - w) // 2 + w] = r
            out.append(canvas)
        return out

    want = {"app": [plain_resize(p, size, size, "bilinear") for p in planes], "short-side-crop": [middle(p) for p in short(16)], "short-side-1.14-crop": [middle(p) for p in short(18)], "letterbox-114": boxed(114), "letterbox-0": boxed(0)}
    for name, expected in want.items():
        first = pixels.model_input(image, size, name, channels_first=True)
        assert np.array_equal(first, np.array(expected, np.float32) / np.float32(255))
        assert np.array_equal(pixels.model_input(image, size, name), first.transpose(1, 2, 0))
    small = pixels.TRANSFORMS["short-side-crop"](some_image(1, 4, 4), 4)
    assert small.shape == (4, 4, 3) and pixels._cropped(small, 6)[4:].max() == 0


def test_files_of_a_tree_by_both_sources(spark, tmp_path):
    """The own decoder and Spark's image source tell the same of PNG files, and both tell bad ones."""
    held = {}
    for i in range(12):
        held[f"a/{i}.png"] = some_image(i, 10 + i, 40 - i, 1 if i % 3 == 0 else 3)
    (tmp_path / "a").mkdir()
    for name, image in held.items():
        (tmp_path / name).write_bytes(pixels.png(image))
    (tmp_path / "a/cut.png").write_bytes(GOOD[:60])
    (tmp_path / "a/empty.png").write_bytes(b"")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    own = {r.path.rpartition("/")[2]: r for r in images.examined(files, ["dhash", "hsv"]).collect()}
    other = {r.path.rpartition("/")[2]: r for r in images.decoded(spark, str(tmp_path), ["dhash", "hsv"]).collect()}
    assert len(own) == len(other) == 13  # Spark's file sources leave out files of no bytes
    for name, image in held.items():
        for found in (own[name[2:]], other[name[2:]]):
            assert (found.width, found.height, found.dhash) == (image.shape[1], image.shape[0], pixels.dhash(image))
            assert found.hsv == pytest.approx(pixels.hsv_histogram(image).tolist())
        assert own[name[2:]].reason is None
    assert (own["cut.png"].reason, own["cut.png"].kind, other["cut.png"].width) == ("truncated file", "png", None)


def test_tables_of_files_with_nulls_and_none_at_all(spark):
    df = spark.createDataFrame([("a", None, 1), (None, bytearray(GOOD), 2), ("a", bytearray(GOOD), 3)], "path string, content binary, key int")
    assert sorted((r.path or "", r.reason or "") for r in images.examined(df, ["hsv"]).collect()) == [("", ""), ("a", ""), ("a", "empty file")]
    assert images.examined(df.limit(0)).count() == images.model_inputs(df.limit(0), 8).count() == 0
    assert images.model_inputs(df, 8, ["app"]).count() == 2


def test_files_are_drawn_in_even_tasks(spark, tmp_path):
    """A table of one file and one row group makes as many tasks as there are cores, and more."""
    from auditloom.plans.images import SMALL, drawn

    vectors = spark.range(200).selectExpr("id as vec_id", "cast(id % 3 as int) as label", "transform(sequence(1, 64), x -> cast(sin(x * id) as float)) as embedding")
    vectors.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = drawn(spark, str(tmp_path), SMALL)
    counts = [n for n in rows.select("vec_id").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert sum(counts) == 200 and max(counts) < 50
