"""Pixels of one image: PNG files, resizing, difference hashes, colour histograms, model inputs.

Arrays are (height, width, channels) of bytes. Everything here works on one image inside a task;
auditloom.sources.images applies it to tables.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
#: How files of the usual kinds begin; fixed values.
_BEGINNINGS = {"png": _PNG, "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM", "webp": b"RIFF"}
#: Samples of a pixel by PNG colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The most bytes of pixels that are unpacked: what a header promises isn't believed beyond it.
MOST_BYTES = 256 << 20


class BadImage(ValueError):
    """An image that can't be read; the text is the reason, one of a few."""


def kind_of(content: bytes) -> str:
    return next((k for k, b in _BEGINNINGS.items() if content.startswith(b)), "unknown")


def png(image: np.ndarray) -> bytes:
    """A PNG file of a gray or RGB image; its rows use the five row filters in turn."""
    height, width, samples = image.shape
    rows, before = [], np.zeros(width * samples, np.int64)
    for y in range(height):
        row = image[y].reshape(-1).astype(np.int64)
        left = np.concatenate([np.zeros(samples, np.int64), row[:-samples]])
        corner = np.concatenate([np.zeros(samples, np.int64), before[:-samples]])
        guess = (0, left, before, (left + before) // 2, _paeth(left, before, corner))[y % 5]
        rows.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        before = row
    header = struct.pack(">IIBBBBB", width, height, 8, 0 if samples == 1 else 2, 0, 0, 0)
    chunks = ((b"IHDR", header), (b"IDAT", zlib.compress(b"".join(rows))), (b"IEND", b""))
    return _PNG + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in chunks)


def _paeth(left, above, corner):
    """Of the three neighbours, the one nearest to left + above - corner."""
    p = left + above - corner
    a, b, c = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))


def read_png(content: bytes) -> np.ndarray:
    """The gray or RGB pixels of a PNG file without transparency and interlacing, all chunks checked."""
    if not content:
        raise BadImage("empty file")
    if not content.startswith(_PNG):
        raise BadImage("truncated file" if _PNG.startswith(content[:8]) else f"not a PNG file: {kind_of(content)}")
    at, header, palette, packed = 8, None, None, []
    while True:
        if at + 12 > len(content):
            raise BadImage("truncated file")
        (size,), name = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        if at + 12 + size > len(content):
            raise BadImage("truncated file")
        data = content[at + 8 : at + 8 + size]
        if struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + data):
            raise BadImage("checksum differs")
        at += 12 + size
        if name == b"IHDR" and size == 13:
            header = struct.unpack(">IIBBBBB", data)
        elif name == b"PLTE":
            palette = np.frombuffer(data, np.uint8)[: size // 3 * 3].reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(data)
        elif name == b"IEND":
            break
    if header is None or not header[0] or not header[1]:
        raise BadImage("no header")
    width, height, depth, colour, _, _, interlaced = header
    if interlaced or colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise BadImage("unsupported form")
    bits = depth * _SAMPLES[colour]
    step, line = max(1, bits // 8), -(-width * bits // 8)
    if (line + 1) * height > MOST_BYTES:
        raise BadImage("too large")
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(packed), (line + 1) * height)
    except zlib.error:
        raise BadImage("damaged pixels") from None
    if len(raw) < (line + 1) * height:
        raise BadImage("damaged pixels")
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    return _samples(_unfiltered(rows[:, 0], rows[:, 1:], step), width, depth, colour, palette)


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(rows.shape, np.uint8)
    before = np.zeros(rows.shape[1], np.int64)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y].astype(np.int64)
        if kind == 1:
            for s in range(step):
                row[s::step] = np.cumsum(row[s::step])
        elif kind == 2:
            row += before
        elif kind in (3, 4):
            row = _from_left(row.tolist(), before.tolist(), step, kind)
        elif kind:
            raise BadImage("damaged pixels")
        before = np.asarray(row) % 256
        out[y] = before
    return out


def _from_left(row: list[int], above: list[int], step: int, kind: int) -> list[int]:
    """Filters 3 and 4, which need each pixel before the next one."""
    for i, value in enumerate(row):
        a, b, c = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if kind == 3:
            row[i] = (value + (a + b) // 2) & 255
        else:
            p = a + b - c
            row[i] = (value + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
    return row


def _samples(rows: np.ndarray, width: int, depth: int, colour: int, palette: np.ndarray | None) -> np.ndarray:
    height, n = len(rows), _SAMPLES[colour]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * n * depth].reshape(height, width * n, depth)
        rows = (bits << np.arange(depth - 1, -1, -1)).sum(2).astype(np.uint8)
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    elif depth == 16:
        rows = rows[:, ::2]
    image = rows.reshape(height, width, n)
    if colour == 3:
        if int(image.max(initial=0)) >= len(palette):
            raise BadImage("damaged pixels")
        return palette[image[:, :, 0]]
    return image[:, :, : 1 if n < 3 else 3]  # without its transparency


def from_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The pixels of a row of Spark's image source."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image if channels == 1 else image[:, :, 2::-1]


def gray(image: np.ndarray) -> np.ndarray:
    """Luma 299/587/114 in fixed-point numbers of 16 bits, rounded."""
    if image.shape[2] == 1:
        return image
    weights = np.array([19595, 38470, 7471])  # fixed values
    return ((image.astype(np.int64) @ weights + 0x8000) >> 16).astype(np.uint8)[:, :, None]


def rgb(image: np.ndarray) -> np.ndarray:
    return np.repeat(image, 3, 2) if image.shape[2] == 1 else image


# --------------------------------------------------------------------------- resizing


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0.0)


def _bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _bicubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)  # Keys' kernel, a = -0.5
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


FILTERS = {"lanczos": (_lanczos, 3.0), "bilinear": (_bilinear, 1.0), "bicubic": (_bicubic, 2.0)}
#: Binary places of a weight.
PLACES = 22


@functools.lru_cache(maxsize=256)
def weights(size: int, to: int, kind: str) -> np.ndarray:
    """The banded matrix (to, size) that resamples a line: a row holds the filter's values around
    its place, stretched where the line shrinks, made to sum to 1, as numbers of PLACES places."""
    function, reach = FILTERS[kind]
    scale = size / to
    stretch = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    low = np.maximum((centre - reach * stretch + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + reach * stretch + 0.5).astype(np.int64), size)
    place = np.arange(size)
    band = (place >= low[:, None]) & (place < high[:, None])
    w = np.where(band, function((place - centre[:, None] + 0.5) / stretch), 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << PLACES)
    return np.trunc(w + np.copysign(0.5, w))


def resize(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """Lines are resampled first, then columns; both results are rounded to bytes. Sums of bytes
    times weights are whole numbers below 2 ** 53, so products of floating point are exact."""
    out = image
    if width != image.shape[1]:
        out = _bytes(np.einsum("yxc,ux->yuc", out.astype(np.float64), weights(image.shape[1], width, kind), optimize=True))
    if height != image.shape[0]:
        out = _bytes(np.einsum("yxc,vy->vxc", out.astype(np.float64), weights(image.shape[0], height, kind), optimize=True))
    return out


def _bytes(sums: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((sums + (1 << PLACES - 1)) / (1 << PLACES)), 0, 255).astype(np.uint8)


# --------------------------------------------------------------------------- what is told of an image


def dhash(image: np.ndarray, size: int = 8, first_high: bool = False) -> int:
    """The difference hash as a signed number of 64 bits: whether a pixel of the gray image of
    (size + 1) x size is brighter than the next, from the lowest bit on, or from the highest."""
    small = resize(gray(image), size + 1, size, "lanczos")[:, :, 0]
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    whole = sum(1 << i for i in np.flatnonzero(bits[::-1] if first_high else bits).tolist())
    return whole - (1 << 64) if whole >> 63 else whole


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue, saturation and value as bytes, cut off, worked out in single precision."""
    r, g, b = (image[:, :, i].astype(np.float32) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    range_ = np.where(top > low, top - low, np.float32(1))
    rc, gc, bc = ((top - x) / range_ for x in (r, g, b))
    hue = np.where(r == top, bc - gc, np.where(g == top, np.float32(2) + rc - bc, np.float32(4) + gc - rc)).astype(np.float64)
    hue = np.fmod(hue / 6.0 + 1.0, 1.0).astype(np.float32)
    saturation = range_ / np.where(top > 0, top, np.float32(1))
    plain = top == low
    return np.stack([np.where(plain, 0, hue.astype(np.float64) * 255.0), np.where(plain, 0, saturation.astype(np.float64) * 255.0), top], 2).astype(np.uint8)


#: Bins of hue, saturation and value.
HSV_BINS = (24, 8, 8)


def hsv_histogram(image: np.ndarray, edge: int = 64) -> np.ndarray:
    """Shares of the bins of hue, saturation and value of the image at edge x edge pixels; each of
    the three blocks sums to 1."""
    points = hsv(resize(rgb(image), edge, edge, "bicubic"))
    return np.concatenate([np.bincount(points[:, :, i].reshape(-1).astype(np.int64) * n // 256, minlength=n) / points[:, :, i].size for i, n in enumerate(HSV_BINS)])


# --------------------------------------------------------------------------- model inputs


def _cropped(image: np.ndarray, size: int) -> np.ndarray:
    """The middle; beyond a smaller image's right and lower edge is black."""
    top, left = (max((n - size) // 2, 0) for n in image.shape[:2])
    part = image[top : top + size, left : left + size]
    out = np.zeros((size, size, image.shape[2]), np.uint8)
    out[: part.shape[0], : part.shape[1]] = part
    return out


def _short_side(image: np.ndarray, size: int) -> np.ndarray:
    height, width = image.shape[:2]
    if width <= height:
        return resize(image, size, max(round(size * height / width), size), "bilinear")
    return resize(image, max(round(size * width / height), size), size, "bilinear")


def _letterboxed(image: np.ndarray, size: int, fill: int) -> np.ndarray:
    height, width = image.shape[:2]
    scale = min(size / width, size / height)
    inner = resize(image, max(round(width * scale), 1), max(round(height * scale), 1), "bilinear")
    out = np.full((size, size, image.shape[2]), fill, np.uint8)
    top, left = (size - inner.shape[0]) // 2, (size - inner.shape[1]) // 2
    out[top : top + inner.shape[0], left : left + inner.shape[1]] = inner
    return out


#: The five ways to make an image a square; fixed names.
TRANSFORMS = {
    "app": lambda image, size: resize(image, size, size, "bilinear"),
    "short-side-crop": lambda image, size: _cropped(_short_side(image, size), size),
    "short-side-1.14-crop": lambda image, size: _cropped(_short_side(image, round(size * 1.14)), size),
    "letterbox-114": lambda image, size: _letterboxed(image, size, 114),
    "letterbox-0": lambda image, size: _letterboxed(image, size, 0),
}


def model_input(image: np.ndarray, size: int, transform: str, channels_first: bool = False) -> np.ndarray:
    """The image as a model takes it: values from 0 to 1 by line, pixel and channel, or by channel first."""
    out = TRANSFORMS[transform](rgb(image), size).astype(np.float32) / np.float32(255)
    return out.transpose(2, 0, 1) if channels_first else out
