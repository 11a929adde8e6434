"""Picture operators on RGB bytes, as numpy functions and as Arrow-batched UDFs.

A picture is struct<width:int, height:int, rgb:binary>, rows from the top. PNG is read and written here; files of any format that
the JVM reads (JPEG, PNG, BMP, GIF) come through Spark's image source (sources.manifests.decoded_pictures). jpeg() does all
that is lossy in baseline JPEG; the entropy coding, which is lossless, is left out.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

PICTURE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
# The luminance quantisation table of the JPEG standard (annex K).
_LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]], dtype=float)
# The chrominance quantisation table of the same annex, which is 99 beyond its upper left corner.
_CHROMINANCE = np.full((8, 8), 99.0)
_CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
# Luminance, and the two colour differences, of red, green and blue.
_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def triangle(d: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - d)


def cubic(d: np.ndarray) -> np.ndarray:
    """The cubic kernel with slope -1/2."""
    return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0.0))


def _bands(x: np.ndarray, size: int, axis: int, kernel=triangle) -> np.ndarray:
    """Resampling along one axis, the kernel as much wider as the axis gets shorter."""
    n = x.shape[axis]
    scale = n / size
    centre = (np.arange(size) + 0.5) * scale
    w = kernel(np.abs(centre[:, None] - (np.arange(n)[None] + 0.5)) / max(1.0, scale))
    w /= w.sum(1, keepdims=True)
    return np.moveaxis(np.tensordot(w, np.moveaxis(x, axis, 0), axes=(1, 0)), 0, axis)


def resize(img: np.ndarray, height: int, width: int, kernel=triangle) -> np.ndarray:
    return to_bytes(_bands(to_bytes(_bands(img.astype(float), width, 1, kernel)).astype(float), height, 0, kernel))


def squish(img: np.ndarray, size: int) -> np.ndarray:
    """size x size by the cubic kernel, whatever the aspect."""
    return resize(img, size, size, cubic)


def resize_down_up(img: np.ndarray, factor: float) -> np.ndarray:
    h, w = img.shape[:2]
    return resize(resize(img, max(1, round(h * factor)), max(1, round(w * factor))), h, w)


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, edges repeated."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    x = img.astype(float)
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        y = np.pad(x, pad, mode="edge")
        x = sum(c * np.take(y, np.arange(i, i + img.shape[axis]), axis=axis) for i, c in enumerate(k))
    return to_bytes(x)


def noise(img: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    x = img.astype(np.float32) / 255 + np.random.default_rng(seed).normal(0, sigma, img.shape).astype(np.float32)
    return to_bytes(np.clip(x, 0, 1) * 255)


def color(img: np.ndarray, amount: float, seed: int) -> np.ndarray:
    """Brightness, contrast and saturation, each by its own factor of 1 - amount to 1 + amount."""
    bright, contrast, saturation = 1 + np.random.default_rng(seed).uniform(-amount, amount, 3)
    x = to_bytes(img.astype(float) * bright).astype(float)
    mid = (x @ _YCC[0]).mean()
    x = to_bytes(mid + (x - mid) * contrast).astype(float)
    grey = (x @ _YCC[0])[..., None]
    return to_bytes(grey + (x - grey) * saturation)


def crop(img: np.ndarray, part: float) -> np.ndarray:
    h, w = img.shape[:2]
    ch, cw = max(1, round(h * part)), max(1, round(w * part))
    top, left = (h - ch) // 2, (w - cw) // 2
    return img[top : top + ch, left : left + cw]


def flip(img: np.ndarray) -> np.ndarray:
    return img[:, ::-1]


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane after quantisation of the cosine transform of its 8 x 8 blocks."""
    k = np.arange(8)
    d = np.sqrt(0.25) * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    d[0] /= np.sqrt(2)
    h, w = plane.shape
    x = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    b = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    b = d.T @ (np.rint(d @ b @ d.T / table) * table) @ d
    return b.transpose(0, 2, 1, 3).reshape(x.shape)[:h, :w]


def jpeg(img: np.ndarray, quality: int, codec=None) -> np.ndarray:
    """What baseline JPEG leaves of a picture: luminance and colour differences, these at half the resolution, their cosine blocks
    quantised by the standard's tables. codec(img, quality) is taken where one is at hand."""
    if codec is not None:
        return codec(img, quality)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (_LUMINANCE, _CHROMINANCE)]
    ycc = img.astype(float) @ _YCC.T
    h, w = img.shape[:2]
    out = [_quantised(np.rint(ycc[..., 0]) - 128, tables[0]) + 128]
    for c in (1, 2):
        plane = np.pad(ycc[..., c], ((0, h % 2), (0, w % 2)), mode="edge")
        half = np.rint(plane.reshape(plane.shape[0] // 2, 2, plane.shape[1] // 2, 2).mean((1, 3)))
        out.append(_quantised(half, tables[1]).repeat(2, 0).repeat(2, 1)[:h, :w])
    return to_bytes(np.clip(np.rint(np.stack(out, -1)), -255, 255) @ np.linalg.inv(_YCC).T)


class Family(NamedTuple):
    """A degradation: its levels from mild to harsh, and what it does to a picture at a level with a seed."""

    levels: tuple[float, ...]
    apply: Callable[[np.ndarray, float, int], np.ndarray]


# The families, in their order, and their levels.
FAMILIES: dict[str, Family] = {
    "jpeg": Family((90, 70, 50, 30), lambda img, level, seed: jpeg(img, int(level))),
    "blur": Family((0.5, 1.0, 2.0), lambda img, level, seed: blur(img, level)),
    "resize": Family((0.5, 0.25), lambda img, level, seed: resize_down_up(img, level)),
    "noise": Family((0.02, 0.05, 0.1), noise),
    "color": Family((0.2,), color),
    "crop": Family((0.8,), lambda img, level, seed: crop(img, level)),
}


def under_condition(img: np.ndarray, family: str, level: float | None = None, seed: int = 0) -> np.ndarray:
    """A picture under a condition: `clean` is the picture itself, an unknown family a KeyError."""
    return img if family == "clean" else FAMILIES[family].apply(img, level, seed)


def chance(seed: int, key: str, what: str) -> float:
    """A uniform number that belongs to a row and a decision; no other decision or row matters to it."""
    return int.from_bytes(hashlib.blake2b(f"{seed}|{what}|{key}".encode(), digest_size=7).digest(), "big") / 2**56


def plan_of(seed: int, key: str, prob: float = 1.0, least: int = 1, most: int = 3) -> list[tuple[str, float]]:
    """A row's degradations, by rule from its key: none with chance 1 - prob, else least to most families, all numbers as
    likely. The families are those of the smallest chances of their own, in that order, each at a level of its own chance."""
    if chance(seed, key, "any") >= prob:
        return []
    number = least + int(chance(seed, key, "number") * (most - least + 1))
    ranked = sorted(FAMILIES, key=lambda f: chance(seed, key, f"rank {f}"))
    return [(f, FAMILIES[f].levels[int(chance(seed, key, f"level {f}") * len(FAMILIES[f].levels))]) for f in ranked[:number]]


def degraded(img: np.ndarray, seed: int, key: str, prob: float = 1.0, hflip: float = 0.5) -> np.ndarray:
    """A picture after its row's plan, then mirrored with chance hflip."""
    for family, level in plan_of(seed, key, prob):
        img = under_condition(img, family, level, int(chance(seed, key, f"seed {family}") * 2**32))
    return flip(img) if chance(seed, key, "flip") < hflip else img


def harmonized(img: np.ndarray) -> np.ndarray:
    """A training picture after the one compression that all of them get."""
    return jpeg(img, 90)


_PNG = b"\x89PNG\r\n\x1a\n"


def encode_png(img: np.ndarray, level: int = 1) -> bytes:
    """An RGB picture as PNG, rows unfiltered."""
    h, w = img.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.c_[np.zeros((h, 1), np.uint8), np.ascontiguousarray(img).reshape(h, 3 * w)].tobytes()
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGB of a PNG of 8 bits a channel (grey, RGB, palette, each with or without alpha, which is dropped), not interlaced.
    Anything else is a ValueError."""
    if data[:8] != _PNG:
        raise ValueError("no PNG")
    at, parts, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut short")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a kind of PNG that is not read here")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError) as e:
        raise ValueError("damaged") from e
    out = np.zeros((h + 1, (w + 1) * channels), np.int64)  # a row above and a pixel before, both 0
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        above, own = out[y], out[y + 1]
        if kind == 0:
            own[channels:] = line
        elif kind == 1:
            own[channels:] = np.cumsum(line.reshape(w, channels), 0).ravel() & 255
        elif kind == 2:
            own[channels:] = (line + above[channels:]) & 255
        else:
            for i in range(channels, len(own)):
                a, b, c = int(own[i - channels]), int(above[i]), int(above[i - channels])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i] = (line[i - channels] + guess) & 255
    x = out[1:, channels:].reshape(h, w, channels).astype(np.uint8)
    if head[3] == 3:
        if palette is None or x.max() >= len(palette):
            raise ValueError("no palette")
        return palette[x[..., 0]]
    return x[..., :3] if channels >= 3 else x[..., :1].repeat(3, -1)


def row_seed(seed: int, key: str) -> int:
    """A seed for a row by its key, never by its position."""
    return int.from_bytes(hashlib.md5(f"{seed}{key}".encode()).digest()[:8], "big")


def tensor(img: np.ndarray, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5)) -> np.ndarray:
    return ((img.astype(np.float32) / 255 - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1)


def content_hash(img: np.ndarray) -> str:
    """SHA-1 of the picture at 64 x 64 and of its size."""
    h, w = img.shape[:2]
    return hashlib.sha1(resize(img, 64, 64).tobytes() + f"{w}x{h}".encode()).hexdigest()


def array_of(width: int, height: int, rgb: bytes) -> np.ndarray | None:
    """The picture, or None if the bytes are not width x height x 3."""
    if rgb is None or not width or not height or width != width or height != height or len(rgb) != width * height * 3:
        return None  # nulls among integers come as NaN
    width, height = int(width), int(height)
    return np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3)


def _rows(p: pd.DataFrame):
    return (array_of(w, h, b) for w, h, b in zip(p["width"], p["height"], p["rgb"]))


def _packed(pictures) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if x is None else (x.shape[1], x.shape[0], np.ascontiguousarray(x).tobytes()) for x in pictures], columns=["width", "height", "rgb"])


def condition_udf(family: str, level: float | None = None, seed: int = 0):
    """UDF (picture, key) -> picture; a picture that cannot be read gives nulls."""

    @F.pandas_udf(PICTURE)
    def run(picture: pd.DataFrame, key: pd.Series) -> pd.DataFrame:
        return _packed(None if x is None else under_condition(x, family, level, row_seed(seed, k) & 0xFFFFFFFF) for x, k in zip(_rows(picture), key))

    return run


def degrade_udf(seed: int = 0, prob: float = 1.0, hflip: float = 0.5):
    """UDF (picture, key) -> picture under the plan of its key."""

    @F.pandas_udf(PICTURE)
    def run(picture: pd.DataFrame, key: pd.Series) -> pd.DataFrame:
        return _packed(None if x is None else degraded(x, seed, k, prob, hflip) for x, k in zip(_rows(picture), key))

    return run


def plan_udf(seed: int = 0, prob: float = 1.0):
    """UDF key -> plan text such as jpeg:30|blur:1.0."""

    @F.pandas_udf("string")
    def run(key: pd.Series) -> pd.Series:
        return key.map(lambda k: "|".join(f"{f}:{v}" for f, v in plan_of(seed, k, prob)))

    return run


@F.pandas_udf(PICTURE)
def harmonize_udf(picture: pd.DataFrame, harmonize: pd.Series) -> pd.DataFrame:
    """Pictures of rows that are to be harmonised after their compression, the others as they are."""
    return _packed(None if x is None else harmonized(x) if flag else x for x, flag in zip(_rows(picture), harmonize))


def _png_or_none(data: bytes | None) -> np.ndarray | None:
    try:
        return None if data is None else decode_png(bytes(data))
    except ValueError:
        return None


@F.pandas_udf(PICTURE)
def decode_udf(content: pd.Series) -> pd.DataFrame:
    """PNG bytes to a picture; nulls where they cannot be read."""
    return _packed(map(_png_or_none, content))


@F.pandas_udf(T.BinaryType())
def encode_udf(picture: pd.DataFrame) -> pd.Series:
    return pd.Series([None if x is None else encode_png(x) for x in _rows(picture)], dtype=object)


@F.pandas_udf(PICTURE)
def from_image_source(image: pd.DataFrame) -> pd.DataFrame:
    """Rows of Spark's image source (blue, green, red, or grey, with or without alpha) to pictures; nulls where it could not read."""
    def one(w, h, channels, data):
        if data is None or not w >= 1 or len(data) != w * h * channels:
            return None
        w, h, channels = int(w), int(h), int(channels)
        x = np.frombuffer(data, np.uint8).reshape(h, w, channels)
        return x[..., 2::-1] if channels >= 3 else x[..., :1].repeat(3, -1)

    return _packed(one(*r) for r in zip(image["width"], image["height"], image["nChannels"], image["data"]))


@F.pandas_udf(T.StringType())
def content_hash_udf(picture: pd.DataFrame) -> pd.Series:
    """SHA-1 of the small picture; null where it cannot be read."""
    return pd.Series([None if x is None else content_hash(x) for x in _rows(picture)], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def stub_features(picture: pd.DataFrame) -> pd.Series:
    """Eight numbers: channel means, deviations and two channel maxima. Stands in for a deep backbone."""
    def one(x):
        if x is None:
            return None
        flat = x.reshape(-1, 3) / 255.0
        return np.r_[flat.mean(0), flat.std(0), flat.max(0)[:2]].astype(np.float32)
    return pd.Series([one(x) for x in _rows(picture)], dtype=object)


def on_failure(df, ok, policy: str, **placeholder):
    """What happens to rows that could not be read: drop them, fail, or keep them with placeholder columns."""
    if policy == "drop":
        return df.filter(ok)
    if policy == "fail":
        return df.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("a picture could not be read")).cast("boolean")))
    if policy == "placeholder":
        return df.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(v)) for c, v in placeholder.items()})
    raise ValueError(policy)


ship(sys.modules[__name__])
