"""Perceptual hashes, pixel statistics, content hashes."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.regions import aligned as align

SIDE, SCALE = 8, 4


def hash_bits(block: Column) -> Column:
    """64-bit hash of an 8x8 coefficient block: a bit is 1 where the value is over the median of all but the first.

    The first value is the most significant bit. Null values sort last and have the bit 0.
    """
    middle = F.get(F.sort_array(F.array_compact(F.slice(block, 2, 63))), F.lit(31))  # of 63 values
    bit = lambda v, m: F.when(v > m, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    # An array of one binds the median, so that it is found once a block and not once a value.
    bound = F.transform(F.array(middle), lambda m: F.aggregate(block, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(bit(v, m))))
    return F.get(bound, F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _lanczos(size: int, out: int, a: int = 3) -> np.ndarray:
    """Weights (out x size) of a Lanczos resize, support widened when shrinking."""
    scale = max(1.0, size / out)
    at = (np.arange(out) + 0.5) * size / out
    x = (np.arange(size)[None, :] + 0.5 - at[:, None]) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0)
    return w / w.sum(axis=1, keepdims=True)


def perceptual_block(gray: np.ndarray) -> np.ndarray:
    """Low 8x8 DCT coefficients of a gray image resized to 32x32."""
    n = SIDE * SCALE
    small = _lanczos(gray.shape[0], n) @ gray.astype(np.float64) @ _lanczos(gray.shape[1], n).T
    d = _dct(n)
    return (d @ np.clip(np.round(small), 0, 255) @ d.T)[:SIDE, :SIDE]


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray image of Spark's image source rows (BGR or single channel)."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels == 1 else np.round(pixels[:, :, 0] * 0.114 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.299)


def laplacian_variance(gray: np.ndarray) -> float:
    padded = np.pad(gray, 1, mode="reflect")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * gray
    return float(lap.var())


def changed_ratio(before: np.ndarray, after: np.ndarray, least: int = 5) -> float:
    """Share of pixels that differ by more than `least`; 1 for images of different shape."""
    if before.shape != after.shape:
        return 1.0
    return float((np.abs(before - after) > least).mean()) if before.size else 0.0


def image_statistics(images: DataFrame) -> DataFrame:
    """path, blur (Laplacian variance), brightness (mean gray), block (64 coefficients) of image-source rows."""

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                gray = gray_of(r.data, r.height, r.width, r.channels)
                rows.append((r.path, laplacian_variance(gray), float(gray.mean()), perceptual_block(gray).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["path", "blur", "brightness", "block"])

    i = F.col("image")
    return images.select(
        i["origin"].alias("path"),
        i["height"].alias("height"),
        i["width"].alias("width"),
        i["nChannels"].alias("channels"),
        i["data"].alias("data"),
    ).mapInPandas(run, "path string, blur double, brightness double, block array<double>")


def image_pairs(pairs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, and data, height, width, channels of before and after (image structs) as columns of each."""
    fields = {"data": "data", "height": "height", "width": "width", "nChannels": "channels"}
    parts = [F.col(c)[f].alias(f"{c}_{n}") for c in ("before", "after") for f, n in fields.items()]
    return pairs.select(*keep, *parts)


def gray_pair(row) -> tuple[np.ndarray, np.ndarray]:
    """Both gray images of a row of image_pairs."""
    return (
        gray_of(row.before_data, row.before_height, row.before_width, row.before_channels),
        gray_of(row.after_data, row.after_height, row.after_width, row.after_channels),
    )


def change_ratios(pairs: DataFrame, aligned: bool = False) -> DataFrame:
    """sample_id, ratio for rows sample_id, before, after (image structs)."""

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                a, b = gray_pair(r)
                if aligned and a.shape == b.shape:
                    a = np.rint(align(a, b))
                rows.append((r.sample_id, changed_ratio(a, b)))
            yield pd.DataFrame(rows, columns=["sample_id", "ratio"])

    return image_pairs(pairs, "sample_id").mapInPandas(run, "sample_id string, ratio double")
def content_hash(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """One hash of a set of files: SHA-256 over the files' own SHA-256 in order of name (a variant that distributes)."""
    each = files.select(F.col(name).alias("n"), F.sha2(F.col(content), 256).alias("h"))
    return each.agg(
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: F.concat(x["n"], F.lit("="), x["h"])), "\n",
            ),
            256,
        ).alias("dataset_hash")
    )


def to_base64(content: Column) -> Column:
    return F.base64(content)


def image_bytes(rows: np.ndarray) -> bytes:
    """Plain portable pixmap of an RGB array, for tests."""
    out = io.BytesIO()
    out.write(f"P6 {rows.shape[1]} {rows.shape[0]} 255\n".encode())
    out.write(rows.astype(np.uint8).tobytes())
    return out.getvalue()
