"""Regions of changed pixels: masks, connected runs, outer shapes. All of it works on whole arrays, no pixel in a loop."""

from __future__ import annotations

import numpy as np


def spread(mask: np.ndarray, reach: int = 2) -> np.ndarray:
    """A pixel is set if any is within `reach` rows and columns of it; beyond the border there is nothing."""
    for axis in (0, 1):
        sums = np.cumsum(np.insert(mask.astype(np.int32), 0, 0, axis=axis), axis=axis)
        n = mask.shape[axis]
        low, high = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
        mask = np.take(sums, high, axis=axis) > np.take(sums, low, axis=axis)
    return mask


def closed(mask: np.ndarray, reach: int = 2) -> np.ndarray:
    """Gaps of up to twice `reach` pixels filled: spread, and taken back from what isn't set."""
    return ~spread(~spread(mask, reach), reach)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of set pixels, line by line."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray, corners: bool) -> np.ndarray:
    """The number of the component of each run: runs of neighbouring lines that touch (corners: by a corner, too) belong
    together. A component's number is that of its first run."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    reach = 1 if corners else 0
    wide = int(end.max()) + 2
    # runs of the line before that end after a run's start, up to those that start after its end
    first = np.searchsorted(row * wide + end, (row - 1) * wide + start + 1 - reach)
    last = np.searchsorted(row * wide + start, (row - 1) * wide + end + reach)
    many = np.maximum(last - first, 0)
    one = np.repeat(np.arange(n), many)
    two = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    root = np.arange(n)
    while True:
        a, b = root[one], root[two]
        open_ = a != b
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (root[root] != root).any():
            root = root[root]


def outer_shapes(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes filled: what can't be reached from beyond the border without crossing a corner."""
    around = np.pad(~mask, 1, constant_values=True)
    row, start, end = runs(around)
    outside = joined(row, start, end, corners=False) == 0  # the first run is the line above the image
    filled = np.ones_like(around)
    edges = np.zeros((around.shape[0], around.shape[1] + 1), np.int32)
    np.add.at(edges, (row[outside], start[outside]), 1)
    np.add.at(edges, (row[outside], end[outside]), -1)
    filled &= np.cumsum(edges, axis=1)[:, :-1] == 0
    return filled[1:-1, 1:-1]


def boxes(mask: np.ndarray) -> np.ndarray:
    """Rows x, y, width, height, area of the outer shapes of a mask in order of their first pixel.

    The area is that of the polygon through the centres of a shape's border pixels: a whole square for each four pixels
    of it that meet, half of one for each three.
    """
    filled = outer_shapes(mask)
    row, start, end = runs(filled)
    if not len(row):
        return np.zeros((0, 5))
    root = joined(row, start, end, corners=True)
    first, shape = np.unique(root, return_inverse=True)
    n = len(first)
    low = np.full((2, n), np.iinfo(np.int64).max)
    high = np.zeros((2, n), np.int64)
    for k, (a, b) in enumerate(((start, end), (row, row + 1))):
        np.minimum.at(low[k], shape, a)
        np.maximum.at(high[k], shape, b)
    label = np.zeros(filled.shape, np.int64)
    label[filled] = np.repeat(shape, end - start)
    corners = np.stack([filled[:-1, :-1], filled[:-1, 1:], filled[1:, :-1], filled[1:, 1:]])
    owner = np.max(np.where(corners, np.stack([label[:-1, :-1], label[:-1, 1:], label[1:, :-1], label[1:, 1:]]), 0), axis=0)
    part = np.array([0, 0, 0, 0.5, 1.0])[corners.sum(axis=0)]
    area = np.bincount(owner.ravel(), weights=part.ravel(), minlength=n)
    return np.column_stack([low[0], low[1], high[0] - low[0], high[1] - low[1], area]).astype(float)


def shift_between(before: np.ndarray, after: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which `before` moved to become `after`: phase correlation, the peak to parts of a pixel by the weight of
    the five by five round it."""
    spectrum = np.fft.fft2(after) * np.conj(np.fft.fft2(before))
    answer = np.fft.fftshift(np.fft.ifft2(spectrum / np.maximum(np.abs(spectrum), 1e-12)).real)
    y, x = np.unravel_index(np.argmax(answer), answer.shape)
    rows, columns = (np.arange(max(c - 2, 0), min(c + 3, n)) for c, n in zip((y, x), answer.shape, strict=True))
    weight = answer[np.ix_(rows, columns)]
    total = weight.sum()
    if total <= 0:
        return float(x - answer.shape[1] // 2), float(y - answer.shape[0] // 2)
    return (
        float((weight.sum(axis=0) * columns).sum() / total - answer.shape[1] // 2),
        float((weight.sum(axis=1) * rows).sum() / total - answer.shape[0] // 2),
    )


def shifted(image: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """The image moved by parts of pixels, linear between them, mirrored at its borders."""
    for axis, move in ((1, dx), (0, dy)):
        n = image.shape[axis]
        at = np.arange(n) - move
        low = np.floor(at).astype(int)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        mirror = lambda i: np.where((m := np.mod(i, 2 * n)) < n, m, 2 * n - 1 - m)
        image = np.take(image, mirror(low), axis=axis) * (1 - share) + np.take(image, mirror(low + 1), axis=axis) * share
    return image


def aligned(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """`before` moved onto `after`."""
    return shifted(before, *shift_between(before, after))


def changed_boxes(
    before: np.ndarray, after: np.ndarray, threshold: float = 0.02, least_area: float = 100.0, align: bool = False,
) -> list[tuple[float, float, float, float, float]]:
    """(x1, y1, x2, y2, confidence) of the regions that differ between two gray images, the largest boxes first.

    A pixel differs by more than threshold of the range of values, 1 at least; gaps of up to four pixels are closed. Only
    shapes of least_area or more count; confidence is a hundredfold share of the image. Images of different size: none.
    """
    if before.shape != after.shape or not before.size:
        return []
    if align:
        before = np.rint(aligned(before, after))
    found = boxes(closed(np.abs(before - after) > max(int(threshold * 255), 1)))
    found = found[found[:, 4] >= least_area]
    order = np.argsort(-found[:, 2] * found[:, 3], kind="stable")
    return [(x, y, x + w, y + h, min(1.0, a / before.size * 100)) for x, y, w, h, a in found[order].tolist()]


def changed_near(
    before: np.ndarray, after: np.ndarray, x: float, y: float, radius: int = 180, threshold: float = 0.02, least_area: float = 40.0, align: bool = True,
) -> list[tuple[float, float, float, float, float]]:
    """changed_boxes within `radius` pixels of a point, in coordinates of the whole image."""
    height, width = before.shape
    left, top = max(int(x) - radius, 0), max(int(y) - radius, 0)
    right, bottom = min(int(x) + radius, width), min(int(y) + radius, height)
    if right <= left or bottom <= top or before.shape != after.shape:
        return []
    own = changed_boxes(before[top:bottom, left:right], after[top:bottom, left:right], threshold, least_area, align)
    return [(x1 + left, y1 + top, x2 + left, y2 + top, c) for x1, y1, x2, y2, c in own]
