"""Image kernels on NumPy arrays, and how they run over a table of images.

Images are rows of Spark's image source; their bytes are blue, green, red by
pixel. A kernel gets one page or crop at a time, in tasks that hold a few.
Results come near those of the usual image libraries but not to the bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schema import LONG_TEXT_FIELDS, RATE_FIELDS, is_number

# Contrast limit and tiles, denoising strength and windows, thresholds' windows and offsets.
CLIP, TILES, STRENGTH, PATCH, SEARCH, PAGE_WINDOW, PAGE_OFFSET, CELL_WINDOW, CELL_OFFSET = 2.2, 8, 12.0, 7, 21, 31, 15, 25, 11
#: Pixels that a kernel works on at once, of many small images or of one of any size.
STACK = 1 << 18


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    image = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return image[:, :, 0] if channels == 1 else image[:, :, :3]


def crop(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """[GEO4]"""
    return image[y : y + height, x : x + width]


def gray(image: np.ndarray) -> np.ndarray:
    """[IMG1]"""
    if image.ndim == 2:
        return image
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def three_channels(image: np.ndarray) -> np.ndarray:
    """[IMG15]"""
    return np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image


def deskewed(image: np.ndarray) -> np.ndarray:
    """Pages come upright; the step stands for those that don't. [IMG4]"""
    return image


def equalized(image: np.ndarray) -> np.ndarray:
    """Contrast-limited histogram equalisation by tiles, interpolated between them. [IMG2]"""
    h, w = image.shape
    if not image.size:
        return image
    th, tw = -(-h // TILES), -(-w // TILES)
    full = np.pad(image, ((0, th * TILES - h), (0, tw * TILES - w)), mode="reflect" if min(h, w) > max(th * TILES - h, tw * TILES - w) else "edge")
    tiles = full.reshape(TILES, th, TILES, tw).transpose(0, 2, 1, 3).reshape(TILES * TILES, -1)
    limit = max(1, int(CLIP * tiles.shape[1] / 256))
    maps = np.empty((TILES * TILES, 256))
    for i, tile in enumerate(tiles):
        counts = np.bincount(tile, minlength=256)
        excess = int(np.maximum(counts - limit, 0).sum())
        counts = np.minimum(counts, limit) + excess // 256
        counts[: excess % 256] += 1
        maps[i] = np.cumsum(counts) * 255.0 / tiles.shape[1]
    maps = np.clip(np.rint(maps), 0, 255).reshape(TILES, TILES, 256)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, TILES - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, TILES - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, TILES - 1), np.minimum(x0 + 1, TILES - 1), (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], image]
    mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.rint(mixed).astype(np.uint8)


def _window_sums(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums over every window of ``size`` along an axis, by sums over windows of half the size."""
    cut = lambda b, start, end: b[(*[slice(None)] * axis, slice(start, end))]
    n, out, at, sums, width = a.shape[axis] - size + 1, 0, 0, a, 1
    while width <= size:
        if size & width:
            out, at = out + cut(sums, at, at + n), at + width
        sums, width = cut(sums, 0, -width) + cut(sums, width, None), 2 * width
    return out


def denoised(image: np.ndarray) -> np.ndarray:
    """Means of similar patches nearby, by one row of shifts at a time. [IMG3]"""
    if not image.size:
        return image
    (h, w), r, p = image.shape, SEARCH // 2, PATCH // 2
    rows, columns = (np.clip(np.arange(-p, n + p), 0, n - 1) for n in (h, w))
    padded = np.pad(image.astype(np.int32), r, mode="edge")
    patches = image[np.ix_(rows, columns)].astype(np.int32)
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    step = max(1, STACK // image.size)
    for dy in range(SEARCH):
        # one row more or less of shifts across, each as an image of its own
        moved = np.lib.stride_tricks.sliding_window_view(padded[dy : dy + h], w, axis=1).transpose(1, 0, 2)
        for at in range(0, SEARCH, step):
            some = moved[at : at + step]
            gaps = patches - some[:, rows][:, :, columns]
            sums = _window_sums(_window_sums(gaps * gaps, PATCH, 1), PATCH, 2)  # whole numbers, so exact
            likeness = np.exp(-(sums / PATCH**2) / STRENGTH**2)
            total += (likeness * some).sum(0)
            weight += likeness.sum(0)
    return np.rint(total / weight).astype(np.uint8)


def _gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _filtered(image: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    r, (h, w) = len(kernel) // 2, image.shape[-2:]
    a = np.pad(image.astype(np.float64), [(0, 0)] * (image.ndim - 2) + [(r, r)] * 2, mode=mode if min(h, w) > r else "edge")
    a = sum(k * a[..., i : i + h, :] for i, k in enumerate(kernel))
    return sum(k * a[..., i : i + w] for i, k in enumerate(kernel))


def blurred(image: np.ndarray) -> np.ndarray:
    """[IMG12]"""
    return np.rint(_filtered(image, np.array([0.25, 0.5, 0.25]), "reflect")).astype(np.uint8)


def ink(image: np.ndarray, window: int = PAGE_WINDOW, offset: int = PAGE_OFFSET) -> np.ndarray:
    """White where a pixel is darker than its surroundings by more than the offset. [IMG5]"""
    mean = _filtered(image, _gaussian(window, 0.3 * ((window - 1) * 0.5 - 1) + 0.8), "edge")
    return np.where(image > np.rint(mean) - offset, 0, 255).astype(np.uint8)


def page_images(image: np.ndarray, denoise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A page's gray and ink images. [IMG6]"""
    g = equalized(deskewed(gray(image)))
    g = denoised(g) if denoise else g
    return g, ink(g)


def trimmed(image: np.ndarray) -> np.ndarray:
    """A cell without its border, unless it is too small. [IMG7]"""
    if not image.size:
        return image
    h, w = image.shape[:2]
    y, x = max(1, int(h * 0.08)), max(1, int(w * 0.04))
    return image if h <= 2 * y or w <= 2 * x else image[y : h - y, x : w - x]


def otsu_threshold(image: np.ndarray) -> int:
    """The gray level that parts two classes best."""
    counts = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def otsu(image: np.ndarray) -> np.ndarray:
    """[IMG8]"""
    return np.where(image > otsu_threshold(image), 255, 0).astype(np.uint8) if image.size else image


def adaptive(image: np.ndarray) -> np.ndarray:
    """[IMG9]"""
    return 255 - ink(image, CELL_WINDOW, CELL_OFFSET)


def _slid(image: np.ndarray, size: int, axis: int, least: bool) -> np.ndarray:
    a = np.moveaxis(image, axis, -1)
    before, n, taken = size // 2, a.shape[-1], np.minimum if least else np.maximum
    a, width = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(before, size - 1 - before)], constant_values=255 if least else 0), 1
    while 2 * width <= size:
        a, width = taken(a[..., :-width], a[..., width:]), 2 * width
    return np.moveaxis(taken(a[..., :n], a[..., size - width : size - width + n]), -1, axis)


def opened(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Only what runs for ``size`` pixels along an axis. [WIN10]"""
    if not image.size:
        return image
    low = _slid(image, size, axis, True)
    return np.flip(_slid(np.flip(low, axis), size, axis, False), axis)


def without_rules(image: np.ndarray) -> np.ndarray:
    """Black text on white without long rules. [IMG10]"""
    if not image.size:
        return image
    dark = 255 - image
    rules = np.maximum(opened(dark, max(10, image.shape[0] // 2), 0), opened(dark, max(10, image.shape[1] // 2), 1))
    return 255 - np.where(dark > rules, dark - rules, 0).astype(np.uint8)


def _runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The image, the length and the area of each run of set pixels in the rows of a stack; an area is named by its first run."""
    n, h, w = masks.shape
    line = np.zeros((n * h, w + 1), dtype=np.int8)  # an unset pixel ends every row
    line[:, :w] = masks.reshape(n * h, w) > 0
    edges = np.flatnonzero(np.diff(line.ravel(), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    row = starts // (w + 1)
    low, high = np.searchsorted(ends, starts - (w + 1), "left"), np.searchsorted(starts, ends - (w + 1), "right")
    near = np.where(row % h > 0, np.maximum(high - low, 0), 0)
    below = np.repeat(np.arange(len(starts)), near)
    above = np.arange(len(below)) + np.repeat(low - (np.cumsum(near) - near), near)
    area = np.arange(len(starts))
    while True:
        a, b = area[below], area[above]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(area, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (area != area[area]).any():
            area = area[area]
    return row // h, ends - starts, area


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of eight-connected areas, 0 where there is none, by union of runs."""
    labels = np.zeros(mask.shape, dtype=np.int64)
    _, lengths, areas = _runs(mask[None])
    labels[mask > 0] = np.repeat(areas + 1, lengths)
    return labels


def distances(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance of each set pixel to the nearest unset one; pixels beyond the image count as set."""
    h, w = mask.shape[-2:]
    d = np.where(mask > 0, float(h + w + 1), 0.0)
    x = np.arange(w) * 0.955
    for step in (1, -1):
        for y in range(h)[::step]:
            row = d[..., y, :]
            if 0 <= y - step < h:
                up = d[..., y - step, :]
                row = np.minimum(row, up + 0.955)
                row[..., 1:] = np.minimum(row[..., 1:], up[..., :-1] + 1.3693)
                row[..., :-1] = np.minimum(row[..., :-1], up[..., 1:] + 1.3693)
            ahead, back = np.minimum.accumulate(row - x, axis=-1), np.minimum.accumulate((row + x)[..., ::-1], axis=-1)
            d[..., y, :] = np.minimum(ahead + x, back[..., ::-1] - x)
    return d


def cell_features(binary: np.ndarray) -> dict:
    """How much ink a cell holds and whether it looks blank. [IMG13, PRD11]"""
    return stack_features(binary[None])[0]


def stack_features(binaries: np.ndarray) -> list[dict]:
    """``cell_features`` of each image of a stack."""
    out, masks = [], (binaries > 0).astype(np.uint8)
    size = masks[0].size
    density = masks.sum((1, 2)) / size if size else np.zeros(len(masks))
    if density.any():
        image, length, area = _runs(masks)
        sizes = np.bincount(area, length, minlength=len(area)).astype(np.int64)
        firsts = np.flatnonzero(sizes >= max(4, int(size * 0.00015)))
        counts, largest = np.bincount(image[firsts], minlength=len(masks)), np.zeros(len(masks), dtype=np.int64)
        np.maximum.at(largest, image[firsts], sizes[firsts])
        far = distances(masks)
    for k, dense in enumerate(density.tolist()):
        count, stroke, most = 0, 0.0, 0.0
        if dense:
            count, most = int(counts[k]), float(largest[k] / size)
            stroke = float(far[k][far[k] > 0].mean() * 2)
        blank = not size or (dense < 0.0015 and count <= 2 and most < 0.0015) or (dense < 0.004 and count <= 4 and stroke < 1.25 and most < 0.0035)
        out.append({"ink_density": dense, "component_count": count, "avg_stroke_width": stroke, "max_component_ratio": most, "likely_blank": bool(blank)})
    return out


def cell_variants(image: np.ndarray, field: str) -> list[tuple[str, np.ndarray]]:
    """The forms in which a cell is read, by its field. [IMG11]"""
    base = trimmed(image)
    if not base.size:
        return [("raw", image)]
    contrast = equalized(base)
    if is_number(field):
        return [("numeric_binary", without_rules(otsu(blurred(contrast)))), ("numeric_adaptive", without_rules(adaptive(contrast))), ("numeric_gray", contrast)]
    if field in RATE_FIELDS:
        return [("rate_gray", denoised(contrast)), ("rate_binary", otsu(contrast))]
    if field in LONG_TEXT_FIELDS:
        soft = denoised(contrast)
        return [("text_gray", soft), ("text_binary", without_rules(otsu(soft))), ("text_adaptive", without_rules(adaptive(contrast)))]
    return [("default_binary", without_rules(otsu(contrast))), ("default_gray", contrast)]


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    """Cubic enlargement."""

    def along(a: np.ndarray, axis: int) -> np.ndarray:
        n = a.shape[axis]
        at = (np.arange(round(n * factor)) + 0.5) / factor - 0.5
        base = np.floor(at).astype(int)
        f, out = at - base, 0.0
        for k in range(-1, 3):
            t = np.abs(f - k)
            w = np.where(t <= 1, 1.25 * t**3 - 2.25 * t**2 + 1, np.where(t < 2, -0.75 * t**3 + 3.75 * t**2 - 6 * t + 3, 0))
            out = out + np.take(a, np.clip(base + k, 0, n - 1), axis) * (w[:, None] if axis == 0 else w[None, :])
        return out

    return np.clip(np.rint(along(along(image.astype(np.float64), 0), 1)), 0, 255).astype(np.uint8)


def prepared(image: np.ndarray, factor: float = 2.2) -> np.ndarray:
    """A crop with a white margin, enlarged, as engines get it. [IMG14]"""
    return resized(np.pad(gray(image), 8, constant_values=255), factor)


def number_strip(image: np.ndarray) -> np.ndarray:
    """A strip of row numbers as engines get it. [IMG21]"""
    return prepared(otsu(equalized(image)), 2.0)


def _ruled(binary: np.ndarray, v: int, h: int) -> np.ndarray:
    return np.maximum(opened(binary, v, 0), opened(binary, h, 1))


def _inner(binary: np.ndarray) -> tuple[np.ndarray, int, int]:
    h, w = binary.shape
    y, x = int(h * 0.05), int(w * 0.05)
    return binary[y : h - y, x : w - x], y, x


def table_box(binary: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, width, height of the largest ruled area of a page, a fiftieth of it at least; None without one. [IMG17, TOP7]"""
    inner, dy, dx = _inner(binary)
    labels = components(_ruled(inner, max(20, inner.shape[0] // 30), max(20, inner.shape[1] // 20)) > 0)
    found = []
    for k in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == k)
        x, y, w, h = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        if w * h >= inner.size * 0.02:
            found.append((w * h, x, y, w, h))
    if not found:
        return None
    _, x, y, w, h = max(found)
    return x + dx, y + dy, w, h


def import_table_box(binary: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, width, height around all rules of a page, with a margin; else ``table_box``. [IMG18]"""
    height, width = binary.shape
    inner, dy, dx = _inner(binary)
    rules = _ruled(inner, max(25, inner.shape[0] // 18), max(25, inner.shape[1] // 20))
    if not rules.any():
        return table_box(binary)
    rules = _slid(_slid(rules, max(15, inner.shape[0] // 40), 0, False), max(15, inner.shape[1] // 40), 1, False)
    ys, xs = np.nonzero(rules)
    x, y = max(0, int(xs.min()) + dx - 12), max(0, int(ys.min()) + dy - 12)
    return x, y, min(width, int(np.ptp(xs)) + 25), min(height, int(np.ptp(ys)) + 25)


def rule_profile(binary: np.ndarray, axis: str) -> np.ndarray:
    """How many pixels of vertical rules each column has, or of horizontal rules each row; of an image or a stack. [IMG19, IMG20, AGG11]"""
    h, w = binary.shape[-2:]
    if axis == "x":
        return opened(binary, max(15, h // 12), -2).sum(-2) / 255.0
    return opened(binary, max(25, w // 18), -1).sum(-1) / 255.0


def in_batches(rows: Iterable[tuple], columns: list[str], size: int = 1000) -> Iterator[pd.DataFrame]:
    """Rows in frames of ``size``, the last one smaller."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def over_images(images: DataFrame, kernel: Callable[[np.ndarray], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``kernel`` makes of each image, with the image's origin. ``images`` has the image source's column image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            made = ((row.origin, *(r[n] for n in names)) for row in batch.itertuples(index=False) for r in kernel(decoded(row.height, row.width, row.nChannels, row.data)))
            yield from in_batches(made, ["origin", *names])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, f"origin string, {schema}")


def over_stacks(images: DataFrame, kernel: Callable[[np.ndarray], Iterable[Iterable[dict]]], schema: str) -> DataFrame:
    """As ``over_images``, for a kernel that takes a stack of gray images of one shape and gives the rows of each."""
    names = [part.split()[0] for part in schema.split(", ")]

    def made(rows: Iterable) -> Iterator[tuple]:
        held: list[tuple[str, np.ndarray]] = []

        def done() -> Iterator[tuple]:
            if held:
                for (origin, _), found in zip(held, kernel(np.stack([g for _, g in held])), strict=True):
                    yield from ((origin, *(r[n] for n in names)) for r in found)

        for row in rows:
            g = gray(decoded(row.height, row.width, row.nChannels, row.data))
            if held and (held[0][1].shape != g.shape or (len(held) + 1) * g.size > STACK):
                yield from done()
                held = []
            held.append((row.origin, g))
        yield from done()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from in_batches(made(batch.itertuples(index=False)), ["origin", *names])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, f"origin string, {schema}")


_FEATURES = "ink_density double, component_count int, avg_stroke_width double, max_component_ratio double, likely_blank boolean"


def image_features(images: DataFrame) -> DataFrame:
    """``cell_features`` of each image's ink. [IMG13]"""
    return over_stacks(images, lambda stack: [[f] for f in stack_features(ink(stack))], _FEATURES)


def image_profiles(images: DataFrame) -> DataFrame:
    """Rule profiles of each image's ink in long form: axis, position, value. [F12]"""

    def rows(stack: np.ndarray) -> Iterator[list[dict]]:
        binary = ink(stack)
        x, y = rule_profile(binary, "x").tolist(), rule_profile(binary, "y").tolist()
        for both in zip(x, y, strict=True):
            yield [{"axis": axis, "position": i, "value": v} for axis, values in zip("xy", both, strict=True) for i, v in enumerate(values)]

    return over_stacks(images, rows, "axis string, position int, value double")


def image_features_and_peaks(images: DataFrame) -> DataFrame:
    """``image_features`` with the greatest values of either rule profile, x and y, in one pass. [IMG13, IMG19, IMG20]"""

    def rows(stack: np.ndarray) -> Iterator[list[dict]]:
        binary = ink(stack)
        peaks = (rule_profile(binary, axis).max(-1, initial=0.0).tolist() for axis in "xy")
        for features, x, y in zip(stack_features(binary), *peaks, strict=True):
            yield [features | {"x": x, "y": y}]

    return over_stacks(images, rows, f"{_FEATURES}, x double, y double")
