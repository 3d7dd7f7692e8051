"""Image features with numpy over the pixels of Spark's image source, an Arrow batch at a time.

An extractor takes a height x width x channels array of blue, green, red (or one grey channel) and returns a list of
vectors; undecodable files have no rows. ``EXTRACTORS`` names them; a comma list concatenates its members in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.scalars import basename

Extractor = Callable[[np.ndarray], list[np.ndarray]]
EPS = 1e-12


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(key, height, width, channels, data); files that are no images are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(basename(F.col("image.origin")).alias("key"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def register(name: str, extractor: Extractor) -> None:
    """Makes an extractor known to ``extract``; a name is given once."""
    if name in EXTRACTORS or "," in name or name != name.strip():
        raise ValueError(f"not a new name: {name}")
    EXTRACTORS[name] = extractor


def extract(images: DataFrame, names: str) -> DataFrame:
    """(key, vec_idx, vector): one row a vector."""
    from folioscope.operators import keypoints  # noqa: F401  it adds its extractors to the table

    chosen = [EXTRACTORS[n.strip()] for n in names.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., :3]
                found = [f(image) for f in chosen]
                vectors = found[0] if len(found) == 1 else [np.concatenate([x for v in found for x in v])] if all(found) else []
                rows += [(r.key, i, np.asarray(v, float).tolist()) for i, v in enumerate(vectors)]
            yield pd.DataFrame(rows, columns=["key", "vec_idx", "vector"])

    return images.select("key", "height", "width", "channels", "data").mapInPandas(run, "key string, vec_idx int, vector array<double>")


def grey(image: np.ndarray) -> np.ndarray:
    x = image.astype(float)
    return x[..., 0] if x.shape[2] == 1 else 0.114 * x[..., 0] + 0.587 * x[..., 1] + 0.299 * x[..., 2]


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees over 2, saturation and value 0..255."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    span = v - np.minimum(np.minimum(r, g), b)
    safe = np.where(span > 0, span, 1)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.where(span > 0, h % 180, 0), np.where(v > 0, 255 * span / np.where(v > 0, v, 1), 0), v


def hsv_histogram(h_bins: int = 10, s_bins: int = 10, v_bins: int = 1) -> Extractor:
    """Bins of equal width over the largest bin; value outermost, saturation innermost. An empty histogram stays 0."""

    def run(image: np.ndarray) -> list[np.ndarray]:
        h, s, v = hsv(np.repeat(image, 3, 2) if image.shape[2] == 1 else image)
        cut = lambda x, top, n: np.minimum((x * n / top).astype(int), n - 1)
        place = (cut(v, 256, v_bins) * h_bins + cut(h, 180, h_bins)) * s_bins + cut(s, 256, s_bins)
        n = np.bincount(place.ravel(), minlength=h_bins * s_bins * v_bins).astype(float)
        return [n / n.max() if n.max() > 0 else n]

    return run


def histogram_names(h_bins: int = 10, s_bins: int = 10, v_bins: int = 1) -> list[str]:
    return [f"hist_{h}_{s}_{v}" for v in range(v_bins) for h in range(h_bins) for s in range(s_bins)]


def mean_intensity(image: np.ndarray) -> list[np.ndarray]:
    """The mean over all channels, and whether it is over 200."""
    m = float(image.mean()) if image.size else 0.0
    return [np.array([m, float(m > 200)])]


def _box(x: np.ndarray, r: int, reduce: Callable) -> np.ndarray:
    """A reduction over the square of radius r around each pixel, edges repeated; rows, then columns."""
    pad = np.pad(x, r, mode="edge")
    rows = reduce([pad[i : i + x.shape[0]] for i in range(2 * r + 1)])
    return reduce([rows[:, i : i + x.shape[1]] for i in range(2 * r + 1)])


def skin_ratio(image: np.ndarray) -> list[np.ndarray]:
    """The share of pixels of skin colour, cleaned by an erosion and seven dilations; 0 without colour."""
    if image.shape[2] != 3 or not image.size:
        return [np.zeros(1)]
    smooth = np.stack([_box(image[..., i].astype(float), 1, lambda xs: sum(xs) / len(xs)) for i in range(3)], 2)
    b, g, r = (smooth[..., i] for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cr, cb = (r - y) * 0.713 + 128, (b - y) * 0.564 + 128
    third = cb + 0.6 * cr
    mask = (cr > 138) & (cr < 178) & (third > 200) & (third < 215)
    mask = _box(mask, 1, np.logical_and.reduce)
    for _ in range(7):
        mask = _box(mask, 1, np.logical_or.reduce)
    return [np.array([mask.mean()])]


def line_score(lines: list[tuple[int, int, int, int]], height: int, width: int) -> tuple[float, float]:
    """(share of good lines, both directions there): good lines are level or upright within 5 pixels, long, and off the margin."""
    level = upright = 0
    for x1, y1, x2, y2 in lines:
        inside = min(x1, x2) > 5 and min(y1, y2) > 5 and max(x1, x2) < width - 5 and max(y1, y2) < height - 5
        level += inside and abs(y1 - y2) < 5 and abs(x1 - x2) > width / 3
        upright += inside and abs(x1 - x2) < 5 and abs(y1 - y2) > height / 3
    return ((level + upright) / len(lines) if lines else 0.0), float(level > 0 and upright > 0)


def edges(x: np.ndarray, threshold: float = 60.0) -> tuple[np.ndarray, np.ndarray]:
    """(edge mask, angle): central differences, thinned across the direction of the gradient."""
    gy, gx = np.gradient(x)
    size, angle = np.hypot(gx, gy), np.arctan2(gy, gx)
    pad = np.pad(size, 1)
    turn = np.round(angle / (math.pi / 4)).astype(int) % 4
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    h, w = x.shape
    keep = np.zeros_like(size, bool)
    for k, (dy, dx) in enumerate(steps):
        a, b = pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], pad[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        keep |= (turn == k) & (size >= a) & (size > b)
    return keep & (size > threshold), angle


def runs(mask: np.ndarray, least: int, gap: int = 3) -> list[tuple[int, int, int, int]]:
    """Level segments of a mask (x1, y, x2, y): what a Hough transform finds at right angles, with small gaps bridged."""
    out = []
    for y in range(mask.shape[0]):
        xs = np.flatnonzero(mask[y])
        if len(xs):
            breaks = np.flatnonzero(np.diff(xs) > gap)
            for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(xs) - 1]])):
                if xs[b] - xs[a] >= least:
                    out.append((int(xs[a]), y, int(xs[b]), y))
    return out


def lines(image: np.ndarray) -> list[np.ndarray]:
    """Share of good lines and whether both directions occur; dark images have none."""
    x = grey(image)
    if not x.size or x.mean() < 200:
        return [np.zeros(2)]
    mask, _ = edges(x, 10.0)
    level = runs(mask, 30)
    upright = [(y1, x1, y2, x2) for x1, y1, x2, y2 in runs(mask.T, 30)]
    return [np.array(line_score(level + upright, *x.shape))]


def entropy_ratio(image: np.ndarray, radius: int = 4, bins: int = 32) -> list[np.ndarray]:
    """The mean over pixels of the local entropy of hue over that of value; undefined pixels don't count; 0 without colour."""
    if image.shape[2] != 3 or not image.size:
        return [np.zeros(1)]
    h, _, v = hsv(image)

    def local(x: np.ndarray, top: float) -> np.ndarray:
        level = np.minimum((x * bins / top).astype(int), bins - 1)
        share = [_box((level == k).astype(float), radius, lambda xs: sum(xs) / len(xs)) for k in range(bins)]
        return -sum(np.where(p > EPS, p * np.log2(np.maximum(p, EPS)), 0) for p in share)

    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = local(h, 180) / local(v, 256)
    ratio[np.isinf(ratio)] = 0
    return [np.array([np.nanmean(ratio) if (~np.isnan(ratio)).any() else 0.0])]


def dense_sift(image: np.ndarray, step: int = 10, cell: int = 3) -> list[np.ndarray]:
    """128 values a point of a grid: 4 x 4 cells of 8 directions of the gradient, normed, cut at 0.2 and normed again."""
    x = grey(image) / 255
    h, w = x.shape
    if min(h, w) < 4 * cell:
        return []
    gy, gx = np.gradient(x)
    size, angle = np.hypot(gx, gy), (np.arctan2(gy, gx) % (2 * math.pi)) / (2 * math.pi) * 8
    low = np.floor(angle).astype(int) % 8
    part = angle - np.floor(angle)
    planes = np.zeros((8, h + 1, w + 1))
    for k in range(8):
        plane = size * (np.where(low == k, 1 - part, 0) + np.where((low + 1) % 8 == k, part, 0))
        planes[k, 1:, 1:] = plane.cumsum(0).cumsum(1)  # sums of rectangles from their corners
    out = []
    for y in range(0, h - 4 * cell + 1, step):
        for x0 in range(0, w - 4 * cell + 1, step):
            v = np.array([
                planes[:, y + (i + 1) * cell, x0 + (j + 1) * cell] - planes[:, y + i * cell, x0 + (j + 1) * cell] - planes[:, y + (i + 1) * cell, x0 + j * cell] + planes[:, y + i * cell, x0 + j * cell]
                for i in range(4) for j in range(4)
            ]).ravel()
            out.append(norm_descriptor(v))
    return out


def norm_descriptor(v: np.ndarray, cut: float = 0.2) -> np.ndarray:
    v = v / max(float(np.linalg.norm(v)), EPS)
    v = np.minimum(v, cut)
    return v / max(float(np.linalg.norm(v)), EPS)


def edge_histogram(image: np.ndarray, threshold: float = 11.0) -> list[np.ndarray]:
    """80 values: in each of 4 x 4 parts, the share of 2 x 2 blocks whose edge is upright, level, of either diagonal, or without direction."""
    x = grey(image)
    h, w = x.shape[0] // 8 * 8, x.shape[1] // 8 * 8
    if not h or not w:
        return [np.zeros(80)]
    x = x[:h, :w]
    a, b, c, d = x[::2, ::2], x[::2, 1::2], x[1::2, ::2], x[1::2, 1::2]
    root = math.sqrt(2)
    kinds = np.abs(np.stack([a - b + c - d, a + b - c - d, root * (a - d), root * (b - c), 2 * (a - b - c + d)]))
    best = np.where(kinds.max(0) >= threshold, kinds.argmax(0), -1)
    ph, pw = best.shape[0] // 4, best.shape[1] // 4
    return [np.array([(best[i * ph : (i + 1) * ph, j * pw : (j + 1) * pw] == k).mean() for i in range(4) for j in range(4) for k in range(5)])]


def tamura(image: np.ndarray) -> list[np.ndarray]:
    """18 values: coarseness, contrast, and a histogram of 16 directions."""
    x = grey(image)
    if min(x.shape) < 4:
        return [np.zeros(18)]
    best, size = np.full(x.shape, -1.0), np.ones(x.shape)
    for k in range(1, 5):
        r = 2 ** (k - 1)
        if 4 * r >= min(x.shape):
            break
        mean = _box(x, r, lambda xs: sum(xs) / len(xs))
        diff = np.maximum(np.abs(np.roll(mean, -r, 1) - np.roll(mean, r, 1)), np.abs(np.roll(mean, -r, 0) - np.roll(mean, r, 0)))
        size = np.where(diff > best, 2.0**k, size)
        best = np.maximum(best, diff)
    var = x.var()
    kurtosis = ((x - x.mean()) ** 4).mean() / max(var**2, EPS)
    contrast = math.sqrt(var) / max(kurtosis, EPS) ** 0.25 if var > EPS else 0.0
    gy, gx = np.gradient(x)
    strong = np.hypot(gx, gy) > 12
    turn = np.arctan2(gy, gx)[strong] % math.pi
    n = np.histogram(turn, bins=16, range=(0, math.pi))[0].astype(float)
    return [np.concatenate([[size.mean(), contrast], n / max(n.sum(), 1)])]


def autocorrelogram(image: np.ndarray, colours: int = 4, distances: tuple[int, ...] = (1, 3, 5, 7)) -> list[np.ndarray]:
    """For each colour and distance, how likely a pixel at that distance, along rows and columns, has the same colour."""
    x = (np.repeat(image, 3, 2) if image.shape[2] == 1 else image).astype(int) * colours // 256
    code = (x[..., 2] * colours + x[..., 1]) * colours + x[..., 0]
    out = []
    for d in distances:
        same, seen = np.zeros(colours**3), np.zeros(colours**3)
        for p, q in ((code[d:], code[:-d]), (code[:, d:], code[:, :-d])):
            for one, other in ((p, q), (q, p)):
                seen += np.bincount(one.ravel(), minlength=colours**3)
                same += np.bincount(one[one == other].ravel(), minlength=colours**3)
        out.append(same / np.maximum(seen, 1))
    return [np.stack(out, 1).ravel()]


def gabor(image: np.ndarray, scales: int = 3, turns: int = 4) -> list[np.ndarray]:
    """Mean and deviation of the answer of each filter of a bank, by products of spectra."""
    x = grey(image)
    fy, fx = np.meshgrid(np.fft.fftfreq(x.shape[0]), np.fft.fftfreq(x.shape[1]), indexing="ij")
    spectrum = np.fft.fft2(x)
    out = []
    for s in range(scales):
        f = 0.25 / 2**s
        for t in range(turns):
            u, v = f * math.cos(math.pi * t / turns), f * math.sin(math.pi * t / turns)
            answer = np.abs(np.fft.ifft2(spectrum * np.exp(-((fx - u) ** 2 + (fy - v) ** 2) / (2 * (f / 3) ** 2))))
            out += [answer.mean(), answer.std()]
    return [np.array(out)]


EXTRACTORS: dict[str, Extractor] = {
    "histogram": hsv_histogram(), "histogram48": hsv_histogram(4, 4, 3), "mean": mean_intensity, "skin": skin_ratio, "lines": lines, "entropy": entropy_ratio,
    "dsift": dense_sift, "edgehistogram": edge_histogram, "tamura": tamura, "autocolorcorrelogram": autocorrelogram, "gabor": gabor,
}
