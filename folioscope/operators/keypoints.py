"""Scale-invariant keypoints and DAISY descriptors in numpy, from the published papers.

Keypoints are extrema of differences of Gaussians over octaves, refined to sub-pixel places, kept where contrast is high
and curvature is no edge's, turned to the main directions of the gradient around them, and described by 4 x 4 cells of 8
directions. All stages work on whole arrays; only the few extrema are looked at one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from folioscope.operators.images import EPS, EXTRACTORS, grey, norm_descriptor

#: Constants of the detector; fixed values.
INTERVALS = 3
SIGMA = 1.6
CONTRAST = 0.04
CURVATURE = 10.0
INITIAL_BLUR = 0.5
BORDER = 5
REFINEMENTS = 5
ORIENTATION_BINS = 36
ORIENTATION_SIGMA = 1.5
ORIENTATION_SMOOTHINGS = 2
ORIENTATION_PEAK = 0.8
DESCRIPTOR_CELLS = 4
DESCRIPTOR_BINS = 8
DESCRIPTOR_SCALE = 3.0
DESCRIPTOR_CUT = 0.2
DESCRIPTOR_FACTOR = 512.0


@dataclass(frozen=True)
class Keypoint:
    x: float
    y: float
    scale: float
    angle: float
    descriptor: np.ndarray


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return x
    r = max(1, math.ceil(4 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    pad = np.pad(x, ((r, r), (0, 0)), mode="edge")
    rows = sum(w * pad[i : i + x.shape[0]] for i, w in enumerate(k))
    pad = np.pad(rows, ((0, 0), (r, r)), mode="edge")
    return sum(w * pad[:, i : i + x.shape[1]] for i, w in enumerate(k))


def doubled(x: np.ndarray) -> np.ndarray:
    """Twice the size, values between neighbours on the line between them."""
    h, w = x.shape
    ys, xs = np.minimum(np.arange(2 * h) / 2, h - 1), np.minimum(np.arange(2 * w) / 2, w - 1)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def pyramid(x: np.ndarray, double: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(levels, differences) of each octave; the next one begins with every second pixel of the level of twice the blur."""
    base = doubled(x) if double else x
    have = INITIAL_BLUR * (2 if double else 1)
    level = blur(base, math.sqrt(max(SIGMA**2 - have**2, 0.01)))
    steps = [SIGMA * math.sqrt(2 ** (2 * i / INTERVALS) - 2 ** (2 * (i - 1) / INTERVALS)) for i in range(1, INTERVALS + 3)]
    out = []
    for _ in range(max(1, int(math.log2(max(2, min(base.shape)))) - 2)):
        levels = [level]
        for s in steps:
            levels.append(blur(levels[-1], s))
        stack = np.stack(levels)
        out.append((stack, np.diff(stack, axis=0)))
        level = stack[INTERVALS][::2, ::2]
        if min(level.shape) < 2 * BORDER + 3:
            break
    return out


def extrema(d: np.ndarray) -> np.ndarray:
    """(level, y, x) that exceed, or fall short of, all 26 neighbours, off the border and above the first contrast bound."""
    inner = d[1:-1, 1:-1, 1:-1]
    s, h, w = d.shape
    around = [d[1 + i : s - 1 + i, 1 + j : h - 1 + j, 1 + k : w - 1 + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    top, low = np.maximum.reduce(around), np.minimum.reduce(around)
    hit = (((inner > top) & (inner > 0)) | ((inner < low) & (inner < 0))) & (np.abs(inner) > 0.5 * CONTRAST / INTERVALS)
    found = np.argwhere(hit) + 1
    ok = (found[:, 1] >= BORDER) & (found[:, 1] < h - BORDER) & (found[:, 2] >= BORDER) & (found[:, 2] < w - BORDER)
    return found[ok]


def refine(d: np.ndarray, at: np.ndarray):
    """(place, offset) after steps to the extremum of the fitted quadratic, or None: too far, too faint, or on an edge."""
    s, h, w = d.shape
    p = at.copy()
    for _ in range(REFINEMENTS):
        c = d[p[0] - 1 : p[0] + 2, p[1] - 1 : p[1] + 2, p[2] - 1 : p[2] + 2]
        first = np.array([c[2, 1, 1] - c[0, 1, 1], c[1, 2, 1] - c[1, 0, 1], c[1, 1, 2] - c[1, 1, 0]]) / 2
        second = np.empty((3, 3))
        line = [(c[0, 1, 1], c[2, 1, 1]), (c[1, 0, 1], c[1, 2, 1]), (c[1, 1, 0], c[1, 1, 2])]
        for i, (a, b) in enumerate(line):
            second[i, i] = a + b - 2 * c[1, 1, 1]
        second[0, 1] = second[1, 0] = (c[2, 2, 1] - c[2, 0, 1] - c[0, 2, 1] + c[0, 0, 1]) / 4
        second[0, 2] = second[2, 0] = (c[2, 1, 2] - c[2, 1, 0] - c[0, 1, 2] + c[0, 1, 0]) / 4
        second[1, 2] = second[2, 1] = (c[1, 2, 2] - c[1, 2, 0] - c[1, 0, 2] + c[1, 0, 0]) / 4
        offset = -np.linalg.pinv(second) @ first
        if (np.abs(offset) < 0.5).all():
            if abs(c[1, 1, 1] + first @ offset / 2) < CONTRAST / INTERVALS:
                return None
            trace, det = second[1, 1] + second[2, 2], second[1, 1] * second[2, 2] - second[1, 2] ** 2
            if det <= 0 or trace**2 / det >= (CURVATURE + 1) ** 2 / CURVATURE:
                return None
            return p, offset
        p = p + np.rint(offset).astype(int)
        if not (1 <= p[0] <= s - 2 and BORDER <= p[1] < h - BORDER and BORDER <= p[2] < w - BORDER):
            return None
    return None


def _window(level: np.ndarray, y: int, x: int, r: int):
    """Gradient size and direction within r of a place, and the steps from it."""
    h, w = level.shape
    ys, xs = np.arange(max(1, y - r), min(h - 1, y + r + 1)), np.arange(max(1, x - r), min(w - 1, x + r + 1))
    part = level[ys[0] - 1 : ys[-1] + 2, xs[0] - 1 : xs[-1] + 2]
    gx, gy = (part[1:-1, 2:] - part[1:-1, :-2]), (part[:-2, 1:-1] - part[2:, 1:-1])
    dy, dx = np.meshgrid(ys - y, xs - x, indexing="ij")
    return np.hypot(gx, gy), np.arctan2(gy, gx), dy, dx


def orientations(level: np.ndarray, y: int, x: int, scale: float) -> list[float]:
    """The directions of the main peaks of the smoothed histogram of gradients."""
    sigma = ORIENTATION_SIGMA * scale
    size, angle, dy, dx = _window(level, y, x, round(3 * sigma))
    weight = size * np.exp(-(dy**2 + dx**2) / (2 * sigma**2))
    place = np.rint(ORIENTATION_BINS * (angle + math.pi) / (2 * math.pi)).astype(int) % ORIENTATION_BINS
    n = np.bincount(place.ravel(), weight.ravel(), ORIENTATION_BINS)
    for _ in range(ORIENTATION_SMOOTHINGS):
        n = 0.25 * np.roll(n, 1) + 0.5 * n + 0.25 * np.roll(n, -1)
    left, right = np.roll(n, 1), np.roll(n, -1)
    out = []
    for i in np.flatnonzero((n > left) & (n > right) & (n >= ORIENTATION_PEAK * n.max())):
        peak = i + 0.5 * (left[i] - right[i]) / (left[i] - 2 * n[i] + right[i])
        out.append((2 * math.pi * peak / ORIENTATION_BINS - math.pi + math.pi) % (2 * math.pi) - math.pi)
    return out


def describe(level: np.ndarray, y: int, x: int, scale: float, angle: float) -> np.ndarray:
    """4 x 4 cells of 8 directions relative to the angle, each gradient shared by its neighbours along all three axes."""
    d, bins = DESCRIPTOR_CELLS, DESCRIPTOR_BINS
    width = DESCRIPTOR_SCALE * scale
    size, turn, dy, dx = _window(level, y, x, int(width * math.sqrt(2) * (d + 1) * 0.5 + 0.5))
    c, s = math.cos(angle) / width, math.sin(angle) / width
    col, row = dx * c - dy * s, dx * s + dy * c
    weight = size * np.exp(-(col**2 + row**2) / (0.5 * d * d))
    r, q = row + d / 2 - 0.5, col + d / 2 - 0.5
    o = ((turn - angle) % (2 * math.pi)) * bins / (2 * math.pi)
    inside = (r > -1) & (r < d) & (q > -1) & (q < d)
    r, q, o, weight = r[inside], q[inside], o[inside], weight[inside]
    out = np.zeros((d, d, bins))
    r0, q0, o0 = np.floor(r).astype(int), np.floor(q).astype(int), np.floor(o).astype(int)
    for i in (0, 1):
        for j in (0, 1):
            ok = (r0 + i >= 0) & (r0 + i < d) & (q0 + j >= 0) & (q0 + j < d)
            for k in (0, 1):
                share = weight * np.abs(1 - i - (r - r0)) * np.abs(1 - j - (q - q0)) * np.abs(1 - k - (o - o0))
                np.add.at(out, (r0[ok] + i, q0[ok] + j, (o0[ok] + k) % bins), share[ok])
    v = norm_descriptor(out.ravel(), DESCRIPTOR_CUT)
    return np.minimum((v * DESCRIPTOR_FACTOR).astype(int), 255).astype(float)


def detect(image: np.ndarray, mask: np.ndarray | None = None, double: bool = True) -> list[Keypoint]:
    """Keypoints by decreasing scale, equal ones once; a mask leaves out places where it is 0."""
    x = grey(image) / 255
    if min(x.shape) < 2 * BORDER + 3:
        return []
    found: dict[tuple, Keypoint] = {}
    for o, (levels, differences) in enumerate(pyramid(x, double)):
        for at in extrema(differences):
            got = refine(differences, at)
            if got is None:
                continue
            (s, py, px), offset = got
            own = SIGMA * 2 ** ((s + offset[0]) / INTERVALS)
            up = 2.0**o / (2 if double else 1)
            kx, ky, scale = (px + offset[2]) * up, (py + offset[1]) * up, own * up
            if mask is not None and not mask[min(int(ky), mask.shape[0] - 1), min(int(kx), mask.shape[1] - 1)]:
                continue
            for angle in orientations(levels[s], py, px, own):
                key = (round(kx, 3), round(ky, 3), round(scale, 3), round(angle, 3))
                if key not in found:
                    found[key] = Keypoint(kx, ky, scale, angle, describe(levels[s], py, px, own, angle))
    return sorted(found.values(), key=lambda k: (-k.scale, k.y, k.x, k.angle))


def sift(image: np.ndarray) -> list[np.ndarray]:
    return [k.descriptor for k in detect(image)]


def daisy_maps(x: np.ndarray, radius: float = 15, rings: int = 3, bins: int = 8) -> list[np.ndarray]:
    """Maps of the gradient's share in each direction, blurred more for each ring."""
    gy, gx = np.gradient(x)
    turns = 2 * math.pi * np.arange(bins) / bins
    maps = np.stack([np.maximum(math.cos(t) * gx + math.sin(t) * gy, 0) for t in turns])
    return [np.stack([blur(m, radius * (r + 1) / (2 * rings)) for m in maps]) for r in range(rings)]


def daisy(step: int = 10, radius: float = 15, rings: int = 3, around: int = 8, bins: int = 8):
    """One descriptor a point of a grid: the centre and ``around`` points on each ring, a normed histogram each."""

    def run(image: np.ndarray) -> list[np.ndarray]:
        x = grey(image) / 255
        h, w = x.shape
        r = int(math.ceil(radius))
        if min(h, w) <= 2 * r:
            return []
        maps = daisy_maps(x, radius, rings, bins)
        points = [(0, 0.0, 0.0)] + [
            (k, radius * (k + 1) / rings * math.sin(2 * math.pi * a / around), radius * (k + 1) / rings * math.cos(2 * math.pi * a / around)) for k in range(rings) for a in range(around)
        ]
        out = []
        for y in range(r, h - r, step):
            for x0 in range(r, w - r, step):
                cells = [maps[k][:, int(round(y + dy)), int(round(x0 + dx))] for k, dy, dx in points]
                out.append(np.concatenate([c / max(float(np.linalg.norm(c)), EPS) for c in cells]))
        return out

    return run


EXTRACTORS["sift"] = sift
EXTRACTORS["daisy"] = daisy()
