"""Dense orientation descriptors of an image (Tola, Lepetit and Fua 2010), in numpy, image by image.

At each place: histograms of gradient orientations at the place itself and at points on rings around it, the farther out the more smoothed. Smoothed maps are made once an image, each ring's from the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

RADIUS, RINGS, POINTS, ORIENTATIONS = 8, 3, 8, 8
#: Descriptors made at once, about.
AT_ONCE = 4096


def smoothed(maps: np.ndarray, sigma: float) -> np.ndarray:
    """Maps (n, height, width) under a Gaussian cut at four sigma, edges mirrored."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        wide = np.pad(maps, pad, mode="symmetric")
        maps = sum(k * np.take(wide, range(i, i + maps.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return maps


def orientation_maps(image: np.ndarray, orientations: int = ORIENTATIONS) -> np.ndarray:
    """(orientations, height, width): how much the image rises towards each of them; 0 where it falls, and towards the last column or row."""
    dx, dy = np.zeros(image.shape), np.zeros(image.shape)
    dx[:, :-1], dy[:-1] = np.diff(image, axis=1), np.diff(image, axis=0)
    angles = 2 * np.pi * np.arange(orientations) / orientations
    return np.stack([np.maximum(0.0, np.cos(a) * dx + np.sin(a) * dy) for a in angles])


def layout(radius: int = RADIUS, rings: int = RINGS, points: int = POINTS) -> list[tuple[int, int, int]]:
    """(ring, dy, dx) of each histogram: the place itself, of the innermost ring's smoothing, then ring by ring."""
    out = [(0, 0, 0)]
    for ring in range(rings):
        far = radius * (ring + 1) / rings
        angles = 2 * np.pi * np.arange(points) / points
        out += [(ring, int(np.rint(far * np.sin(a))), int(np.rint(far * np.cos(a)))) for a in angles]
    return out


def strips(image: np.ndarray, radius: int = RADIUS, rings: int = RINGS, points: int = POINTS, orientations: int = ORIENTATIONS) -> Iterator[np.ndarray]:
    """Descriptors (rows, (rings * points + 1) * orientations) of all places at least radius from the edges, by row, some rows of places at a time; each sums to 1, or is 0 in a flat place. An image too small has none."""
    if image.ndim == 3:
        image = image.mean(2)
    height, width = (n - 2 * radius for n in image.shape)
    if height <= 0 or width <= 0:
        return
    sigmas = [radius * (r + 1) / (2 * rings) for r in range(rings)]
    maps, before, rings_of = orientation_maps(image.astype(float), orientations), 0.0, []
    for sigma in sigmas:
        maps = smoothed(maps, np.sqrt(sigma**2 - before**2))
        before = sigma
        rings_of.append(maps)
    step = max(1, AT_ONCE // width)
    for y in range(0, height, step):
        n = min(step, height - y)
        parts = [rings_of[ring][:, radius + y + dy : radius + y + dy + n, radius + dx : radius + dx + width] for ring, dy, dx in layout(radius, rings, points)]
        rows = np.concatenate(parts).reshape(-1, n * width).T
        total = rows.sum(1, keepdims=True)
        yield np.divide(rows, total, out=np.zeros_like(rows), where=total > 0)


def descriptors(image: np.ndarray, **given: int) -> np.ndarray:
    """All of strips() as one array."""
    made = list(strips(image, **given))
    size = (given.get("rings", RINGS) * given.get("points", POINTS) + 1) * given.get("orientations", ORIENTATIONS)
    return np.concatenate(made) if made else np.empty((0, size))
