"""Orientation descriptors against plain loops, and words of them."""

import numpy as np
import pytest

from tilewright.functions import orientation
from tilewright.operators import models


def plain(image, y, x, radius, rings, points, orientations):
    """One descriptor by loops: gradients, then each ring's Gaussian around each point."""
    h, w = image.shape

    def rise(o, i, j):
        i, j = (k if k >= 0 else -1 - k for k in (i, j))
        i, j = (k if k < n else 2 * n - 1 - k for k, n in ((i, h), (j, w)))
        dx = image[i, j + 1] - image[i, j] if j + 1 < w else 0.0
        dy = image[i + 1, j] - image[i, j] if i + 1 < h else 0.0
        a = 2 * np.pi * o / orientations
        return max(0.0, np.cos(a) * dx + np.sin(a) * dy)

    def kernel(sigma):
        reach = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        return reach, k / k.sum()

    sigmas = [radius * (r + 1) / (2 * rings) for r in range(rings)]
    maps = np.array([[[rise(o, i, j) for j in range(w)] for i in range(h)] for o in range(orientations)])
    each, before = [], 0.0
    for s in sigmas:
        reach, k = kernel(np.sqrt(s * s - before * before))
        before = s
        out = np.zeros_like(maps)
        for o in range(orientations):
            wide = np.pad(maps[o], reach, mode="symmetric")
            for i in range(h):
                for j in range(w):
                    out[o, i, j] = k @ wide[i : i + 2 * reach + 1, j : j + 2 * reach + 1] @ k
        maps = out
        each.append(out)
    row = list(each[0][:, y, x])
    for r in range(rings):
        far = radius * (r + 1) / rings
        for p in range(points):
            a = 2 * np.pi * p / points
            row += list(each[r][:, y + round(far * np.sin(a)), x + round(far * np.cos(a))])
    return np.array(row) / max(sum(row), 1e-300)


def test_against_loops():
    image = np.random.default_rng(1).normal(size=(19, 17))
    given = {"radius": 5, "rings": 2, "points": 4, "orientations": 3}
    got = orientation.descriptors(image, **given)
    assert got.shape == (9 * 7, 27)
    for y, x in ((5, 5), (9, 8), (13, 11)):
        assert np.allclose(got[(y - 5) * 7 + x - 5], plain(image, y, x, **given))


def test_small_flat_and_coloured_images(monkeypatch):
    assert orientation.descriptors(np.zeros((16, 40))).shape == (0, 200) and (orientation.descriptors(np.ones((17, 18))) == 0).all()
    image = np.random.default_rng(2).normal(size=(30, 25, 3))
    whole = orientation.descriptors(image)
    assert whole.shape == (14 * 9, 200) and np.allclose(whole.sum(1), 1) and np.allclose(whole, orientation.descriptors(image.mean(2)))
    monkeypatch.setattr(orientation, "AT_ONCE", 20)
    assert np.array_equal(orientation.descriptors(image), whole)


def test_words_of_descriptors(spark):
    """Images of stripes, upright or lying: their words tell them apart."""
    stripes = np.tile([0, 0, 255, 255], 6)[None].repeat(24, 0)
    images = [(i, 24, 24, (stripes if i % 2 else stripes.T).ravel().tolist()) for i in range(6)]
    df = spark.createDataFrame(images, "id int, height int, width int, pixels array<int>")
    words = models.visual_words(df, 8, every=1, batches=2, cut=models.descriptor_rows())
    assert len(words.first().features) == 200
    got = {r.id: r.histogram for r in models.features(df, "orientation", words=words).collect()}
    assert len(got) == 6 and got[0] == got[2] == got[4] and got[1] == got[3] == got[5] and got[0] != got[1] and sum(got[0]) == 64


def test_nearest_words_and_ties():
    rng = np.random.default_rng(3)
    words = rng.normal(size=(20, 6))
    words[7] = words[3]
    rows = np.concatenate([rng.normal(size=(100, 6)), words])
    want = ((rows[:, None] - words[None]) ** 2).sum(2).argmin(1)
    assert models.nearest_words(rows, words, (words * words).sum(1)).tolist() == want.tolist()
    assert want[107] == 3 and pytest.approx(0) == ((rows[107] - words[3]) ** 2).sum()
