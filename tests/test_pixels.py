import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.functions.stencil import gaussian_weights
from cytoloom.operators import histograms as H
from cytoloom.operators import pixels as P
from cytoloom.operators import regions as R
from cytoloom.operators import stencils as N

TILE = 8


def table(spark, images):
    rows = [
        (i, img.shape[1], img.shape[0], y, x, int(img[y, x]))
        for i, img in images.items()
        for y in range(img.shape[0])
        for x in range(img.shape[1])
    ]
    return spark.createDataFrame(rows, "image_id long, width long, height long, y long, x long, v long").repartition(5)


def grid(df, col, images):
    out = {i: np.zeros(img.shape, dtype=float) for i, img in images.items()}
    for r in df.select("image_id", "y", "x", F.col(col).alias("c")).collect():
        out[r.image_id][r.y, r.x] = r.c
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    smooth = (np.add.outer(np.arange(19), np.arange(27)) * 5 + rng.integers(0, 60, (19, 27))) % 256
    return {0: rng.integers(0, 256, (19, 27)), 1: smooth, 2: (rng.random((17, 21)) < 0.45) * 255}


def filtered(img, kernel):
    k = kernel.shape[0] // 2
    pad = np.pad(img.astype(float), k, mode="reflect")
    out = np.zeros(img.shape)
    for dy in range(-k, k + 1):
        for dx in range(-k, k + 1):
            out += kernel[dy + k, dx + k] * pad[k + dy : k + dy + img.shape[0], k + dx : k + dx + img.shape[1]]
    return out


def test_gaussian_weights():
    assert gaussian_weights(5, 1.0) == [14, 62, 104, 62, 14]
    assert sum(gaussian_weights(7, 1.5)) == 256


def test_blur_and_unsharp_across_tile_seams(spark, images):
    t = N.halo_tiles(table(spark, images), 3, TILE)
    t = N.unsharp(N.gaussian_blur(t, "v", "b7", 7, 1.5), "v", "u")
    own = N.own_pixels(t, TILE).cache()
    for size, sigma, col in ((7, 1.5, "b7"),):
        w = np.array(gaussian_weights(size, sigma))
        got = grid(own, col, images)
        for i, img in images.items():
            assert (got[i] == np.floor((filtered(img, np.outer(w, w)) + 32768) / 65536)).all()
    w = np.array(gaussian_weights(5, 1.0))
    got = grid(own, "u", images)
    for i, img in images.items():
        soft = np.floor((filtered(img, np.outer(w, w)) + 32768) / 65536)
        assert (got[i] == np.clip(np.floor((18 * img - 8 * soft + 5) / 10), 0, 255)).all()


def test_scharr_and_bilateral_across_tile_seams(spark, images):
    t = N.bilateral(N.scharr(N.halo_tiles(table(spark, images), 2, TILE), "v"), "v", "bi")
    own = N.own_pixels(t, TILE).cache()
    k = np.outer([3, 10, 3], [-1, 0, 1])
    gx, gy, bi = grid(own, "gx", images), grid(own, "gy", images), grid(own, "bi", images)
    for i, img in images.items():
        assert (gx[i] == filtered(img, k)).all() and (gy[i] == filtered(img, k.T)).all()
        pad = np.pad(img.astype(float), 2, mode="reflect")
        top, bottom = np.zeros(img.shape), np.zeros(img.shape)
        for dx, dy in N.DISC:
            n = pad[2 + dy : 2 + dy + img.shape[0], 2 + dx : 2 + dx + img.shape[1]]
            w = np.exp(-((n - img) ** 2) / 2450 - (dx * dx + dy * dy) / 2450)
            top, bottom = top + w * n, bottom + w
        assert (np.abs(bi[i] - np.floor(top / bottom + 0.5)) <= 1e-9).mean() > 0.99


@pytest.mark.parametrize("shape, times", [("cross3", 1), ("ellipse5", 1), ("ellipse5", 3)])
def test_closing_across_tile_seams(spark, images, shape, times):
    t = N.halo_tiles(table(spark, images), N.close_halo(shape, times), TILE)
    got = grid(N.own_pixels(N.morph_close(t, "v", "c", shape, times), TILE), "c", images)
    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    disc = [(dy, dx) for dy in (-1, 0, 1) for dx in range(-2, 3)] + [(-2, 0), (2, 0)]

    def step(img, pick, empty):
        pad = np.pad(img.astype(float), 2, constant_values=empty)
        return pick([pad[2 + dy : 2 + dy + img.shape[0], 2 + dx : 2 + dx + img.shape[1]] for dy, dx in (cross if shape == "cross3" else disc)], axis=0)

    for i, img in images.items():
        want = img
        for _ in range(times):
            want = step(want, np.max, -np.inf)
        for _ in range(times):
            want = step(want, np.min, np.inf)
        assert (got[i] == want).all()


def brute_otsu(img):
    best, at = -1.0, 0
    flat = img.ravel()
    for t in range(256):
        low, high = flat[flat <= t], flat[flat > t]
        if len(low) and len(high):
            var = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if var > best * (1 + 1e-12):
                best, at = var, t
    return at


def test_otsu(spark, images):
    got = {r.image_id: r.otsu for r in H.otsu(table(spark, images), "v").collect()}
    assert got == {i: brute_otsu(img) for i, img in images.items()}


def brute_clahe(img, clip, g):
    h, w = img.shape
    th, tw = -(-h // g), -(-w // g)
    pad = np.pad(img, ((0, th * g - h), (0, tw * g - w)), mode="reflect")
    luts = np.zeros((g, g, 256))
    for ty in range(g):
        for tx in range(g):
            hist = np.bincount(pad[ty * th : ty * th + th, tx * tw : tx * tw + tw].ravel(), minlength=256)
            cap = max(1, int(clip * th * tw / 256))
            excess = int(np.maximum(hist - cap, 0).sum())
            hist = np.minimum(hist, cap) + excess // 256
            left, step = excess % 256, max(256 // max(excess % 256, 1), 1)
            for i in range(0, 256, step):
                if left <= 0:
                    break
                hist[i] += 1
                left -= 1
            luts[ty, tx] = np.minimum(255, np.rint(np.cumsum(hist) * 255 / (th * tw)))
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            a, b = fy - y0, fx - x0
            ys, xs = (max(y0, 0), min(y0 + 1, g - 1)), (max(x0, 0), min(x0 + 1, g - 1))
            p = [luts[j, i, img[y, x]] for j in ys for i in xs]
            out[y, x] = np.rint((p[0] * (1 - b) + p[1] * b) * (1 - a) + (p[2] * (1 - b) + p[3] * b) * a)
    return out


def test_clahe_with_sizes_that_do_not_divide(spark, images):
    for g, clip in ((4, 3.5), (8, 40.0)):
        got = grid(H.clahe(table(spark, images), "v", "c", clip, g), "c", images)
        for i, img in images.items():
            assert np.abs(got[i] - brute_clahe(img.astype(int), clip, g)).max() == 0


def brute_canny(img, low, high):
    pad = np.pad(img.astype(int), 1, mode="edge")
    s = lambda dy, dx: pad[1 + dy : 1 + dy + img.shape[0], 1 + dx : 1 + dx + img.shape[1]]
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    edge = np.zeros(img.shape, dtype=int)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            v, ax, ay = m[y + 1, x + 1], abs(int(gx[y, x])), abs(int(gy[y, x])) << 15
            if v <= low:
                continue
            flat = ax * 13573
            if ay < flat:
                top = v > m[y + 1, x] and v >= m[y + 1, x + 2]
            elif ay > flat + (ax << 16):
                top = v > m[y, x + 1] and v >= m[y + 2, x + 1]
            else:
                d = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                top = v > m[y, x + 1 - d] and v > m[y + 2, x + 1 + d]
            if top:
                edge[y, x] = 2 if v > high else 1
    seen, stack = set(), [tuple(p) for p in np.argwhere(edge == 2)]
    while stack:
        y, x = stack.pop()
        if (y, x) in seen:
            continue
        seen.add((y, x))
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                p = (y + dy, x + dx)
                if 0 <= p[0] < img.shape[0] and 0 <= p[1] < img.shape[1] and edge[p] and p not in seen:
                    stack.append(p)
    return seen


def test_canny_across_tile_seams(spark, images):
    t = N.canny_candidates(N.halo_tiles(table(spark, images), 2, TILE), "v", "150", "500")
    got = {i: set() for i in images}
    for r in R.hysteresis(N.own_pixels(t, TILE)).collect():
        got[r.image_id].add((r.y, r.x))
    assert got == {i: brute_canny(img, 150, 500) for i, img in images.items()}


def test_signal_falls_back_to_gray(spark):
    rows = [(0, 2, 1, 0, 0, 90, 90, 90), (0, 2, 1, 0, 1, 40, 40, 40), (1, 2, 1, 0, 0, 90, 90, 10), (1, 2, 1, 0, 1, 9, 9, 9)]
    px = spark.createDataFrame(rows, "image_id long, width long, height long, y long, x long, b long, g long, r long")
    got = sorted((r.image_id, r.x, r.v) for r in P.signal(px).collect())
    assert got == [(0, 0, 90), (0, 1, 40), (1, 0, 80), (1, 1, 0)]
