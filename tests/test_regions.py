import numpy as np
import pytest

from cytoloom.operators import contours as T
from cytoloom.operators import regions as R
from cytoloom.operators.boxes import hull_of
from cytoloom.operators.cells import homogeneity
from tests.test_pixels import table

STEPS = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def walk(img, start, first):
    """Border walk from ``start``, looking first in direction ``first``; returns the ordered points."""
    on = lambda p: 0 <= p[0] < img.shape[0] and 0 <= p[1] < img.shape[1] and img[p] > 0
    for k in range(8):
        d = (first + k) % 8
        last = (start[0] + STEPS[d][0], start[1] + STEPS[d][1])
        if on(last):
            break
    else:
        return [start]
    points, here, back = [], start, last
    while True:
        points.append(here)
        d = STEPS.index((back[0] - here[0], back[1] - here[1]))
        for k in range(1, 9):
            e = (d - k) % 8
            nxt = (here[0] + STEPS[e][0], here[1] + STEPS[e][1])
            if on(nxt):
                break
        if nxt == start and here == last:
            return points
        here, back = nxt, here


def area(points):
    s = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(points, points[1:] + points[:1]))
    return abs(s) / 2


def flood(img, value, diagonal):
    label = np.full(img.shape, -1)
    regions = []
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            if (img[y, x] > 0) != value or label[y, x] >= 0:
                continue
            stack, members = [(y, x)], []
            label[y, x] = len(regions)
            while stack:
                p = stack.pop()
                members.append(p)
                for k, (dy, dx) in enumerate(STEPS):
                    if k % 2 and not diagonal:
                        continue
                    q = (p[0] + dy, p[1] + dx)
                    if 0 <= q[0] < img.shape[0] and 0 <= q[1] < img.shape[1] and (img[q] > 0) == value and label[q] < 0:
                        label[q] = len(regions)
                        stack.append(q)
            regions.append(sorted(members))
    return regions


def expected(img):
    out = {}
    for kind, diagonal in (("outer", True), ("hole", False)):
        for members in flood(img, kind == "outer", diagonal):
            ys, xs = [p[0] for p in members], [p[1] for p in members]
            if kind == "hole" and (min(ys) == 0 or min(xs) == 0 or max(ys) == img.shape[0] - 1 or max(xs) == img.shape[1] - 1):
                continue
            first = members[0]
            points = walk(img, first, 0) if kind == "outer" else walk(img, (first[0], first[1] - 1), 4)
            grow = 0 if kind == "outer" else 1
            box = (min(xs) - grow, min(ys) - grow, max(xs) - min(xs) + 1 + 2 * grow, max(ys) - min(ys) + 1 + 2 * grow)
            out[first[0] * R.ROW + first[1]] = (kind, *box, len(members), area(points), points)
    return out


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(8)
    sparse = (rng.random((26, 30)) < 0.35) * 255
    dense = (rng.random((25, 23)) < 0.62) * 255
    rings = np.zeros((30, 30), dtype=int)
    for r in (13, 9, 4):
        rings[15 - r : 15 + r, 15 - r : 15 + r] = 255
        rings[17 - r : 13 + r, 17 - r : 13 + r] = 0
    return {0: sparse, 1: dense, 2: rings}


@pytest.mark.parametrize("tile", [8, 256])
def test_regions_match_border_walks(spark, masks, tile):
    parts = R.region_parts(table(spark, masks), tile)
    got = {(r.image_id, r.region_id): (r.kind, r.x, r.y, r.w, r.h, r.n_pixels, r.area) for r in parts.contours().collect()}
    want = {(i, k): v[:7] for i, img in masks.items() for k, v in expected(img).items()}
    assert got == want
    tips = {(r.image_id, r.contour_id): ((r.ay, r.ax), (r.by, r.bx)) for r in R.contour_tips(parts).collect()}
    assert tips == {(i, k): (v[7][0], v[7][-1]) for i, img in masks.items() for k, v in expected(img).items()}


@pytest.mark.parametrize("tile", [8, 256])
def test_points_of_a_contour_are_those_of_its_walk(spark, masks, tile):
    line = np.zeros((5, 12), dtype=int)
    line[2, 3:9] = 255  # six pixels, ten steps
    more = {**masks, 3: line, 4: np.full((20, 20), 255), 5: np.array([[255]]), 6: np.array([[255, 0, 255]] * 3)}
    tips = R.contour_tips(R.region_parts(table(spark, more), tile)).collect()
    got = {(r.image_id, r.contour_id): r.n_points for r in tips}
    assert got == {(i, k): len(v[7]) for i, img in more.items() for k, v in expected(img).items()}
    assert got[3, 2 * R.ROW + 3] == 10 and got[4, 0] == 76


def test_enclosure_follows_nesting(spark, masks):
    parts = R.region_parts(table(spark, {2: masks[2]}), 8)
    inside = {}
    for r in parts.enclosure().collect():
        inside.setdefault(r.region_id, set()).add(r.inner)
    assert sorted(len(v) for v in inside.values()) == [1, 2, 3, 4, 5, 6]


def test_flat_bright_patch_is_dropped_and_empty_interior_kept(spark):
    rows = [(1, 1, 0, x, 230, 230, 230) for x in range(9)] + [(1, 2, 0, x, 250, 250, 250) for x in range(9)]
    inside = spark.createDataFrame(rows, "image_id long, cell_id long, y long, x long, b long, g long, r long")
    for colored, second in ((True, True), (False, False)):  # without any cyan in the image white pixels count as well
        images = spark.createDataFrame([(1, colored)], "image_id long, colored boolean")
        assert {r.cell_id: r.keep for r in homogeneity(inside, images).collect()} == {1: False, 2: second}


def points_of(spark, shapes):
    rows = [(0, c, i, *p) for c, pts in shapes.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "image_id long, contour_id long, seq long, x long, y long")


def test_contour_measures_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(2)
    shapes = {c: [tuple(map(int, p)) for p in rng.integers(0, 40, (rng.integers(3, 60), 2))] for c in range(12)}
    df = points_of(spark, shapes).repartition(3)
    whole = sorted(tuple(r) for r in T.segments(df).collect())
    assert whole == sorted(tuple(r) for r in T.segments(df, chunk=4).collect())
    assert {r.contour_id: r.area for r in T.polygon_area(df).collect()} == {c: area([(y, x) for x, y in p]) for c, p in shapes.items()}
    hulls = {}
    for r in T.convex_hull(df).orderBy("contour_id", "seq").collect():
        hulls.setdefault(r.contour_id, []).append((r.x, r.y))
    assert hulls == {c: hull_of(p) for c, p in shapes.items()}


def test_filled_spans_of_a_traced_region_are_its_pixels(spark, masks):
    img = masks[2]
    outer = max((v for v in expected(img).values() if v[0] == "outer"), key=lambda v: v[6])
    df = points_of(spark, {0: [(x, y) for y, x in outer[7]]})
    filled = {(r.y, x) for r in T.fill_spans(df).collect() for x in range(r.x0, r.x1 + 1)}
    assert filled == {(y, x) for y in range(2, 28) for x in range(2, 28)}
