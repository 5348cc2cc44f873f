import random

import pytest
from pyspark.sql import functions as F

from cytoloom.functions.geometry import touches_border
from cytoloom.operators import boxes as B

SCHEMA = "image_id long, j long, x long, y long, w long, h long, area long"


def frame(spark, rows, image=1):
    return spark.createDataFrame([(image, *r) for r in rows], SCHEMA)


def ids(df):
    return sorted((r.image_id, r.j) for r in df.select("image_id", "j").collect())


def inter(a, b):
    dx = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    dy = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    return max(0, dx) * max(0, dy)


def iou(a, b):
    i = inter(a, b)
    return i / (a[3] * a[4] + b[3] * b[4] - i)


def random_boxes(seed, n=120, side=160, copies=True):
    rnd = random.Random(seed)
    rows = []
    for j in range(1, n + 1):
        if copies and rows and rnd.random() < 0.25:
            rows.append((j, *rnd.choice(rows)[1:]))
            continue
        w, h = rnd.randint(4, 60), rnd.randint(4, 60)
        rows.append((j, rnd.randint(0, side), rnd.randint(0, side), w, h, int(w * h * rnd.uniform(0.3, 0.95))))
    return rows


def test_giant_cell_survives_only_the_deduplicated_filter(spark):
    rows = [(1, 900, 500, 200, 200, 20000), (2, 910, 510, 150, 150, 9000), (3, 911, 511, 149, 149, 8900)]
    df = frame(spark, rows)
    assert ids(B.non_composite(df)) == [(1, 1), (1, 2), (1, 3)]
    assert ids(B.non_composite_legacy(df, min_inner=200)) == [(1, 2), (1, 3)]


def test_true_composite_is_dropped_by_both(spark):
    df = frame(spark, [(1, 0, 0, 200, 200, 20000), (2, 5, 5, 40, 40, 900), (3, 120, 120, 40, 40, 900)])
    assert ids(B.non_composite(df)) == [(1, 2), (1, 3)]
    assert ids(B.non_composite_legacy(df)) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("gap, merged", [(2, True), (4, False)])
def test_leg_within_three_pixels_joins_its_body(spark, gap, merged):
    df = frame(spark, [(1, 0, 0, 30, 30, 600), (2, 30 + gap, 0, 10, 10, 80)])
    out = {r.j: (r.x, r.y, r.w, r.h, r.legs) for r in B.leg_attach(df).collect()}
    assert out == ({1: (0, 0, 42, 30, 1)} if merged else {1: (0, 0, 30, 30, 0), 2: (34, 0, 10, 10, 0)})


def test_border_margin(spark):
    df = frame(spark, [(1, 4, 50, 10, 10, 90), (2, 5, 50, 10, 10, 90)])
    out = df.select("j", touches_border(500, 500).alias("a"), touches_border(500, 500, 5).alias("b")).collect()
    assert {r.j: (r.a, r.b) for r in out} == {1: (True, True), 2: (False, True)}


def literal_non_composite(rows):
    keep = []
    for a in rows:
        unique = []
        for b in rows:
            if b[0] != a[0] and inter(a, b) >= 0.8 * b[3] * b[4] and a[5] > b[5] and b[5] >= 200:
                if not any(iou(b, u) > 0.6 for u in unique):
                    unique.append(b)
        if len(unique) < 2:
            keep.append(a[0])
    return keep


def test_non_composite_equals_the_greedy_loop(spark):
    images = {i: random_boxes(i) for i in range(6)}
    rows = [(i, *r) for i, boxes in images.items() for r in boxes]
    want = sorted((i, j) for i, boxes in images.items() for j in literal_non_composite(boxes))
    df = spark.createDataFrame(rows, SCHEMA)
    assert ids(B.non_composite(df)) == want
    # Neither the number of partitions nor other images change an image's result.
    assert ids(B.non_composite(df.repartition(11))) == want
    assert ids(B.non_composite(df.where("image_id = 3"))) == [p for p in want if p[0] == 3]


def test_seam_nms_equals_sequential(spark):
    images = {i: random_boxes(40 + i) for i in range(4)}
    want = []
    for i, boxes in images.items():
        kept = []
        for b in sorted(boxes, key=lambda r: (-r[5], r[0])):
            if all(iou(b, k) <= 0.5 for k in kept):
                kept.append(b)
        want += [(i, k[0]) for k in kept]
    df = spark.createDataFrame([(i, *r) for i, boxes in images.items() for r in boxes], SCHEMA)
    assert ids(B.seam_nms(df)) == sorted(want)


def test_one_box_copied_many_times_stays_cheap(spark):
    base = spark.range(200_000).selectExpr("1L image_id", "id j", "10L x", "10L y", "20L w", "20L h", "300L area")
    big = frame(spark, [(10**6, 0, 0, 100, 100, 9000)])
    df = base.unionByName(big)
    assert B.non_composite(df).count() == 200_001
    assert B.duplicate_subset(df).count() == 1
    pairs = B.overlaps(df).agg(F.sum("n_pairs")).first()[0]
    assert pairs == 200_000 * 199_999 // 2 + 200_000


def test_overlapping_tiles(spark):
    df = frame(spark, [(1, 0, 0, 10, 10, 90), (2, 900, 0, 10, 10, 90), (3, 1020, 890, 10, 10, 90)])
    got = sorted((r.j, r.tile_x, r.tile_y) for r in B.tile_assign(df).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0), (3, 0, 1), (3, 1, 0), (3, 1, 1)]
