"""Duplicates and legs in candidate order: waves against taking turns one by one."""

import random

import pytest

from cytoloom.operators import attachment as AT
from cytoloom.operators.boxes import hull_of, twice_area
from tests.test_boxes import SCHEMA, random_boxes

POINTS = "image_id long, contour_id long, seq long, x long, y long"


def outline(box):
    _, x, y, w, h, _ = box
    return [(x + a, y + b) for a in (0, w - 1) for b in (0, h - 1)]


def partner_kind(a, b):
    """What box b is to box a: both are (x, y, w, h, area)."""
    side = [min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1)]
    cover = max(0, side[0]) * max(0, side[1]) / (a[2] * a[3])
    if cover >= 0.75 and b[4] > a[4]:
        return "duplicate"
    if a[4] < 200 and b[4] >= 250 and (cover >= 0.08 or min(side) >= -3):
        return "leg"
    return None


def by_turns(boxes, points=None):
    """{j: (box, area, legs)} of the boxes that stay."""
    now = {b[0]: (*b[1:5], float(b[5])) for b in boxes}
    shape = {b[0]: hull_of((points or {}).get(b[0]) or outline(b)) for b in boxes}
    legs, stay = dict.fromkeys(now, 0), {}
    for j in sorted(now):
        partners = {k: kind for k in now if k != j and (kind := partner_kind(now[j], now[k]))}
        if not partners:
            stay[j] = (*now[j], legs[j])
            continue
        p = min(partners)
        if partners[p] == "leg":
            shape[p] = hull_of(shape[p] + shape[j])
            xs, ys = zip(*shape[p])
            now[p] = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, max(now[p][4], twice_area(shape[p]) / 2))
            legs[p] += 1
    return stay


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.j] = (r.x, r.y, r.w, r.h, r.area, r.legs)
    return out


def test_waves_equal_turns(spark):
    images = {i: random_boxes(80 + i, copies=bool(i % 2), side=150 + 60 * (i % 3)) for i in range(6)}
    rng = random.Random(4)
    for i in range(6, 9):  # many small boxes around a few large ones: bodies that grow, touch and swallow each other
        many = [(j, rng.randrange(160), rng.randrange(160), rng.randint(4, 14), rng.randint(4, 14)) for j in range(60)]
        some = [(60 + j if i == 6 else rng.randrange(1000, 9999), rng.randrange(150), rng.randrange(150), rng.randint(18, 50), rng.randint(18, 50)) for j in range(9)]
        images[i] = [(*b, b[3] * b[4] * 8 // 10) for b in {b[0]: b for b in many + some}.values()]
        rng.shuffle(images[i])
        images[i] = [(k, *b[1:]) for k, b in enumerate(images[i])]
    rows = [(i, *b) for i, boxes in images.items() for b in boxes]
    want = {i: by_turns(boxes) for i, boxes in images.items()}
    assert sum(v[5] for boxes in want.values() for v in boxes.values()) > 20
    assert result(AT.dup_leg_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_a_chain_of_dependencies(spark):
    """A leg makes a body reach the next leg, and so on: each join depends on the one before."""
    body = [(100, 0, 0, 30, 30, 700)]
    chain = [(k, 30 + 12 * k, 5, 9, 9, 70) for k in range(6)]  # gaps of 3 and of 3 again once the one before has joined
    rows = [(1, *b) for b in body + chain]
    want = {1: by_turns(body + chain)}
    assert want[1][100][5] == 6
    assert result(AT.dup_leg_in_order(spark.createDataFrame(rows, SCHEMA))) == want


@pytest.mark.parametrize("with_points", [False, True])
def test_contour_points_make_the_hull(spark, with_points):
    # A triangle and a small square beside its empty corner: the hull of contours is smaller than that of boxes.
    boxes = [(0, 40, 0, 10, 10, 81), (1, 0, 0, 41, 41, 800)]
    contours = {0: [(40, 0), (49, 0), (49, 9), (40, 9)], 1: [(0, 0), (40, 40), (0, 40)]}
    points = spark.createDataFrame([(5, c, s, *p) for c, ps in contours.items() for s, p in enumerate(ps)], POINTS)
    got = AT.dup_leg_in_order(spark.createDataFrame([(5, *b) for b in boxes], SCHEMA), points if with_points else None)
    assert result(got) == {5: by_turns(boxes, contours if with_points else None)}


def test_many_copies_and_a_large_cluster(spark):
    """20,000 boxes that all touch their neighbours, and 20,000 copies of one leg: rows of joins, no walk through the cluster."""
    line = [(2 * k + 1, 40 * k, 0, 41, 20, 600) for k in range(3000)] + [(2 * k + 2, 40 * k + 35, 18, 10, 6, 40) for k in range(3000)]
    copies = spark.range(20_000).selectExpr("2L image_id", "id j", "30L x", "2L y", "8L w", "8L h", "50L area")
    rows = spark.createDataFrame([(1, *b) for b in line] + [(2, 50_000, 0, 0, 31, 31, 800)], SCHEMA).unionByName(copies)
    got = result(AT.dup_leg_in_order(rows))
    # The first copy joins as a leg; the others then lie inside the grown body.
    assert got[2] == by_turns([(50_000, 0, 0, 31, 31, 800)] + [(j, 30, 2, 8, 8, 50) for j in range(50)])
    sample = by_turns([b for b in line if b[1] < 2000])
    assert {j: v for j, v in got[1].items() if v[0] < 1900} == {j: v for j, v in sample.items() if v[0] < 1900}


def test_no_boxes(spark):
    assert AT.dup_leg_in_order(spark.createDataFrame([], SCHEMA)).collect() == []
