"""Whole flows and closing steps: what must not be broadcast, and that small images held together give what tiles give."""

import re

import pytest

import __spark_entry__ as contract
from cytoloom.operators import regions as R
from cytoloom.plans import extraction as X
from cytoloom.sources.views import Views
from tests.test_scale import SF, plan
from tests.test_views import tables

BY_PIXEL = r"BroadcastHashJoin \[image_id#\d+L?, y#\d+L?, x#\d+L?\]"


@pytest.mark.parametrize("name", ["baseline_extraction", "sharpening_extraction"])
def test_flows_broadcast_no_pixels_of_cells(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert not re.search(BY_PIXEL, text) and "SortMergeJoin [image_id" in text


def test_edges_and_targets_broadcast_no_pixels(spark):
    mask = spark.range(400).selectExpr("id % 3 as image_id", "id div 20 as y", "id % 20 as x", "cast(id % 3 as int) as edge")
    anchors = Views(spark, SF).px_cells.selectExpr("image_id", "cy as y", "cx + r as x")
    for df in (R.hysteresis(mask), R.keep_target(mask, anchors)):
        assert "BroadcastHashJoin" not in plan(df)


def test_images_held_together_give_the_maps_of_tiles(spark, tmp_path):
    items = [(i, p * 7 % 50, p * 11 % 90, 1 + p % 7) for i in (3, 8) for p in range(60)]
    px = tables(spark, tmp_path, [3, 8], items).px
    facts = X.image_facts(px)
    for make in (X.baseline_map, X.boundary_map):
        apart, held = (sorted(map(tuple, df.collect())) for df in (make(px, grid=4), make(px, grid=4, images=facts, together=True)))
        assert apart == held and len(held) == 2 * 48 * 48


def test_crops_are_dealt_by_their_pixels(spark, monkeypatch):
    """Not by their bytes, which would fold the contrast tables of very many crops into one task; and pixels meet boxes without a shuffle."""
    from cytoloom import session
    from cytoloom.catalog import regions as CR

    kept = []
    monkeypatch.setattr(CR, "written", lambda df, name: kept.append(df) or df, raising=False)
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    CR.silhouettes(Views(spark, SF))
    assert kept and "MergeJoin" not in plan(kept[0]) and kept[0].rdd.getNumPartitions() >= 10


def test_closing_report_labels_pixels_for_tips_alone(spark, tmp_path, monkeypatch):
    items = [(i, p * 7 % 50, p * 11 % 90, 1 + p % 7) for i in (3, 8) for p in range(60)]
    px = tables(spark, tmp_path, [3, 8], items).px
    calls, label = [], R.label_pixels
    monkeypatch.setattr(R, "label_pixels", lambda *a, **b: calls.append(1) or label(*a, **b))
    closed = []
    close = X.close_borders
    monkeypatch.setattr(X, "close_borders", lambda *a, **b: closed.append(close(*a, **b)) or closed[-1])
    held = {r.image_id: tuple(r) for r in X.closing_report(px, together=True).collect()}
    assert len(calls) == 2  # set pixels and background of the mask, not of the closed one
    assert held == {r.image_id: tuple(r) for r in X.closing_report(px).collect()} and set(held) == {3, 8}
    filled = {r["image_id"]: r["count"] for r in R.filled_regions(closed[0]["closed"]).groupBy("image_id").count().collect()}
    assert {i: row[-1] for i, row in held.items()} == {i: filled.get(i, 0) for i in held} and any(filled.values())


def test_waves_take_only_images_whose_joins_changed(spark, monkeypatch):
    """An image with a long chain of joins does not make the others go round again; results are those of taking turns."""
    from cytoloom.operators import attachment as AT
    from tests.test_attachment import by_turns, result
    from tests.test_boxes import SCHEMA, random_boxes

    images = {i: random_boxes(90 + i, n=60, copies=bool(i % 2)) for i in range(4)}
    images[4] = [(1, 0, 0, 20, 20, 300)]  # no partner at all
    images[5] = [(1, 0, 0, 30, 30, 600), (2, 32, 0, 10, 10, 80)]  # settled by the first wave
    taken, states = [], AT.body_states
    monkeypatch.setattr(AT, "body_states", lambda j, b, o=None: taken.append({r.image_id for r in b.select("image_id").distinct().collect()}) or states(j, b, o))
    df = spark.createDataFrame([(i, *b) for i, rows in images.items() for b in rows], SCHEMA)
    assert result(AT.dup_leg_in_order(df)) == {i: by_turns(rows) for i, rows in images.items()}
    assert 4 not in taken[0] and 5 in taken[0] and all(b <= a for a, b in zip(taken, taken[1:]))
    assert len(taken) > 1 and 5 not in taken[1]
