"""What must not grow with the input: pixel shuffles, rows per task, tables sent to the driver."""

import re

import pytest

import __spark_entry__ as contract
from cytoloom import session
from cytoloom.sources.views import SIDE, Views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def test_tasks_of_pixels_grow_with_the_images(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", SIDE * SIDE // 4)
    v = Views(spark, SF)
    assert v.px.rdd.getNumPartitions() >= 4 * v.table("supplier").count()


@pytest.mark.parametrize("name", ["gaussian_blur", "morph_close"])
def test_stencils_on_small_images_shuffle_no_pixels(spark, name):
    df = contract.queries()[name](spark, SF)
    assert all("hashpartitioning(image_id" in x and ("REPARTITION_BY_NUM" in x or "y#" in x) for x in exchanges(df))
    assert len(exchanges(df)) == 2  # hits counted, then hits and images dealt by image


@pytest.mark.parametrize("name", ["clahe", "clahe_scharr_fusion", "fused_composite"])
def test_contrast_shuffles_no_pixels_by_level(spark, name):
    assert not [x for x in exchanges(contract.queries()[name](spark, SF)) if "_bin" in x]


@pytest.mark.parametrize("name", ["gradient_fusion", "fused_composite"])
def test_edges_meet_pixels_by_image(spark, name):
    """Pixels are dealt by image once; edges are not joined to them pixel by pixel."""
    text = plan(contract.queries()[name](spark, SF))
    assert not re.search(r"MergeJoin \[image_id#\d+L?, y#\d+L?, x#\d+L?\], .*LeftOuter", text)
    assert "ShuffledHashJoin" in text


def test_crops_take_pixels_without_a_shuffle(spark):
    """Boxes and their centres meet pixels by image; each crop is then one row."""
    text = plan(contract.queries()["embed_batch"](spark, SF))
    assert "MergeJoin" not in text and "gx#" not in text


def test_gallery_finds_its_cells_once(spark):
    text = plan(contract.queries()["html_gallery"](spark, SF))
    assert "Join" not in text and "Window" not in text and "gallery-cells" in text


def test_border_pieces_lay_out_many_tiles_at_once_in_tasks_that_grow(spark, monkeypatch):
    import numpy as np

    from cytoloom.operators import tracing as TR

    calls = []
    monkeypatch.setattr(TR, "_pieces", lambda keys, *_: calls.append(len(keys)))
    import pyarrow as pa

    tiles = np.repeat(np.arange(40), 3)
    cells = [np.full(120, 7), tiles, tiles * 0, tiles * 16 + np.tile([1, 2, 3], 40), np.full(120, 5)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["image_id", "ty", "tx", "y", "x"])
    list(TR._chains(16)([whole.slice(0, 50), whole.slice(50)]))
    assert sum(calls) == 40 and len(calls) == 3  # two batches and the tile held at the end, not one call per tile
    monkeypatch.undo()

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    mask = spark.range(400).selectExpr("id div 20 as image_id", "(id % 20) * 20 as y", "1L as x", "255 as v")
    traced = TR.Traced(mask, 16)
    assert traced.table().count() == 400
    assert traced.pieces.select("image_id").rdd.getNumPartitions() >= 1 and len(traced.pieces.inputFiles()) > 16


def test_boundary_f1_broadcasts_no_pixels(spark):
    df = contract.queries()["boundary_f1"](spark, SF)
    grown = plan(df).split("Generate explode([")
    assert plan(df).count("SortMergeJoin [image_id") >= 2 and len(grown) > 1
    assert not [x for x in exchanges(df) if "BroadcastExchange" in x and "input[2" in x]  # none on (image_id, y, x)


def test_contour_tips_broadcast_no_borders(spark):
    from cytoloom.operators import regions as R

    mask = spark.range(400).selectExpr("0L as image_id", "20L as width", "20L as height", "id div 20 as y", "id % 20 as x", "id % 3 as v")
    assert "BroadcastExchange" not in plan(R.contour_tips(R.region_parts(mask)))
