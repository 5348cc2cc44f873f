import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators.reports import html_gallery
from cytoloom.sources import documents as D
from cytoloom.sources import images as I
from cytoloom.sources import sinks as K
from cytoloom.streaming import label_sync as X


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(1)
    images = {"a.png": rng.integers(0, 256, (5, 7, 3)), "B.PNG": rng.integers(0, 256, (4, 3, 3))}
    for name, rgb in images.items():
        png(tmp_path / name, rgb)
    (tmp_path / "notes.txt").write_text("no image")
    (tmp_path / "broken.png").write_bytes(b"not a png")
    return tmp_path, images


def test_listing_keeps_supported_types_only(spark, folder):
    path, _ = folder
    assert sorted(r["name"] for r in I.list_images(spark, str(path)).collect()) == ["B.PNG", "a.png", "broken.png"]


def test_pixels_of_real_files(spark, folder):
    path, images = folder
    pixels = I.pixel_scan(I.read_images(spark, str(path)))
    got = {(r.image_id, r.y, r.x): (r.b, r.g, r.r) for r in pixels.collect()}
    want = {(n, y, x): tuple(map(int, img[y, x, ::-1])) for n, img in images.items() for y in range(img.shape[0]) for x in range(img.shape[1])}
    assert got == want


def test_unreadable_image_fails_when_asked(spark, folder):
    path, _ = folder
    with pytest.raises(Exception, match="unreadable image"):
        I.pixel_scan(I.read_images(spark, str(path), skip_unreadable=False)).count()


def test_guard(spark):
    empty = spark.createDataFrame([], "name string")
    assert I.input_guard(empty).first()["status"] == "no input"
    assert I.input_guard(spark.createDataFrame([("a.txt",)], "name string")).first()["status"] == "no image"
    with pytest.raises(ValueError):
        I.require_images(empty)


def test_image_partitions_are_replaced_alone_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(20).selectExpr("id % 4 as image_id", "id as shard_index", "cast(null as binary) as image",
                                       "cast(null as binary) as mask", "array(1f) as embedding", "1 as label", "array(id) as bbox")
    K.write_by_image(first, path)
    K.write_by_image(first.where("image_id = 2").limit(1).withColumn("label", F.lit(9)), path)
    back = D.read_shards(spark, path)
    assert {r.image_id: r["count"] for r in back.groupBy("image_id").count().collect()} == {0: 5, 1: 5, 2: 1, 3: 5}
    plan = back.where("image_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_id" in plan


def test_folders_do_not_grow_with_the_images(spark, tmp_path):
    """One folder per image made the number of files that of the images."""
    path = str(tmp_path / "t")
    rows = spark.range(900).selectExpr("id % 300 as image_id", "id as shard_index", "cast(null as binary) as image",
                                       "cast(null as binary) as mask", "array(1f) as embedding", "1 as label", "array(id) as bbox")
    K.write_in_folders(rows, path, 4)
    assert {p.name for p in (tmp_path / "t").glob("*=*")} == {f"folder={k}" for k in range(4)}
    back = D.read_shards(spark, path)
    assert back.groupBy("image_id").count().where("count = 3").count() == 300
    wanted = spark.range(1).select(F.lit(17).alias("image_id")).select(K.image_folder(4)).first()[0]
    one = back.where((F.col("image_id") == 17) & (F.col("folder") == wanted))
    assert one.count() == 3 and "PartitionFilters: [isnotnull(folder" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["shard_scan", "training_batch_fetch"])
def test_shards_are_written_in_few_folders(spark, monkeypatch, tmp_path, name):
    import __spark_entry__ as contract
    from cytoloom.catalog import sources

    monkeypatch.setattr(sources, "scratch_path", lambda _, what: str(tmp_path / what))
    found = contract.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert 1 <= len(list((tmp_path / "shards").glob("*=*"))) <= 4


def test_upsert_keeps_unchanged_fields(spark):
    now = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, state string, cluster long")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, state string")
    assert sorted(tuple(r) for r in D.upsert(now, new, ["id"]).collect()) == [(1, "a", 5), (2, "c", 6), (3, "d", None)]


def test_gallery_pages_join_to_one_document(spark, tmp_path):
    cells = spark.range(1, 451).selectExpr("7L as image_id", "id as number", "format_string('subcell_%03d', id) as cell_id")
    K.write_html(html_gallery(cells), str(tmp_path / "html"))
    files = sorted((tmp_path / "html" / "image_id=7").glob("part-*"))
    text = "".join(f.read_text().replace("\n", "") for f in files)
    assert text.startswith("<html>") and text.endswith("</html>") and text.count('class="card"') == 450
    assert "450 cells" in text and text.index("subcell_001") < text.index("subcell_450")


def test_label_feed_takes_the_newest_label_whatever_the_batches(spark, tmp_path):
    feed, table, progress = tmp_path / "feed", str(tmp_path / "labels"), str(tmp_path / "progress")
    feed.mkdir()
    batches = [[(1, "x", "2026-01-01T00:00:05Z"), (2, "p", "2026-01-01T00:00:01Z")], [(1, "old", "2026-01-01T00:00:02Z"), (2, "q", "2026-01-01T00:00:09Z")]]
    for i, rows in enumerate(batches):
        (feed / f"{i}.json").write_text("\n".join(json.dumps({"cluster_id": c, "label": s, "ts": t}) for c, s, t in rows))
        X.wait(X.sync_labels(X.read_label_feed(spark, str(feed)), table, progress))
    cells = spark.createDataFrame([(1, 1, "s"), (2, 2, "s"), (3, 3, "s")], "cell_id long, cluster_id long, state string")
    got = {r.cell_id: (r.active_label, r.is_verified) for r in X.synced_cells(cells, table).collect()}
    assert got == {1: ("x", True), 2: ("q", True), 3: ("s", False)}
