"""The bound pixel table: its values against a plain loop, and what it costs per pixel."""

from cytoloom.sources.views import RINGS, SIDE, Views, _ring


def tables(spark, at, images, items):
    spark.createDataFrame([(i,) for i in images], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame(items, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int").write.parquet(f"{at}/lineitem.parquet")
    return Views(spark, str(at))


def pixels(image, items):
    """{(y, x): (b, g, r, ring)} of an image."""
    hits = {}
    for i, part, order, line in items:
        if None not in (part, order, line) and i == image:
            at = ((part * 13 + order * 3) % SIDE, (order * 7 + line * 131) % SIDE)
            hits[at] = hits.get(at, 0) + 1
    discs = [tuple(eval(e.replace("image_id", str(image))) for e in _ring(k)) for k in range(RINGS)]
    out = {}
    for y in range(SIDE):
        for x in range(SIDE):
            hit = hits.get((y, x), 0) % 10 * 3
            ring = any(r * r - r <= (x - cx) ** 2 + (y - cy) ** 2 <= r * r + r for cx, cy, r in discs)
            ground = 150 + (x * 7 + y * 13 + image * 3) % 60
            rest = (ground - hit, ground - 4 - hit, ground - (x * y + image) % 20 - hit, 0)
            out[y, x] = (220, 220, 40 + hit, 1) if ring else rest
    return out


def test_pixels_of_bound_images(spark, tmp_path):
    items = [(i, p * 7 % 50, p * 11 % 90, 1 + p % 7) for i in (3, 8, 9) for p in range(60)]
    items += [(3, 5, 5, 1)] * 12 + [(None, 1, 1, 1), (3, None, 1, 1), (8, 1, 1, None)]  # twelve on one pixel; nulls; image 9 is not listed
    got = {}
    for r in tables(spark, tmp_path, [3, 8, 8, 1000], items).px.collect():
        assert (r.image_id, r.y, r.x) not in got and (r.width, r.height) == (SIDE, SIDE)
        got[r.image_id, r.y, r.x] = (r.b, r.g, r.r, r.ring)
    assert got == {(i, *at): v for i in (3, 8, 1000) for at, v in pixels(i, items).items()}


def test_pixels_are_laid_out_and_not_grouped(spark, tmp_path):
    """Rows are grouped before images become pixels; after that a pixel is a few sums, however often its columns are used."""
    px = tables(spark, tmp_path, [3], [(3, 1, 1, 1)]).px
    text = px.where("b + g - 2 * r > 70").select("image_id", "y", "x")._jdf.queryExecution().executedPlan().toString()
    above, below = text.split("Generate posexplode", 1)
    assert "Aggregate" not in above and "Aggregate" in below
    assert len(above) < 6000  # rings are no longer written out in each use of a colour
