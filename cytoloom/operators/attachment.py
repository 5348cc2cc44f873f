"""Duplicates and legs in candidate order, with bodies that grow as legs join them.

The rule, as a relation. Boxes of an image have their turn by number ``j``. On its turn a box is dropped if some other box is its *partner*: a larger one that covers most of
it (duplicate), or, for a small box, a large one that it touches (leg). The lowest partner counts. A leg joins its partner: the partner's outline becomes the
convex hull of both, its box and area those of the hull. Everything is judged by the outlines at that turn.

So a box depends on others only through legs with lower numbers. Given any set of joins, all outlines at all turns follow (prefix hulls per body), and from them
the partner of every box. A set of joins that reproduces itself is the only one that does, by induction over the numbers: the first box depends on none, each later one
only on those before. Evaluation therefore goes in waves: start from untouched outlines, derive joins, and repeat until they stay; each wave settles
at least the next box of every chain of dependencies, in practice two or three waves settle all. No wave walks a cluster box by box, and
however large a cluster is, its boxes are rows of one join.

Growing only helps: a partner's hull, box and area never shrink, so who was a partner stays one. Pairs are looked up once on untouched
boxes, and each wave only adds pairs with bodies that have grown, at the last state before the turn.

Boxes are folded by shape wherever pairs are formed. The states of one body are made in one task that holds one hull; that is one row per
leg of the body that changes it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.operators.boxes import DUPLICATE_SHARE, LARGE, REACH, SHAPE, SMALL, TOUCH, duplicate_of, first_partner, fold_boxes, hull_of, leg_of, twice_area
from cytoloom.operators.contours import convex_hull
from cytoloom.plans.spatial import near_pairs
from cytoloom.session import written

BOX = ["x", "y", "w", "h", "area"]
#: Side of the grid cells in which pairs are looked up: boxes of up to some hundred pixels then lie in one or two, so few copies are shuffled.
CELL = 256
#: Before any turn.
START = -(1 << 62)
_STATES = "image_id long, body long, since long, x long, y long, w long, h long, area double"


def _corners():
    right, low = F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x in (F.col("x"), right) for y in (F.col("y"), low)])


def _outlines(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, j, pts): hull vertices of each box's contour."""
    wanted = boxes.select("image_id", F.col("j").alias("contour_id"))
    hulls = convex_hull(points.select("image_id", "contour_id", "x", "y").join(wanted, ["image_id", "contour_id"], "left_semi"))
    return hulls.groupBy("image_id", F.col("contour_id").alias("j")).agg(F.collect_list(F.struct("x", "y")).alias("pts"))


def _prefix_hulls(frames):
    """Rows sorted by (image_id, body, since), the body's own outline first -> its state after each leg that changes it."""
    key, hull, box = None, [], None
    for frame in frames:
        out = []
        for image, body, since, pts, area in zip(*(frame[c] for c in ("image_id", "body", "since", "pts", "area")), strict=True):
            added = [(int(p["x"]), int(p["y"])) for p in pts]
            if (image, body) != key:
                key, hull, box = (image, body), hull_of(added), (None, float(area))
                continue
            hull = hull_of(hull + added)
            xs, ys = [p[0] for p in hull], [p[1] for p in hull]
            # A contour's area is at most that of its hull; where only boxes are known, the area never falls.
            size = max(box[1], twice_area(hull) / 2.0)
            now = (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
            if (now, size) != box:
                box = (now, size)
                out.append((image, body, since, *now, size))
        yield pd.DataFrame(out, columns=["image_id", "body", "since", *BOX])


def body_states(joins: DataFrame, boxes: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """``joins(image_id, j, partner)`` -> (image_id, body, since, box, area): a state holds for turns after ``since``.

    Bodies and legs meet the boxes in one join; corners are made after it, so that they are not shuffled for boxes that take no part.
    """
    bodies = joins.select("image_id", F.col("partner").alias("j")).distinct().select("*", F.col("j").alias("body"), F.lit(START).alias("since"))
    legs = joins.select("image_id", "j", F.col("partner").alias("body"), F.col("j").alias("since"))
    parts = bodies.unionByName(legs).join(boxes.select("image_id", "j", *BOX), ["image_id", "j"])
    held = parts.withColumn("pts", _corners()) if outlines is None else parts.join(outlines, ["image_id", "j"])
    ready = held.select("image_id", "body", "since", "pts", F.when(F.col("since") == START, F.col("area")).alias("area"))
    return ready.repartition("image_id", "body").sortWithinPartitions("image_id", "body", "since").mapInPandas(_prefix_hulls, _STATES)


def _at_turn(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """Replaces the partner's box (``b_``) by its last state before the turn ``a_j``; pairs without one are dropped."""
    columns = pairs.columns
    box = [f"b_{c}" for c in BOX]
    asked = pairs.select("*", F.col("a_j").alias("_turn"), F.lit(0).alias("_state"), F.lit(None).cast("struct<x:bigint,y:bigint,w:bigint,h:bigint,area:double>").alias("_s"))
    given = states.select(
        "image_id", F.col("body").alias("b_j"), F.col("since").alias("_turn"), F.lit(1).alias("_state"), F.struct(*BOX).alias("_s")
    )
    both = asked.unionByName(given, allowMissingColumns=True)
    before = Window.partitionBy("image_id", "b_j").orderBy("_turn", "_state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).where("_state = 0 and _s is not null")
    return found.select(*[c for c in columns if c not in box], *[F.col(f"_s.{c}").alias(f"b_{c}") for c in BOX])


def _members(shapes: DataFrame, copies: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per box of each shape: a shape that comes once (``a_n`` = 1) is its box ``a_j``, only others meet the ``copies``.

    ``names``: what the shape's columns image_id, x, y, w, h, area are called in ``shapes``.
    """
    some = copies.select(*[F.col(c).alias(names.get(c, c)) for c in SHAPE], F.col("j").alias("a_j"))
    many = shapes.where("a_n > 1").drop("a_j", "a_n").join(some, [names.get(c, c) for c in SHAPE])
    return shapes.where("a_n = 1").drop("a_n").unionByName(many)


def _decide(copies: DataFrame, folded: DataFrame, base: DataFrame, states: DataFrame) -> DataFrame:
    """(image_id, j, partner, kind) given the bodies' states."""
    dup, leg = duplicate_of(DUPLICATE_SHARE), leg_of(TOUCH, REACH, SMALL, LARGE)
    kind = F.when(dup, "duplicate").when(leg, "leg")
    final = states.groupBy("image_id", F.col("body").alias("j")).agg(F.max_by(F.struct(*BOX), "since").alias("s"))
    final = written(final.select("image_id", "j", *[F.col(f"s.{c}").alias(c) for c in BOX]), "bodies")
    own = states.where("since < body").groupBy("image_id", F.col("body").alias("j")).agg(F.max_by(F.struct(*BOX), "since").alias("s"))
    own = written(own.select("image_id", "j", *[F.col(f"s.{c}").alias(c) for c in BOX]), "own-states")

    met = _members(near_pairs(folded, final, reach=REACH, cell=CELL, where=dup | leg), copies, {c: f"a_{c}" for c in BOX}).where("a_j <> b_j")
    met = met.join(own.select("image_id", F.col("j").alias("a_j")), ["image_id", "a_j"], "left_anti")
    whole = near_pairs(own, final, reach=REACH, cell=CELL, where=dup & (F.col("a_j") != F.col("b_j")))
    columns = ["image_id", *[f"a_{c}" for c in (*BOX, "j")], *[f"b_{c}" for c in (*BOX, "j")]]
    grown = _at_turn(met.select(*columns).unionByName(whole.select(*columns)), states)
    grown = grown.select("image_id", F.col("a_j").alias("j"), F.col("b_j").alias("partner"), F.lit(0).alias("late"), kind.alias("kind"))
    plain = near_pairs(own, folded, reach=REACH, cell=CELL, where=dup & (F.col("a_j") != F.col("b_j"))).select(
        "image_id", F.col("a_j").alias("j"), F.col("b_j").alias("partner"), F.lit(1).alias("late"), F.lit("duplicate").alias("kind")
    )
    kept = base.join(own.select("image_id", "j"), ["image_id", "j"], "left_anti").withColumn("late", F.lit(1))
    every = grown.where("kind is not null").unionByName(plain).unionByName(kept)
    best = every.groupBy("image_id", "j").agg(F.min(F.struct("partner", "late", "kind")).alias("m"))
    return best.select("image_id", "j", "m.partner", "m.kind")


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images whose joins are not the same in both."""
    both = before.unionByName(after).groupBy("image_id", "j", "partner").agg(F.count(F.lit(1)).alias("n"))
    return both.where("n = 1").select("image_id").distinct()


def dup_leg_in_order(boxes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Boxes that stay, with box, area and number of legs as they are on their own turn.

    ``points(image_id, contour_id, x, y)`` are the contours of the boxes (contour_id = j); without them a box counts as its corners.
    Images do not depend on each other, so a wave takes only those that have legs, and whose joins the wave before has changed.
    """
    boxes = written(boxes.select("image_id", "j", "x", "y", "w", "h", F.col("area").cast("double").alias("area")), "boxes")
    folded = written(fold_boxes(boxes), "folded-boxes")
    outlines = None if points is None else written(_outlines(boxes, points), "outlines")
    # Shapes that come more than once are stored by themselves: where they are few, they find their boxes without a shuffle of all.
    copied = written(folded.where("n > 1").select(*SHAPE), "copied-shapes")
    copies = written(boxes.join(copied, SHAPE, "left_semi"), "copies")
    first = written(first_partner(boxes, folded=folded, cell=CELL), "first-shapes")
    base = _members(first, copies, {c: f"a_{c}" for c in BOX}).select("image_id", F.col("a_j").alias("j"), "partner", "kind")
    base = written(base, "first-partners")

    def legs_of(decided: DataFrame) -> DataFrame:
        return decided.where("kind = 'leg'").select("image_id", "j", "partner")

    joins = legs_of(base)
    moving = written(joins.select("image_id").distinct(), "moving-images")
    settled, bodies = [base.join(moving, "image_id", "left_anti")], []
    open_boxes, open_folded, open_base = boxes, folded, base
    while not moving.isEmpty():
        open_boxes, open_folded, open_base = (df.join(moving, "image_id", "left_semi") for df in (open_boxes, open_folded, open_base))
        states = written(body_states(joins, open_boxes, outlines), "body-states")
        decided = written(_decide(copies, open_folded, open_base, states), "partners")
        still = written(_changed(joins, legs_of(decided)), "moving-images")
        settled.append(decided.join(still, "image_id", "left_anti"))
        bodies.append(states.join(still, "image_id", "left_anti"))
        joins, moving = legs_of(decided).join(still, "image_id", "left_semi"), still
    decided = reduce(DataFrame.unionByName, settled)
    stay = boxes.join(decided.select("image_id", "j"), ["image_id", "j"], "left_anti")
    if not bodies:
        return stay.withColumn("legs", F.lit(0).cast("long"))
    states, joins = reduce(DataFrame.unionByName, bodies), legs_of(decided)
    own = states.where("since < body").groupBy("image_id", F.col("body").alias("j")).agg(F.max_by(F.struct(*BOX), "since").alias("s"))
    legs = joins.where("j < partner").groupBy("image_id", F.col("partner").alias("j")).agg(F.count(F.lit(1)).alias("legs"))
    out = stay.join(own, ["image_id", "j"], "left").join(legs, ["image_id", "j"], "left")
    return out.select(
        "image_id", "j", *[F.coalesce(f"s.{c}", c).alias(c) for c in BOX], F.coalesce("legs", F.lit(0).cast("long")).alias("legs")
    )
