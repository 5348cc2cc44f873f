"""Shape measures of pixel masks: box counting, lacunarity, ratios, branch ends, mask agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALES = (1, 2, 4, 8, 16)


def box_masses(mask: DataFrame, scales=SCALES) -> DataFrame:
    """Pixels per occupied box and scale; partial counts shrink the data before it is shuffled."""
    at_scale = mask.selectExpr("image_id", "y", "x", f"explode(array({', '.join(f'{s}L' for s in scales)})) as s")
    return at_scale.groupBy("image_id", "s", F.expr("floor(y / s)").alias("by"), F.expr("floor(x / s)").alias("bx")).agg(
        F.count(F.lit(1)).alias("mass")
    )


def fractal_dimension(mask: DataFrame, scales=SCALES) -> DataFrame:
    """Slope of log(number of occupied boxes) against log(1 / scale)."""
    counts = box_masses(mask, scales).groupBy("image_id", "s").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("image_id").agg(
        F.regr_slope(F.log(F.col("n").cast("double")), F.log(1 / F.col("s"))).alias("dimension")
    )


def lacunarity(mask: DataFrame, sizes: DataFrame, scales=SCALES) -> DataFrame:
    """Variance over squared mean of box mass per scale; empty boxes count (sizes: image_id, width, height)."""
    sums = box_masses(mask, scales).groupBy("image_id", "s").agg(
        F.sum("mass").alias("m1"), F.sum(F.col("mass") * F.col("mass")).alias("m2")
    )
    boxes = sums.join(sizes, "image_id").selectExpr("*", "ceil(width / s) * ceil(height / s) as nb")
    return boxes.selectExpr("image_id", "s", "(m2 / nb - (m1 / nb) * (m1 / nb)) / ((m1 / nb) * (m1 / nb)) as lacunarity")


def soma_cell_ratio(soma: DataFrame, cells: DataFrame) -> DataFrame:
    return cells.join(soma, ["image_id", "cell_id"]).selectExpr(
        "image_id", "cell_id", "soma_area", "cell_area", "soma_area / cell_area as ratio"
    )


def branch_endpoints(skeleton: DataFrame) -> DataFrame:
    """Skeleton length and number of pixels with exactly one of eight neighbours, per image.

    Each pixel adds itself to its neighbours' counts; one aggregate then holds both facts.
    """
    offsets = ", ".join(
        f"named_struct('dy', {dy}, 'dx', {dx}, 'me', {int(dy == dx == 0)})" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    )
    spread = skeleton.selectExpr("image_id", "y", "x", f"explode(array({offsets})) as o").selectExpr(
        "image_id", "y + o.dy as y", "x + o.dx as x", "o.me as me", "1 - o.me as other"
    )
    counts = spread.groupBy("image_id", "y", "x").agg(F.max("me").alias("me"), F.sum("other").alias("n"))
    return counts.where("me = 1").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("length"), F.count_if(F.col("n") == 1).alias("ends")
    )


def dice_iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per image Dice and IoU of two pixel sets, from one union and one count per pixel."""
    one, zero = F.lit(1), F.lit(0)
    both = predicted.select("image_id", "y", "x", one.alias("p"), zero.alias("t")).unionByName(
        truth.select("image_id", "y", "x", zero.alias("p"), one.alias("t"))
    )
    seen = both.groupBy("image_id", "y", "x").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    n = seen.groupBy("image_id").agg(
        F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("t")).alias("n_both")
    )
    return n.selectExpr("*", "2 * n_both / (n_pred + n_true) as dice", "n_both / (n_pred + n_true - n_both) as iou")


def boundary_f1(predicted: DataFrame, truth: DataFrame, tolerance: int = 2) -> DataFrame:
    """Boundary pixels matched within ``tolerance``: each side is grown once, then met by a merge join.

    Merge hints: the estimated size of grown pixels is that of the table they come from, and they would be broadcast through the driver.
    """
    disc = [
        (dy, dx)
        for dy in range(-tolerance, tolerance + 1)
        for dx in range(-tolerance, tolerance + 1)
        if dy * dy + dx * dx <= tolerance * tolerance
    ]
    offsets = ", ".join(f"named_struct('dy', {dy}, 'dx', {dx})" for dy, dx in disc)

    def matched(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
        near = (
            other.selectExpr("image_id", "y", "x", f"explode(array({offsets})) as o")
            .selectExpr("image_id", "y + o.dy as y", "x + o.dx as x")
            .distinct()
            .withColumn("hit", F.lit(1))
        )
        return (
            side.select("image_id", "y", "x")
            .join(near.hint("merge"), ["image_id", "y", "x"], "left")
            .groupBy("image_id")
            .agg(F.count(F.lit(1)).alias(f"n_{name}"), F.count("hit").alias(f"hit_{name}"))
        )

    both = matched(predicted, truth, "pred").join(matched(truth, predicted, "true"), "image_id", "full")
    filled = both.na.fill(0)
    scored = filled.selectExpr(
        "*", "case when n_pred > 0 then hit_pred / n_pred else 0D end as p", "case when n_true > 0 then hit_true / n_true else 0D end as r"
    )
    return scored.selectExpr("image_id", "p as precision", "r as recall", "case when p + r > 0 then 2 * p * r / (p + r) else 0D end as f1")
