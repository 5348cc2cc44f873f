"""Uncertainty, review queues, cluster labels, task grids, rubric and overlays."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.plans.ranking import positions

# Display colours per predicted state.
STATE_COLORS = {"Resting": "Green", "Activated": "Red", "Resolution": "Yellow"}

# Morphological criteria per state.
RUBRIC = (
    ("Resting", ("circular",), ("small",), (0,), ("clear",), ("dark",)),
    ("Surveilling", ("circular", "spindle"), ("small", "medium"), (2,), ("clear",), ("dark",)),
    ("Activated", ("irregular",), ("small", "medium"), (2, 3), ("intermittent",), ("intermediate",)),
    ("Resolution", ("ameboid", "flat"), ("medium", "large"), (0,), ("clear",), ("bright",)),
)


def entropy(probs: str) -> Column:
    """-sum p ln p of an array column; p = 0 adds nothing."""
    return F.expr(f"-aggregate(transform({probs}, p -> case when p > 0 then p * ln(p) else 0D end), 0D, (a, t) -> a + t)")


def softmax(scores: str) -> Column:
    return F.expr(
        f"transform(transform({scores}, s -> exp(s)), (e, i) -> e / aggregate(transform({scores}, s -> exp(s)), 0D, (a, t) -> a + t))"
    )


def most_uncertain(df: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """Rows with ``flagged`` = among the top share by uncertainty (ties: lower key).

    Ranks come from bucket counts, and rows of equal uncertainty are cut by key, so neither the whole table nor
    a large tie is sorted in one task.
    """
    ranked = positions(
        df, [], [F.col("uncertainty").desc(), F.col(key)], -F.floor(F.col("uncertainty") * 65536), "rank",
        fine=F.struct(-F.col("uncertainty"), F.floor(F.col(key) / 65536)),
    )
    limit = math.ceil(Decimal(str(share)) * df.count())
    return ranked.withColumn("flagged", F.col("rank") <= limit)


def adjudication_queue(ranked: DataFrame, cluster_label: Column) -> DataFrame:
    """Flagged rows go to experts without a label; the rest take their cluster's label."""
    return ranked.select(
        "*",
        F.when(F.col("flagged"), "expert").otherwise("bulk").alias("route"),
        F.when(~F.col("flagged"), cluster_label).alias("assigned"),
    )


def latest_labels(events: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Newest label per cluster, with the ordering columns that made it newest."""
    newest = F.struct(*order)
    return events.groupBy("cluster_id").agg(
        F.max_by("label", newest).alias("label"), F.max(newest).alias("_o")
    ).select("cluster_id", "label", *[F.col(f"_o.{c}").alias(c) for c in order])


def apply_cluster_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One label per cluster updates every cell of the cluster and marks it verified."""
    joined = cells.join(labels.select("cluster_id", F.col("label").alias("_label")), "cluster_id", "left")
    return joined.select(
        *cells.columns,
        F.coalesce("_label", "state").alias("active_label"),
        F.col("_label").isNotNull().alias("is_verified"),
    )


def grid_tasks(cells: DataFrame, side: int = 10) -> DataFrame:
    """Cells of a cluster laid out in side x side grids, in cell order."""
    per = side * side
    placed = positions(cells, ["cluster_id"], [F.col("cell_id")], F.floor(F.col("cell_id") / 65536), "k")
    return placed.selectExpr(
        "cluster_id", "cell_id", f"(k - 1) div {per} as task", f"((k - 1) % {per}) div {side} as row", f"(k - 1) % {side} as col"
    )


def task_payloads(grid: DataFrame) -> DataFrame:
    """One row per task; a task holds at most side x side cells."""
    cell = F.struct("row", "col", "cell_id")
    return grid.groupBy("cluster_id", "task").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sort_array(F.collect_list(cell)).alias("cells")
    )


def rubric_label() -> Column:
    """State by shape, size, podia, boundary and brightness; cells without a soma are dystrophic."""
    out = F.when(~F.col("has_soma"), "Dystrophic")
    for state, shapes, sizes, podia, boundary, brightness in RUBRIC:
        rule = (
            F.col("shape").isin(*shapes) & F.col("size").isin(*sizes) & F.col("podia").isin(*podia)
            & F.col("boundary").isin(*boundary) & F.col("brightness").isin(*brightness)
        )
        out = out.when(rule, state)
    return out.otherwise("Unclear")


def prediction_overlay(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Predicted states as coloured slide boxes."""
    table = F.create_map(*[F.lit(v) for pair in STATE_COLORS.items() for v in pair])
    return cells.join(boxes, ["image_id", "cell_id"]).select(
        "image_id", "cell_id", "x1", "y1", "x2", "y2", "state", F.try_element_at(table, F.col("state")).alias("color")
    )
