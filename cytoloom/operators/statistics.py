"""Counts, indices, correlation, classification and detection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.functions.geometry import box_area, intersection_area
from cytoloom.plans.ranking import running_totals
from cytoloom.plans.spatial import near_pairs

# Cell states and their weights in the activation index.
STATES = ("Resting", "Surveilling", "Activated", "Resolution", "Dystrophic")
WEIGHTS = {"Activated": 1.0, "Surveilling": 0.6, "Resolution": 0.3, "Dystrophic": 1.0}


def state_counts(cells: DataFrame) -> DataFrame:
    counted = cells.groupBy("image_id").pivot("state", list(STATES)).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


def activation_index(cells: DataFrame) -> DataFrame:
    """Weighted share of active states per image; counts stay whole numbers until the last step."""
    tenths = F.sum(
        F.expr("case state " + " ".join(f"when '{s}' then {round(w * 10)}L" for s, w in WEIGHTS.items()) + " else 0L end")
    )
    return cells.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_cells"), (tenths / (10 * F.count(F.lit(1)))).alias("activation_index")
    )


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, col: str, bucket: Column) -> DataFrame:
    """Value -> average rank, from one count per distinct value."""
    counts = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = running_totals(counts, [], "v", bucket, {"upto": "c"})
    return upto.selectExpr(f"v as {col}", f"upto - c + (c + 1) / 2 as rank_{col}")


def spearman(df: DataFrame, a: str, b: str, buckets: dict[str, Column]) -> DataFrame:
    """Rank correlation with average ranks for ties; ``buckets`` give a rising bucket of value ``v`` per column."""
    ranked = df.join(average_ranks(df, a, buckets[a]), a).join(average_ranks(df, b, buckets[b]), b)
    return ranked.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"), F.count(F.lit(1)).alias("n"))


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F. Squared deviations come from merged variances per group and overall, so large values cost no digits."""
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).rollup(group).agg(
        F.count(F.lit(1)).alias("n"), (F.var_pop(v) * F.count(F.lit(1))).alias("squares"), F.grouping(group).alias("whole")
    )
    group_row = F.col("whole") == 0
    total = per.agg(
        F.count_if(group_row).alias("k"), F.sum(F.when(group_row, F.col("n"))).alias("n"),
        F.sum(F.when(group_row, F.col("squares"))).alias("within"), F.max(F.when(~group_row, F.col("squares"))).alias("every"),
    )
    return total.selectExpr("k", "n", "((every - within) / (k - 1)) / (within / (n - k)) as f")


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, and their macro means, from the confusion matrix."""
    sides = matrix.selectExpr(
        "explode(array(named_struct('c', truth, 't', n, 'p', 0L), named_struct('c', predicted, 't', 0L, 'p', n))) as e",
        "truth", "predicted", "n",
    )
    per = sides.groupBy(F.col("e.c").alias("class")).agg(
        F.sum("e.t").alias("n_true"),
        F.sum("e.p").alias("n_pred"),
        F.sum(F.when((F.col("truth") == F.col("predicted")) & (F.col("e.t") > 0), F.col("n")).otherwise(0)).alias("hit"),
    )
    scored = per.selectExpr(
        "class", "case when n_pred > 0 then hit / n_pred else 0D end as p", "case when n_true > 0 then hit / n_true else 0D end as r"
    ).selectExpr("class", "p", "r", "case when p + r > 0 then 2 * p * r / (p + r) else 0D end as f1")
    macro = scored.agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1")).selectExpr("'macro' as class", "*")
    return scored.unionByName(macro)


def average_precision(predictions: DataFrame, truth: DataFrame, bucket: Column, limit: float = 0.5) -> DataFrame:
    """Average precision at an IoU limit, over all images.

    Each prediction goes to its best-overlapping truth box; of the predictions of one truth box the highest
    score is the hit. Equal scores count as one threshold, so the curve needs one row per distinct score.
    """
    inter = intersection_area()
    iou = inter / (box_area("a_") + box_area("b_") - inter)
    pairs = near_pairs(predictions, truth, where=iou >= limit)
    best = pairs.groupBy("image_id", F.col("a_j").alias("j")).agg(
        F.max_by("b_j", F.struct(iou.alias("iou"), (-F.col("b_j")).alias("k"))).alias("t"), F.max("a_score").alias("score")
    )
    hits = best.groupBy("image_id", "t").agg(F.max_by("score", F.struct("score", -F.col("j"))).alias("score"))
    zero = F.lit(0).cast("long")
    curve = (
        predictions.groupBy("score").agg(F.count(F.lit(1)).alias("n"), zero.alias("tp"))
        .unionByName(hits.groupBy("score").agg(zero.alias("n"), F.count(F.lit(1)).alias("tp")))
        .groupBy("score")
        .agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    )
    total = running_totals(curve, [], "score", bucket, {"n_up": "n", "tp_up": "tp"}, descending=True)
    area = total.agg(
        F.sum(F.col("tp") * (F.col("tp_up") / F.col("n_up"))).alias("area"), F.sum("tp").alias("hits"), F.sum("n").alias("n_pred")
    ).withColumn("n_true", zero)
    n_true = truth.agg(F.count(F.lit(1)).alias("n_true")).selectExpr("0D as area", "0L as hits", "0L as n_pred", "n_true")
    both = area.unionByName(n_true).agg(*[F.sum(c).alias(c) for c in ("area", "hits", "n_pred", "n_true")])
    return both.selectExpr("n_pred", "n_true", "hits", "area / n_true as average_precision")


def cluster_profile(members: DataFrame, cluster: str, dense: int) -> DataFrame:
    """Size and share per cluster, and the share of members in clusters of at least ``dense``.

    The window runs over one row per cluster.
    """
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy(F.lit(0))
    totals = sizes.select(
        cluster,
        "size",
        F.sum("size").over(every).alias("total"),
        F.sum(F.when(F.col("size") >= dense, F.col("size")).otherwise(0)).over(every).alias("in_dense"),
    )
    return totals.selectExpr(cluster, "size", "size / total as share", "in_dense / total as dense_share")


def auc_roc(df: DataFrame, score: str, positive: str, bucket: Column) -> DataFrame:
    """Area under ROC by the rank-sum rule; one row per distinct score, ties count one half."""
    counts = df.groupBy(F.col(score).alias("v")).agg(
        F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg")
    )
    upto = running_totals(counts, [], "v", bucket, {"neg_upto": "neg"})
    sums = upto.agg(
        F.sum(F.expr("pos * (neg_upto - neg) + pos * neg / 2")).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    return sums.selectExpr("n_pos", "n_neg", "u / (n_pos * n_neg) as auc")
