"""Registered statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.regions import ENDS, PTS
from cytoloom.catalog.registry import query
from cytoloom.operators import contours as T
from cytoloom.operators import statistics as S
from cytoloom.sources.views import with_views

CELLS = with_views("cells")
INDEX = (
    CELLS
    + """, idx as materialized (select image_id, any_value(dose) dose, count(*) n_cells, sum(case state when 'Activated' then 10 when 'Surveilling' then 6
  when 'Resolution' then 3 when 'Dystrophic' then 10 else 0 end) / (10 * count(*)) activation_index from cells group by all)\n"""
)


def index(v):
    dose = v.cells.groupBy("image_id").agg(F.max("dose").alias("dose"))
    return S.activation_index(v.cells).join(dose, "image_id")


@query(
    "contour_stats",
    PTS
    + ENDS
    + """, t as (select image_id, count(distinct contour_id) total_contours from contour_pts group by all)
, e as (select image_id, count(*) long_contours, count(*) filter (d2 between 4 and 900) gaps_closed from ends group by all)
select t.image_id, total_contours, coalesce(long_contours, 0) long_contours, coalesce(gaps_closed, 0) gaps_closed from t left join e using (image_id)""",
)
def _contour_stats(v):
    total = T.bounding_boxes(v.contour_pts).groupBy("image_id").agg(F.count(F.lit(1)).alias("total_contours"))
    ends = T.endpoints(v.contour_pts).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("long_contours"), F.expr("count_if(d2 between 4 and 900) as gaps_closed")
    )
    return total.join(ends, "image_id", "left").na.fill(0)


@query(
    "state_counts",
    CELLS + "select image_id, " + ", ".join(f"count(*) filter (state = '{s}') \"{s}\"" for s in S.STATES) + " from cells group by all",
)
def _states(v):
    return S.state_counts(v.cells)


@query("activation_index", INDEX + "select image_id, n_cells, round(activation_index, 6) activation_index from idx")
def _activation(v):
    return S.activation_index(v.cells).withColumn("activation_index", F.round("activation_index", 6))


@query("pearson", INDEX + "select round(corr(activation_index, dose), 6) r, count(*) n from idx")
def _pearson(v):
    return S.pearson(index(v), "activation_index", "dose").withColumn("r", F.round("r", 6))


@query(
    "spearman",
    INDEX
    + """, r as (select rank() over (order by activation_index) + (count(*) over (partition by activation_index) - 1) / 2 a,
  rank() over (order by dose) + (count(*) over (partition by dose) - 1) / 2 b from idx)
select round(corr(a, b), 6) rho, count(*) n from r""",
)
def _spearman(v):
    buckets = {"activation_index": F.floor(F.col("v") * 4096), "dose": F.col("v")}
    return S.spearman(index(v), "activation_index", "dose", buckets).withColumn("rho", F.round("rho", 6))


@query(
    "anova_f",
    INDEX
    + """, g as (select dose, count(*) n, avg(activation_index) m from idx group by all), m as (select avg(activation_index) m from idx)
select (select count(*) from g) k, (select count(*) from idx) n, round(((select sum(g.n * (g.m - m.m) * (g.m - m.m)) from g, m) / ((select count(*) from g) - 1))
  / ((select sum((i.activation_index - g.m) * (i.activation_index - g.m)) from idx i join g using (dose)) / ((select count(*) from idx) - (select count(*) from g))), 6) f""",
)
def _anova(v):
    return S.anova_f(index(v), "dose", "activation_index").withColumn("f", F.round("f", 6))


PREDICTED = "case when cell_id % 4 = 0 then 'Resting' when cell_id % 9 = 0 then 'Activated' else state end"
MATRIX = CELLS + f", m as materialized (select state truth, {PREDICTED} predicted, count(*) n from cells group by all)\n"


def matrix(v):
    return S.confusion_matrix(v.cells.withColumn("guess", F.expr(PREDICTED)), "state", "guess")


@query("confusion_matrix", MATRIX + "select truth, predicted, n from m")
def _confusion(v):
    return matrix(v)


@query(
    "per_class_prf",
    MATRIX
    + """, c as (select distinct truth class from m), s as (select class,
  coalesce((select sum(n) from m where predicted = class and truth = class), 0) / (select sum(n) from m where predicted = class) p,
  coalesce((select sum(n) from m where predicted = class and truth = class), 0) / (select sum(n) from m where truth = class) r from c)
, f as (select class, coalesce(p, 0) p, r, case when p + r > 0 then 2 * p * r / (p + r) else 0 end f1 from s)
select class, round(p, 6) "precision", round(r, 6) recall, round(f1, 6) f1 from f
union all select 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6) from f""",
)
def _prf(v):
    s = S.per_class_scores(matrix(v))
    return s.select("class", *[F.round(c, 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f1", "f1"))])


IOU = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"


@query(
    "map_at_50",
    with_views("boxes")
    + f""", p as materialized (select image_id, j, x + j % 9 x, y + j % 7 y, w, h, (area * 7 + j % 13) % 5000 score from boxes)
, c as (select a.image_id, a.j, a.score, b.j t, {IOU} / (a.w * a.h + b.w * b.h - {IOU}) iou from p a join boxes b on a.image_id = b.image_id
  and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
, best as (select * from c where iou >= 0.5 qualify row_number() over (partition by image_id, j order by iou desc, t) = 1)
, hits as (select * from best qualify row_number() over (partition by image_id, t order by score desc, j) = 1)
, k as (select score, sum(n) n, sum(tp) tp from (select score, 1 n, 0 tp from p union all select score, 0, 1 from hits) group by all)
, r as (select *, sum(n) over (order by score desc) nu, sum(tp) over (order by score desc) tu from k)
select cast((select count(*) from p) as bigint) n_pred, cast((select count(*) from boxes) as bigint) n_true, cast(sum(tp) as bigint) hits,
  round(sum(tp * (tu / nu)) / (select count(*) from boxes), 6) average_precision from r""",
)
def _map(v):
    predictions = v.boxes.selectExpr(
        "image_id", "j", "x + j % 9 as x", "y + j % 7 as y", "w", "h", "(area * 7 + j % 13) % 5000 as score"
    )
    truth = v.boxes.select("image_id", "j", "x", "y", "w", "h")
    out = S.average_precision(predictions, truth, F.floor(F.col("score") / 64))
    return out.withColumn("average_precision", F.round("average_precision", 6))


@query(
    "cluster_profile",
    """with s as (select cast(label as bigint) cluster_id, count(*) size from embeddings group by all)
select cluster_id, size, round(size / sum(size) over (), 6) share,
  round(sum(case when size >= 50 then size else 0 end) over () / sum(size) over (), 6) dense_share from s""",
)
def _profile(v):
    members = v.table("embeddings").selectExpr("cast(label as bigint) as cluster_id")
    out = S.cluster_profile(members, "cluster_id", 50)
    return out.withColumns({"share": F.round("share", 6), "dense_share": F.round("dense_share", 6)})


@query(
    "auc_roc",
    """with d as (select n_chars s, quality q from labels join documents using (doc_id))
, r as (select q, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 rk from d)
, t as (select sum(q) p, count(*) - sum(q) n, sum(rk) filter (q = 1) rs from r)
select cast(p as bigint) n_pos, cast(n as bigint) n_neg, round((rs - p * (p + 1) / 2) / (p * n), 6) auc from t""",
)
def _auc(v):
    scored = v.table("labels").join(v.table("documents").select("doc_id", "n_chars"), "doc_id")
    return S.auc_roc(scored, "n_chars", "quality", F.floor(F.col("v") / 256)).withColumn("auc", F.round("auc", 6))
