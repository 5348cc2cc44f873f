"""Registered labelling, embedding and label-feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.registry import query
from cytoloom.functions import color as C
from cytoloom.operators import embeddings as E
from cytoloom.operators import labeling as L
from cytoloom.operators import pixels as P
from cytoloom.schemas import EVENT_LOG
from cytoloom.session import scratch_path
from cytoloom.sources.views import with_views
from cytoloom.streaming import label_sync as X

CELLS = with_views("cells")

UNCERTAIN = """with e as (select vec_id, label, [exp(list_sum([cast(embedding[i] as double) for i in range(k, 65, 5)])) for k in range(1, 6)] w from embeddings)
, u as materialized (select vec_id, label, round(-list_sum([(p / list_sum(w)) * ln(p / list_sum(w)) for p in w]), 9) uncertainty from e)
, ranked as materialized (select *, row_number() over (order by uncertainty desc, vec_id) "rank" from u)
, flags as materialized (select *, "rank" <= (select ceil(0.05 * count(*)) from u) flagged from ranked)\n"""


# Five class scores; each adds up every fifth value, so all values count.
SCORES = """transform(sequence(1, 5), k -> aggregate(sequence(k, 64, 5), 0d, (s, i) -> s + element_at(embedding, i))) as scores"""


def uncertain(v):
    probs = v.table("embeddings").selectExpr("vec_id", "label", SCORES)
    probs = probs.withColumn("probs", L.softmax("scores"))
    return probs.select("vec_id", "label", F.round(L.entropy("probs"), 9).alias("uncertainty"))


@query("prediction_entropy", UNCERTAIN + "select vec_id, round(uncertainty, 6) entropy from u")
def _entropy(v):
    return uncertain(v).select("vec_id", F.round("uncertainty", 6).alias("entropy"))


@query("uncertainty_topk", UNCERTAIN + 'select vec_id, "rank" from flags where flagged')
def _topk(v):
    return L.most_uncertain(uncertain(v), "vec_id").where("flagged").select("vec_id", "rank")


@query(
    "adjudication_queue",
    UNCERTAIN
    + "select vec_id, case when flagged then 'expert' else 'bulk' end route, case when not flagged then concat('state_', label) end assigned from flags",
)
def _queue(v):
    ranked = L.most_uncertain(uncertain(v), "vec_id")
    label = F.concat(F.lit("state_"), F.col("label").cast("string"))
    return L.adjudication_queue(ranked, label).select("vec_id", "route", "assigned")


@query(
    "grid_tasks",
    CELLS
    + """, k as (select cluster_id, cell_id, row_number() over (partition by cluster_id order by cell_id) - 1 k from cells)
select cluster_id, k // 100 task, count(*) n_cells, string_agg(concat_ws(':', k % 100 // 10, k % 10, cell_id), ',' order by k) cells
from k group by all""",
)
def _tasks(v):
    tasks = L.task_payloads(L.grid_tasks(v.cells.select("cluster_id", "cell_id")))
    text = F.transform("cells", lambda c: F.concat_ws(":", *[c[n].cast("string") for n in ("row", "col", "cell_id")]))
    return tasks.select("cluster_id", "task", "n_cells", F.array_join(text, ",").alias("cells"))


LABELLED = (
    CELLS
    + """, feed as (select event_id % 7 cluster_id, event_type label, ts, event_id from events)
, newest as (select cluster_id, arg_max(label, (ts, event_id)) label from feed group by all)
select image_id, cell_id, c.cluster_id, coalesce(n.label, state) active_label, n.label is not null is_verified
from cells c left join newest n using (cluster_id)"""
)


def feed_columns(df):
    return df.selectExpr("event_id % 7 as cluster_id", "event_type as label", "ts", "event_id")


def cell_states(v):
    return v.cells.select("image_id", "cell_id", "cluster_id", "state")


@query("cluster_label_apply", LABELLED)
def _apply(v):
    newest = L.latest_labels(feed_columns(v.table("events")), ("ts", "event_id"))
    return L.apply_cluster_labels(cell_states(v), newest).drop("state")


@query("label_sync_stream", LABELLED)
def _stream(v):
    """The event log read as a stream; the state after all events have arrived."""
    spark = v.spark
    table, progress = scratch_path(spark, "labels"), scratch_path(spark, "labels-progress")
    events = spark.readStream.schema(EVENT_LOG).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    X.wait(X.sync_labels(feed_columns(events), table, progress, ("ts", "event_id")))
    return X.synced_cells(cell_states(v), table, ("ts", "event_id")).drop("state")


TRAITS = {
    "shape": "case x % 5 when 0 then 'circular' when 1 then 'spindle' when 2 then 'irregular' when 3 then 'ameboid' else 'flat' end",
    "size": "case y % 3 when 0 then 'small' when 1 then 'medium' else 'large' end",
    "podia": "case when x % 5 = 1 then 2 when x % 5 = 2 then 2 + cell_id % 2 else 0 end",
    "boundary": "case when x % 5 = 2 then 'intermittent' else 'clear' end",
    "brightness": "case when x % 5 = 2 then 'intermediate' when x % 5 > 2 then 'bright' else 'dark' end",
    "has_soma": "cell_id % 11 <> 0",
}


@query(
    "rubric_label",
    CELLS
    + ", t as (select image_id, cell_id, "
    + ", ".join(f'{e} "{n}"' for n, e in TRAITS.items())
    + """ from cells)
select image_id, cell_id, case when not has_soma then 'Dystrophic'
 when shape = 'circular' and "size" = 'small' and podia = 0 and boundary = 'clear' and brightness = 'dark' then 'Resting'
 when shape in ('circular', 'spindle') and "size" in ('small', 'medium') and podia = 2 and boundary = 'clear' and brightness = 'dark' then 'Surveilling'
 when shape = 'irregular' and "size" in ('small', 'medium') and podia in (2, 3) and boundary = 'intermittent' and brightness = 'intermediate' then 'Activated'
 when shape in ('ameboid', 'flat') and "size" in ('medium', 'large') and podia = 0 and boundary = 'clear' and brightness = 'bright' then 'Resolution'
 else 'Unclear' end label from t""",
)
def _rubric(v):
    traits = v.cells.selectExpr("image_id", "cell_id", *[f"{e} as {n}" for n, e in TRAITS.items()])
    return traits.select("image_id", "cell_id", L.rubric_label().alias("label"))


@query(
    "prediction_overlay",
    CELLS
    + """select image_id, cell_id, x x1, y y1, x + 64 x2, y + 64 y2, state,
 case state when 'Resting' then 'Green' when 'Activated' then 'Red' when 'Resolution' then 'Yellow' end color from cells""",
)
def _overlay(v):
    boxes = v.cells.selectExpr("image_id", "cell_id", "x as x1", "y as y1", "x + 64 as x2", "y + 64 as y2")
    return L.prediction_overlay(v.cells.select("image_id", "cell_id", "state"), boxes)


# ---- embeddings ------------------------------------------------------------------------------------------


@query("embed_batch")
def _embed(v):
    gray = P.add(v.px, gray=C.gray()).select("image_id", "y", "x", "gray")
    centred = v.px_cells.selectExpr("image_id", "struct(cell_id, cx, cy) as cell_id", "x", "y", "w", "h")
    offsets = P.pixels_in_boxes(gray, centred, together=True).selectExpr(
        "image_id", "cell_id.cell_id", "y - cell_id.cy as dy", "x - cell_id.cx as dx", "gray"
    )
    size = 24 * 24
    scored = E.embed_batch(E.crop_vectors(offsets, 24), E.random_projection(size), size, 768)
    return scored.selectExpr("image_id", "cell_id", "size(embedding) as dims", "round(embedding[0], 3) as first")


@query("reduce_dims")
def _reduce(v):
    flat = E.reduce_dims(v.table("embeddings"), "vec_id")
    return flat.selectExpr("vec_id", "round(point[0], 6) as p1", "round(point[1], 6) as p2")


@query("kmeans_clusters")
def _kmeans(v):
    return E.kmeans_clusters(v.table("embeddings"), "vec_id", k=10)
