"""Registered graph queries over contour endpoints, cells and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.regions import ENDS, PTS
from cytoloom.catalog.registry import greedy_sql, query
from cytoloom.operators import contours as T
from cytoloom.operators import graph as G
from cytoloom.sources.views import with_views

OPEN = (
    PTS
    + ENDS
    + """, tips as materialized (select image_id, contour_id * 2 node, ax x, ay y from ends where not d2 between 4 and 900
  union all select image_id, contour_id * 2 + 1, bx, "by" from ends where not d2 between 4 and 900)\n"""
)
CELL = with_views("cells") + ", nodes as materialized (select image_id, cell_id node, x, y, state from cells)\n"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def folded_sql(source: str) -> str:
    return f", spots as materialized (select image_id, x, y, min(node) node, count(*) n from {source} group by all)\n"


def pair_sql(radius: int, count: str) -> str:
    return f"""select a.image_id, a.node a_node, b.node b_node, {D2} d2, a.n * b.n {count} from spots a
  join spots b on a.image_id = b.image_id and a.node < b.node and {D2} <= {radius * radius}
 union all select image_id, node, node, 0, n * (n - 1) // 2 from spots where n > 1"""


def tips(v):
    return T.open_endpoints(T.endpoints(v.contour_pts))


def nodes(v):
    return v.cells.selectExpr("image_id", "cell_id as node", "x", "y", "state")


@query("endpoint_pairs", OPEN + folded_sql("tips") + pair_sql(30, "n_pairs"))
def _pairs(v):
    return G.location_pairs(tips(v), 30)


MATCH_SQL = (
    OPEN.replace("with ", "with recursive ", 1)
    + f""", it as materialized (select (a.node, b.node) id, a.image_id, a.node i, b.node j, {D2} d2 from tips a join tips b
  on a.image_id = b.image_id and a.node < b.node and {D2} <= 900)
, cf as materialized (select a.id win, b.id lose from it a join it b on a.image_id = b.image_id
  and (a.i = b.i or a.i = b.j or a.j = b.i or a.j = b.j) and (a.d2, a.i, a.j) < (b.d2, b.i, b.j))\n"""
    + greedy_sql("it", "cf")
    + "select image_id, i, j, d2 from it join settled using (id) where s = 1"
)


@query("greedy_endpoint_match", MATCH_SQL)
def _match(v):
    return G.greedy_match(tips(v), 30)


@query("proximity_edges", CELL + folded_sql("nodes") + pair_sql(70, "n_edges"))
def _edges(v):
    return G.proximity_edges(nodes(v), G.pixel_radius(35, 0.5))


@query(
    "knn_edges",
    CELL
    + f"""select a.image_id, a.node, b.node neighbour, {D2} d2, row_number() over (partition by a.image_id, a.node order by {D2}, b.node) "rank"
from nodes a join nodes b on a.image_id = b.image_id and a.node <> b.node and {D2} <= 4900
qualify row_number() over (partition by a.image_id, a.node order by {D2}, b.node) <= 3""",
)
def _knn(v):
    return G.knn_edges(nodes(v), 70, 3)


@query(
    "gabriel_edges",
    CELL
    + folded_sql("nodes")
    + f""", e as materialized (select a.image_id, a.node a_node, b.node b_node, {D2} d2, a.x + b.x sx, a.y + b.y sy from spots a join spots b
  on a.image_id = b.image_id and a.node < b.node and {D2} <= 4900)
select image_id, a_node, b_node, d2 from e where not exists (select 1 from spots c where c.image_id = e.image_id
  and (2 * c.x - e.sx) * (2 * c.x - e.sx) + (2 * c.y - e.sy) * (2 * c.y - e.sy) < e.d2)""",
)
def _gabriel(v):
    return G.gabriel_edges(nodes(v), 70)


@query(
    "fragment_reconnect",
    CELL.replace("with ", "with recursive ", 1)
    + f""", near as materialized (select a.image_id, a.node a, b.node b from nodes a join nodes b on a.image_id = b.image_id and a.node <> b.node and {D2} <= 4900)
, cc (node, image_id, l) using key (node) as (select node, image_id, node from nodes union
  (select k.b, any_value(k.image_id), min(c.l) from cc c join near k on k.a = c.node join recurring.cc o on o.node = k.b where c.l < o.l group by k.b))
select n.image_id, l cell, count(*) n_nodes, count(*) filter (state <> 'Dystrophic') n_soma from cc join nodes n using (node) group by all""",
)
def _reconnect(v):
    return (
        G.fragment_reconnect(nodes(v), 70)
        .groupBy("image_id", "cell")
        .agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("state") != "Dystrophic").alias("n_soma"))
    )


# Projections on two fixed vectors of +1 and -1 over all 64 values, in whole numbers.
PROJECT = (
    "cast(floor(list_sum([(1 - 2 * ({sign})) * cast(floor(cast(embedding[i] as double) * 1000) as bigint) for i in range(1, 65)]) / 8.0) as bigint)"
)
PROJECTION = (
    "floor(aggregate(sequence(1, 64), 0L, (s, i) -> s + (1 - 2 * ({sign})) * floor(cast(element_at(embedding, i) as double) * 1000)) / 8d) as {name}"
)


@query(
    "density_clusters",
    f"""with recursive p as materialized (select vec_id node, {PROJECT.format(sign="i % 2")} x, {PROJECT.format(sign="i // 2 % 2")} y from embeddings)
, near as materialized (select a.node a, b.node b from p a join p b on {D2} <= 1600)
, core as materialized (select a node from near group by a having count(*) >= 8)
, cn as materialized (select a, b from near semi join core on a = core.node where b in (select node from core))
, cc (node, l) using key (node) as (select node, node from core union
  (select k.b, min(c.l) from cc c join cn k on k.a = c.node join recurring.cc o on o.node = k.b where c.l < o.l group by k.b))
, placed as (select p.node, coalesce((select l from cc where cc.node = p.node), (select min(l) from near join cc on cc.node = near.b where near.a = p.node)) cluster from p)
select node, case when count(*) over (partition by cluster) >= 10 then cluster end cluster from placed""",
)
def _density(v):
    points = v.table("embeddings").selectExpr(
        "vec_id as node", PROJECTION.format(sign="i % 2", name="x"), PROJECTION.format(sign="i div 2 % 2", name="y")
    )
    return G.density_clusters(points, eps=40, min_points=8, min_size=10)
