"""Point graphs: endpoint pairs and matching, proximity, nearest neighbours, Gabriel edges, clusters.

Points at one location are folded into one row with a count before pairs are formed. On an integer lattice
the number of distinct locations within a radius is bounded by the disc, so a crowd of copies cannot turn
into a crowd of pairs; counts carry what the copies stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.plans.components import connected_components
from cytoloom.plans.ranking import positions
from cytoloom.plans.spatial import fold_points, near_pairs, near_points
from cytoloom.session import cut_lineage


def location_pairs(points: DataFrame, radius: int) -> DataFrame:
    """Pairs of locations within ``radius`` and, for n nodes at one place, one row for their n(n-1)/2 pairs.

    Locations are named by their lowest node id; ``n_pairs`` is the number of node pairs a row stands for.
    """
    spots = fold_points(points, "node")
    apart = near_points(spots, spots, radius, where=F.col("a_node") < F.col("b_node"))
    apart = apart.select("image_id", "a_node", "b_node", "d2", (F.col("a_n") * F.col("b_n")).alias("n_pairs"))
    same = spots.where("n > 1").selectExpr(
        "image_id", "node as a_node", "node as b_node", "0L as d2", "n * (n - 1) div 2 as n_pairs"
    )
    return apart.unionByName(same)


def greedy_match(points: DataFrame, radius: int = 30) -> DataFrame:
    """Pairs taken by (distance, i, j), each node at most once, as rounds of locally smallest pairs.

    Nodes at one location pair up consecutively (all their distances are 0 and come first); at most one node
    per location is left for the rounds. A pair is taken when it is the smallest left at both of its ends; the smallest of all always is, so the rounds end.
    """
    spot = ["image_id", "x", "y"]
    ranked = positions(points.select(*spot, "node"), spot, [F.col("node")], F.floor(F.col("node") / 65536), "k")
    ranked = cut_lineage(ranked)
    slot = ranked.selectExpr(*spot, "node", "(k + 1) div 2 as slot")
    twins = slot.groupBy(*spot, "slot").agg(F.min("node").alias("i"), F.max("node").alias("j"))
    matched = [twins.where("i < j").selectExpr("image_id", "i", "j", "0L as d2")]
    single = twins.where("i = j").selectExpr("image_id", "x", "y", "i as node")
    pairs = near_points(single, single, radius, where=F.col("a_node") < F.col("b_node")).selectExpr(
        "image_id", "a_node as i", "b_node as j", "d2"
    )
    pairs = cut_lineage(pairs)
    while True:
        best = F.min(F.struct("d2", "i", "j"))
        ends = pairs.selectExpr("image_id", "i as node", "d2", "i", "j").unionByName(
            pairs.selectExpr("image_id", "j as node", "d2", "i", "j")
        )
        least = ends.groupBy("image_id", "node").agg(best.alias("b")).selectExpr("image_id", "node", "b.i as i", "b.j as j", "b.d2 as d2")
        # A pair that is the best of both its ends shows up twice here.
        taken = cut_lineage(least.groupBy("image_id", "i", "j", "d2").agg(F.count(F.lit(1)).alias("c")).where("c = 2").drop("c"))
        if taken.isEmpty():
            break
        matched.append(taken)
        used = taken.selectExpr("image_id", "explode(array(i, j)) as node")
        pairs = pairs.join(used.withColumnRenamed("node", "i"), ["image_id", "i"], "left_anti")
        pairs = cut_lineage(pairs.join(used.withColumnRenamed("node", "j"), ["image_id", "j"], "left_anti"))
    out = matched[0]
    for part in matched[1:]:
        out = out.unionByName(part)
    return out.select("image_id", "i", "j", "d2")


def pixel_radius(micrometres: float, um_per_px: float) -> int:
    return int(micrometres / um_per_px + 1e-9)


def proximity_edges(nodes: DataFrame, radius: int) -> DataFrame:
    return location_pairs(nodes, radius).withColumnRenamed("n_pairs", "n_edges")


def knn_edges(nodes: DataFrame, radius: int, k: int = 3) -> DataFrame:
    """The k nearest other nodes within ``radius`` (ties: lower id), for every node.

    A location lists at most its k + 1 lowest ids, enough for any node to find k others.
    """
    spot = ["image_id", "x", "y"]
    low = Window.partitionBy(*spot).orderBy("node")
    listed = nodes.select(*spot, "node").withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1).drop("r")
    places = fold_points(nodes, "node").select(*spot)
    near = near_points(places, listed, radius)
    by_place = Window.partitionBy("image_id", "a_x", "a_y").orderBy("d2", "b_node")
    best = near.withColumn("r", F.row_number().over(by_place)).where(F.col("r") <= k + 1)
    best = best.selectExpr("image_id", "a_x as x", "a_y as y", "b_node as neighbour", "d2")
    own = Window.partitionBy("image_id", "node").orderBy("d2", "neighbour")
    joined = nodes.select(*spot, "node").join(best, spot).where("neighbour <> node")
    return joined.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= k).select(
        "image_id", "node", "neighbour", "d2", "rank"
    )


def gabriel_edges(nodes: DataFrame, radius: int) -> DataFrame:
    """Location pairs within ``radius`` whose diameter circle holds no third location (a Delaunay subgraph)."""
    spots = fold_points(nodes, "node")
    edges = cut_lineage(
        near_points(spots, spots, radius, where=F.col("a_node") < F.col("b_node")).selectExpr(
            "image_id", "a_node", "b_node", "d2", "a_x + b_x as sx", "a_y + b_y as sy"
        )
    )
    circles = edges.selectExpr(
        "*", "floor((sx - sqrt(d2)) / 2) as x", "floor((sy - sqrt(d2)) / 2) as y",
        "ceil(sqrt(d2)) + 1 as w", "ceil(sqrt(d2)) + 1 as h",
    )
    third = spots.selectExpr("image_id", "x", "y", "0L as w", "0L as h")
    inside = F.expr("(2 * b_x - a_sx) * (2 * b_x - a_sx) + (2 * b_y - a_sy) * (2 * b_y - a_sy) < a_d2")
    blocked = near_pairs(circles, third, cell=radius, where=inside).selectExpr(
        "image_id", "a_a_node as a_node", "a_b_node as b_node"
    )
    return edges.join(blocked.distinct(), ["image_id", "a_node", "b_node"], "left_anti").select(
        "image_id", "a_node", "b_node", "d2"
    )


def fragment_reconnect(nodes: DataFrame, radius: int) -> DataFrame:
    """Every node with the lowest node id of the group it is linked to by steps of at most ``radius``."""
    spots = cut_lineage(fold_points(nodes, "node"))
    links = near_points(spots, spots, radius, where=F.col("a_node") < F.col("b_node"))
    roots = connected_components(links.selectExpr("image_id as key", "a_node as u", "b_node as v"))
    named = spots.join(roots.selectExpr("key as image_id", "u as node", "root"), ["image_id", "node"], "left").selectExpr(
        "image_id", "x", "y", "coalesce(root, node) as cell"
    )
    return nodes.join(named, ["image_id", "x", "y"])


def density_clusters(points: DataFrame, eps: int, min_points: int, min_size: int) -> DataFrame:
    """Density clusters on integer 2-D points (node, x, y): core points, their components, border points.

    ``cluster`` is the lowest core node id, null for noise and for clusters under ``min_size``.
    """
    spots = cut_lineage(fold_points(points.selectExpr("0L as image_id", "node", "x", "y"), "node"))
    pairs = near_points(spots, spots, eps).select("a_node", "b_node", "b_n")
    dense = pairs.groupBy(F.col("a_node").alias("node")).agg(F.sum("b_n").alias("k")).where(F.col("k") >= min_points)
    cores = cut_lineage(spots.join(dense.select("node"), "node", "left_semi"))
    links = near_points(cores, cores, eps, where=F.col("a_node") < F.col("b_node"))
    roots = connected_components(links.selectExpr("image_id as key", "a_node as u", "b_node as v"))
    core_root = cut_lineage(
        cores.join(roots.selectExpr("u as node", "root"), "node", "left").selectExpr(
            "image_id", "x", "y", "node", "coalesce(root, node) as cluster"
        )
    )
    # A core location keeps its own component (distance 0 is nearest); a border one takes the lowest in reach.
    reach = near_points(spots, core_root, eps).groupBy(F.col("a_node").alias("spot")).agg(
        F.min(F.when(F.col("d2") == 0, F.col("b_cluster"))).alias("own"), F.min("b_cluster").alias("near")
    )
    placed = spots.join(reach, spots["node"] == reach["spot"], "left").selectExpr(
        "x", "y", "n", "coalesce(own, near) as cluster"
    )
    big = placed.groupBy("cluster").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size).select("cluster")
    kept = placed.join(big, "cluster", "left_semi").select("x", "y", "cluster")
    return points.join(kept, ["x", "y"], "left").select("node", "cluster")
