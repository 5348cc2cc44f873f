"""Connected components by alternating star contractions (Kiveris et al., 2014).

Every round is joins and map-side-combined minima, so a vertex with very many neighbours is never
gathered in one task. Lineage is cut each round with a reliable checkpoint. Before the rounds start, every
partition replaces its own edges by stars; the rounds then only have to join what spans partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.session import cut_lineage


#: Edges that a task holds at once before the rounds.
HELD_EDGES = 2_000_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("key", "u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("key", "u", "v").unionByName(edges.select("key", F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("key", "u").agg(F.min("v").alias("m")).select("key", "u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u")
        .join(lowest, ["key", "u"])
        .select("key", F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("key", "u").agg(F.min("v").alias("m"))
    relinked = edges.join(lowest, ["key", "u"]).where("v <> m").select("key", F.col("v").alias("u"), F.col("m").alias("v"))
    return relinked.unionByName(lowest.select("key", "u", F.col("m").alias("v"))).distinct()


def lowest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest vertex reachable from each of ``n`` vertices over edges a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _stars_per_partition(batches):
    """Replace edges, a bounded number at a time, by (vertex, lowest vertex linked to it among them)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= HELD_EDGES:
            yield _stars(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if rows:
        yield _stars(pd.concat(held, ignore_index=True))


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    ends = pd.concat([edges[["key", "u"]], edges[["key", "v"]].rename(columns={"v": "u"})], ignore_index=True)
    code = ends.groupby(["key", "u"], sort=True).ngroup().to_numpy()
    half = len(edges)
    vertices = ends.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
    root = lowest_linked(len(vertices), code[:half], code[half:])
    stars = vertices.assign(v=vertices["u"].to_numpy()[root])
    return stars[stars["u"] != stars["v"]]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(key, u, v)`` -> ``(key, u, root)`` for every vertex that is not its component's lowest id.

    ``key`` scopes vertex ids (an image id); vertices without edges, and roots, do not appear.
    """
    edges = edges.where("u <> v").select("key", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    key_type = edges.schema["key"].dataType.simpleString()
    # Rebalancing keeps the edges of a key together but splits a key that is too large for one task.
    edges = cut_lineage(
        edges.hint("rebalance", "key").mapInPandas(_stars_per_partition, f"key {key_type}, u long, v long")
    )
    seen = _fingerprint(edges)
    if seen[0]:
        while True:
            edges = cut_lineage(_small_star(_large_star(edges)))
            now = _fingerprint(edges)
            if now == seen:
                break
            seen = now
    return edges.select("key", "u", F.col("v").alias("root"))
