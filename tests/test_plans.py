import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cytoloom.operators import graph as G
from cytoloom.plans.components import connected_components
from cytoloom.plans.ranking import positions, running_totals


def test_positions_equal_a_plain_row_number(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 2), rnd.randint(0, 5000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k long, v long").repartition(7)
    out = positions(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 100), "p").toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values(["v", "id"])
    pdf["p"] = pdf.groupby("k").cumcount() + 1
    assert dict(zip(out.id, out.p)) == dict(zip(pdf.id, pdf.p))
    down = positions(
        df, [], [F.col("v").desc(), F.col("id")], -F.floor(F.col("v") / 100), "p",
        fine=F.struct(-F.col("v"), F.floor(F.col("id") / 500)),
    ).toPandas()
    want = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values(["v", "id"], ascending=[False, True])
    assert list(down.sort_values("p").id) == list(want.id)


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id v", "id % 7 c")
    out = running_totals(df, [], "v", F.floor(F.col("v") / 64), {"s": "c"}).toPandas().sort_values("v")
    assert list(out.s) == list(np.cumsum(np.arange(1000) % 7))


def union_find(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k, a, b in edges:
        ra, rb = find((k, a)), find((k, b))
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in root}


def test_components_on_random_graphs_paths_and_stars(spark):
    rnd = random.Random(5)
    edges = [(0, rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)]
    path = list(range(500))
    rnd.shuffle(path)
    edges += [(1, a, b) for a, b in zip(path, path[1:])]
    edges += [(2, 7, i) for i in range(400)]
    df = spark.createDataFrame(edges, "key long, u long, v long").repartition(13)
    got = {(r.key, r.u): r.root for r in connected_components(df).collect()}
    want = {v: r[1] for v, r in union_find(edges).items() if v != r and v[1] != r[1]}
    assert got == want


def test_star_rounds_join_what_partitions_split(spark, monkeypatch):
    import cytoloom.plans.components as C

    # Without the per-partition step the rounds alone must find the components.
    monkeypatch.setattr(C, "_stars_per_partition", lambda batches: batches)
    edges = [(0, i, i + 1) for i in range(120)] + [(1, 9, i) for i in range(10, 60)]
    df = spark.createDataFrame(edges, "key long, u long, v long")
    got = {(r.key, r.u): r.root for r in C.connected_components(df).collect()}
    assert got == {(0, i): 0 for i in range(1, 121)} | {(1, i): 9 for i in range(10, 60)}


def greedy(points, radius):
    pairs = []
    for a in points:
        for b in points:
            d2 = (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
            if a[0] == b[0] and a[1] < b[1] and d2 <= radius * radius:
                pairs.append((d2, a[1], b[1], a[0]))
    used, out = set(), []
    for d2, i, j, image in sorted(pairs):
        if (image, i) not in used and (image, j) not in used:
            used |= {(image, i), (image, j)}
            out.append((image, i, j, d2))
    return sorted(out)


def test_greedy_match_equals_sorted_greedy(spark):
    rnd = random.Random(9)
    points = [(i % 3, i, rnd.randint(0, 60), rnd.randint(0, 60)) for i in range(150)]
    points += [(0, 1000 + i, 5, 5) for i in range(7)]
    df = spark.createDataFrame(points, "image_id long, node long, x long, y long")
    got = sorted(tuple(r) for r in G.greedy_match(df, 12).collect())
    assert got == greedy(points, 12)


def test_crowded_location_keeps_all_its_neighbours_and_counts(spark):
    crowd = spark.range(50_000).selectExpr("0L image_id", "id node", "3L x", "3L y")
    other = spark.createDataFrame([(0, 10**6, 5, 3)], "image_id long, node long, x long, y long")
    points = crowd.unionByName(other)
    total = G.proximity_edges(points, 10).agg(F.sum("n_edges")).first()[0]
    assert total == 50_000 * 49_999 // 2 + 50_000
    near = G.knn_edges(points, 10, 2).where("node in (0, 1, 49999, 1000000)").collect()
    got = {}
    for r in near:
        got.setdefault(r.node, []).append(r.neighbour)
    assert {k: sorted(v) for k, v in got.items()} == {0: [1, 2], 1: [0, 2], 49999: [0, 1], 10**6: [0, 1]}


def test_anova_keeps_digits_far_from_zero(spark):
    from cytoloom.operators.statistics import anova_f

    rows = [(g, 1e9 + g + 0.1 * ((7 * i) % 11)) for g in range(3) for i in range(400)]
    far = anova_f(spark.createDataFrame(rows, "g long, v double"), "g", "v").first()
    near = anova_f(spark.createDataFrame([(g, v - 1e9) for g, v in rows], "g long, v double"), "g", "v").first()
    assert (far.k, far.n) == (3, 1200) and abs(far.f / near.f - 1) < 1e-5
