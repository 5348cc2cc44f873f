"""Exact top-k by inner product: a Voronoi k-nearest-neighbour join.

Vectors become integers (floor of ``scale`` times each component). ``pivots`` data vectors, those with the smallest hashed ids, split queries and
data into groups by nearest pivot. Each group has a summary: rows, and the largest distance r of its data from the pivot.

1. Every query is solved against its own group. Its k-th score so far is a lower bound t of its final k-th score.
2. For a data group with pivot p and radius r, no member scores more than q.p + |q| r. A query is sent on to those other groups only
   where this reaches t. Queries are what is replicated, since data outnumber them.
3. Groups are solved locally in blocks of bounded size (a hot group is many blocks), each giving the best k per query; the best k of
   those are the result.

Equal vectors tie in every query, so of each distinct vector only the k + 1 smallest ids can appear; the others are folded away
before anything is grouped. A vector that fills a third of the table costs k + 1 rows.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part; ids that are null take no part;
a shorter vector counts as padded with zeros; equal (id, vector) rows count once; rows with the query's id are never its result; ties go
to the smaller id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored

#: Most rows of a data block and of a query block, about.
DATA_BLOCK = 8192
QUERY_BLOCK = 1024


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> distinct ``(vec_id, v)`` that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")).distinct()


def _matrix(column: pd.Series, width: int = 0) -> np.ndarray:
    sizes = column.map(len)
    width = max(width, int(sizes.max()) if len(sizes) else 0)
    if (sizes == width).all():
        return np.array(column.tolist(), np.int64).reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point is exact while sums stay below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _grouped(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` (nearest pivot) and ``away`` (distance to it)."""

    def run(frames):
        for frame in frames:
            v = _matrix(frame["v"], pivots.shape[1]).astype(np.float64)
            p = np.pad(pivots, ((0, 0), (0, v.shape[1] - pivots.shape[1]))).astype(np.float64)
            square = (v**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * v @ p.T
            cell = square.argmin(axis=1)
            away = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
            yield frame.assign(cell=cell.astype(np.int32), away=away)

    return df.mapInPandas(run, "vec_id long, v array<long>, cell int, away double")


def _solver(k: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        if data.empty or queries.empty:
            return empty
        data = data.sort_values("vec_id")
        width = max(data["v"].map(len).max(), queries["v"].map(len).max())
        d, ids = _matrix(data["v"], width), data["vec_id"].to_numpy(np.int64)
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            own = part["vec_id"].to_numpy(np.int64)
            score = _products(_matrix(part["v"], width), d)
            banned = ids[None, :] == own[:, None]
            # The best k of a row by (score, smaller id): columns are in order of ids.
            kept = min(k, score.shape[1])
            shown = np.where(banned, np.iinfo(np.int64).min, score)
            edge = np.partition(shown, -kept, axis=1)[:, -kept]
            row, col = np.nonzero((shown >= edge[:, None]) & ~banned)
            order = np.lexsort((col, -score[row, col], row))
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[rank < k], col[rank < k]
            out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": score[row, col]}))
        return pd.concat(out, ignore_index=True)

    return run


def _solve(data: DataFrame, sent: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """``sent(vec_id, v, cell)``: queries, each with a group to look in."""
    parts = F.coalesce(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("cell")], F.lit(1))
    # A query goes to all blocks of its group; enough query blocks keep each near QUERY_BLOCK rows.
    counts = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    query_blocks = {r["cell"]: -(-r["n"] // QUERY_BLOCK) for r in counts.collect()}  # at most one row per pivot
    if not query_blocks:
        return data.select(F.col("vec_id").alias("query_id"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    q_parts = F.coalesce(F.create_map(*[F.lit(x) for pair in query_blocks.items() for x in pair])[F.col("cell")], F.lit(0))
    mine = F.pmod(F.xxhash64("vec_id"), parts)
    q_mine = F.pmod(F.xxhash64("vec_id", F.lit(1)), q_parts)
    left = data.withColumn("q_parts", q_parts).where("q_parts > 0").select(
        "vec_id", "v", "cell", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1).cast("array<bigint>")).alias("q_block")
    )
    right = sent.select(
        "vec_id", "v", "cell", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<bigint>")).alias("block"), q_mine.alias("q_block")
    )
    unit = ["cell", "block", "q_block"]
    return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(
        lambda a, b: _solver(k)(a, b), "query_id long, vec_id long, score long"
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, pivots: int = 32) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for each row of ``queries`` against all rows of ``vectors`` (both ``vec_id, embedding``)."""
    whole = stored(integer_vectors(vectors, scale), "topk-vectors")
    asked = integer_vectors(queries, scale)
    # Spark limits each task's rows of a vector before it shuffles them.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    data = stored(whole.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "topk-folded")
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toPandas()  # ``pivots`` rows
    if chosen.empty:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    points = np.unique(_matrix(chosen["v"]), axis=0)
    data = stored(_grouped(data, points), "topk-data")
    asked = stored(_grouped(asked, points), "topk-queries")
    summary = {
        r["cell"]: (r["n"], r["r"])
        for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # one row per pivot
    }
    blocks = {c: -(-n // DATA_BLOCK) for c, (n, _) in summary.items()}
    cells = np.array(sorted(summary))
    radius = np.array([summary[c][1] for c in cells])
    first = stored(_solve(data, asked.select("vec_id", "v", "cell"), blocks, k), "topk-own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bound = (
        first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("t"))
    )

    def spread(frames):
        for frame in frames:
            v = _matrix(frame["v"], points.shape[1]).astype(np.float64)
            p = np.pad(points, ((0, 0), (0, v.shape[1] - points.shape[1]))).astype(np.float64)[cells]
            most = v @ p.T + np.sqrt((v**2).sum(axis=1))[:, None] * radius
            most += 1e-9 * np.abs(most) + 1e-6
            t = frame["t"].to_numpy(np.float64, na_value=-np.inf)
            row, col = np.nonzero((most >= t[:, None]) & (cells[None, :] != frame["cell"].to_numpy()[:, None]))
            yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[row], "v": frame["v"].to_numpy()[row], "cell": cells[col].astype(np.int32)})

    sent = asked.join(bound, "vec_id", "left").select("vec_id", "v", "cell", "t").mapInPandas(spread, "vec_id long, v array<long>, cell int")
    others = _solve(data, stored(sent, "topk-sent"), blocks, k)
    ranked = first.unionByName(others).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
