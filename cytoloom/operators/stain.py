"""Stain separation: optical density, covariance, leading vectors, concentrations, recolouring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.color import optical_density as od_expr
from cytoloom.operators.pixels import add

PAIRS = [("b", "b"), ("b", "g"), ("b", "r"), ("g", "g"), ("g", "r"), ("r", "r")]

# Default target stain matrix, two rows over b, g, r.
TARGET = {"s1": (0.25, 0.70, 0.65), "s2": (0.10, 0.95, 0.07)}


def optical_density(px: DataFrame, white: int = 240) -> DataFrame:
    return add(px, **{f"od_{c}": od_expr(c, white) for c in "bgr"})


def tissue(od: DataFrame, floor: float = 0.15) -> DataFrame:
    """Keep pixels with stain in at least one channel."""
    return od.where(" or ".join(f"od_{c} >= {floor}D" for c in "bgr"))


def covariance(od: DataFrame) -> DataFrame:
    """3 x 3 covariance of optical density per image as six aggregates (combined map-side)."""
    return od.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"od_{a}", f"od_{b}").alias(f"c_{a}{b}") for a, b in PAIRS]
    )


def _leading(batches):
    order = [0, 1, 2, 1, 3, 4, 2, 4, 5]
    for pdf in batches:
        six = pdf[[f"c_{a}{b}" for a, b in PAIRS]].to_numpy()
        _, vectors = np.linalg.eigh(six[:, order].reshape(-1, 3, 3))
        two = vectors[:, :, [2, 1]].transpose(0, 2, 1)
        sign = np.where(two.sum(axis=2, keepdims=True) < 0, -1.0, 1.0)
        two = two * sign
        yield pd.DataFrame({"image_id": pdf["image_id"], "s1": list(two[:, 0]), "s2": list(two[:, 1])})


def stain_vectors(cov: DataFrame) -> DataFrame:
    """Two leading directions per image; one row per image goes through NumPy."""
    return cov.mapInPandas(_leading, "image_id long, s1 array<double>, s2 array<double>")


def concentrations(od: DataFrame, matrix: DataFrame) -> DataFrame:
    """Dot products of each pixel's optical density with its image's two stain vectors (s1, s2)."""
    joined = od.join(matrix.select("image_id", "s1", "s2"), "image_id")
    dots = {
        f"c{k}": " + ".join(f"od_{c} * s{k}[{i}]" for i, c in enumerate("bgr")) for k in (1, 2)
    }
    return add(joined, **dots).drop("s1", "s2")


def recolor(conc: DataFrame, target: dict[str, tuple] = TARGET, white: int = 240) -> DataFrame:
    """Intensities for the same stain amounts under the target matrix."""
    mixed = {
        c: f"cast(floor(greatest(0, least(255, {white} * power(10D, -(c1 * {target['s1'][i]}D + c2 * {target['s2'][i]}D))))) as bigint)"
        for i, c in enumerate("bgr")
    }
    return add(conc, **mixed)
