"""Embeddings: batch scoring with a supplied encoder, 2-D projection, k-means."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crop_vectors(pixels: DataFrame, side: int) -> DataFrame:
    """Fixed-size gray crops around each cell's centre as flat arrays; missing pixels are white.

    ``pixels`` has image_id, cell_id, dy, dx (offsets from the centre) and gray.
    """
    half = side // 2
    inside = pixels.where(f"dy >= {-half} and dy < {half} and dx >= {-half} and dx < {half}")
    spot = F.expr(f"cast((dy + {half}) * {side} + dx + {half} as int)")
    packed = inside.groupBy("image_id", "cell_id").agg(
        F.collect_list(F.struct(spot.alias("k"), "gray")).alias("m")
    )
    return packed.select("image_id", "cell_id", _laid_out(side * side)("m.k", "m.gray").alias("crop"))


def _laid_out(size: int):
    """Values at their places in an array of ``size``, elsewhere white; looking up every place in a map would take size times the pixels."""

    @F.pandas_udf("array<float>")
    def run(spots: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full((len(spots), size), 255, np.float32)
        for crop, spot, value in zip(out, spots, values, strict=True):
            crop[spot] = value
        return pd.Series(list(out))

    return run


def embed_batch(crops: DataFrame, make_encoder: Callable, size: int, dim: int, batch: int = 256) -> DataFrame:
    """Score crops with a user's encoder in Arrow batches; the model is built once per worker."""
    encode = predict_batch_udf(
        make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[size]]
    )
    return crops.select("image_id", "cell_id", encode("crop").alias("embedding"))


def random_projection(size: int, dim: int = 768, seed: int = 7) -> Callable:
    """A stand-in encoder: fixed random projection of intensities."""

    def make():
        weights = np.random.default_rng(seed).standard_normal((size, dim)).astype(np.float32) / np.sqrt(size)

        def predict(inputs: np.ndarray) -> np.ndarray:
            return (inputs.astype(np.float32) / 255.0) @ weights

        return predict

    return make


def reduce_dims(vectors: DataFrame, key: str, col: str = "embedding", dims: int = 2) -> DataFrame:
    data = vectors.select(key, array_to_vector(F.col(col).cast("array<double>")).alias("v"))
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(data)
    return model.transform(data).select(key, vector_to_array("p").alias("point"))


def kmeans_clusters(vectors: DataFrame, key: str, k: int = 100, col: str = "embedding", seed: int = 7) -> DataFrame:
    data = vectors.select(key, array_to_vector(F.col(col).cast("array<double>")).alias("v"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster_id", maxIter=20).fit(data)
    return model.transform(data).select(key, F.col("cluster_id").cast("long").alias("cluster_id"))
