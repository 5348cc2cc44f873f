"""Cell documents and per-image shards: reading, querying, fetching, upserting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.schemas import CELL_DOCUMENT, SHARD_ROW


def parse_documents(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.select(F.from_json(col, CELL_DOCUMENT).alias("d")).select("d.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested cell documents from JSON files, with a given schema (no inference pass)."""
    return spark.read.schema(CELL_DOCUMENT).json(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards partitioned by image_id: a filter on image_id reads only those folders."""
    return spark.read.schema(SHARD_ROW).parquet(path)


def flagged(documents: DataFrame, min_uncertainty: float) -> DataFrame:
    """Documents up for review; nested fields are pruned and filtered at the scan."""
    return documents.where(
        (F.col("active_learning.uncertainty_score") >= min_uncertainty) & F.col("active_learning.is_flagged_for_review")
    )


def training_rows(documents: DataFrame, shards: DataFrame, wanted: Column) -> DataFrame:
    """Crops, masks, embeddings, labels and boxes of the documents that pass ``wanted``."""
    chosen = documents.where(wanted).select(
        F.col("source_image_id").alias("image_id"),
        "shard_index",
        F.col("label.class_id").alias("class_id"),
        F.col("spatial_coordinates.bbox").alias("bbox"),
    )
    data = shards.select("image_id", "shard_index", "image", "mask", "embedding")
    # Sizes estimated from packed files would send parsed documents through the driver as a broadcast.
    return chosen.join(data.hint("merge"), ["image_id", "shard_index"])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows with non-null changed fields taken over, plus new keys. ``changes`` has one row per key."""
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = current.join(renamed, keys, "full")
    return joined.select(
        *keys,
        *[
            F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c)
            for c in current.columns
            if c not in keys
        ],
    )
