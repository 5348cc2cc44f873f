"""Label feed: cluster labels arrive as events and end up on every cell of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cytoloom.operators.labeling import apply_cluster_labels, latest_labels
from cytoloom.schemas import LABEL_EVENT


def read_label_feed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LABEL_EVENT).json(folder)


def sync_labels(feed: DataFrame, table: str, checkpoint: str, order: tuple[str, ...] = ("ts",)) -> StreamingQuery:
    """Keep the newest label per cluster and batch under ``table``; process what is there, then stop.

    Each batch is reduced to one row per cluster before it is written to its own folder, so a replayed batch
    overwrites itself and the result does not depend on how events were batched.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        latest_labels(batch, order).write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    return (
        feed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def synced_cells(cells: DataFrame, table: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Cells with the newest label of their cluster over all stored batches."""
    stored = cells.sparkSession.read.parquet(table).drop("epoch")
    return apply_cluster_labels(cells, latest_labels(stored, order).drop(*order))


def wait(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


