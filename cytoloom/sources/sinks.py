"""Table sinks. All write Parquet folders that can be replaced image by image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _remove(spark: SparkSession, path: str) -> None:
    """Delete one folder in whatever file system the path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_by_image(
    df: DataFrame,
    path: str,
    by: Sequence[str] = ("image_id",),
    spread: Sequence[str] = (),
    max_rows: int = 5_000_000,
    images: DataFrame | None = None,
) -> None:
    """Write partitioned by image, replacing only the images in ``df`` and, if given, all of ``images(image_id)``.

    ``images`` are those that were processed: one that has no row any more is cleared. Its id must be the only partition column.

    Rows are rebalanced on the image (and ``spread`` columns), so small images share a task, a huge image is
    split over several tasks and files, and no folder gets a sliver from every task.
    """
    if images is not None:
        emptied = images.select("image_id").distinct().join(df.select("image_id").distinct(), "image_id", "left_anti")
        for row in emptied.toLocalIterator():
            _remove(df.sparkSession, f"{path}/image_id={row['image_id']}")
    (
        df.hint("rebalance", *by, *spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy(*by)
        .parquet(path)
    )


def image_folder(folders: int) -> Column:
    """The folder of an image where ``folders`` of them hold all images."""
    return F.pmod(F.xxhash64(F.col("image_id").cast("long")), F.lit(folders)).cast("int")


def write_in_folders(df: DataFrame, path: str, folders: int, by: Sequence[str] = (), max_rows: int = 5_000_000) -> None:
    """Write a whole table with many images per folder (and folders of the ``by`` columns), images in order inside.

    For small images: a folder and a file per image cost more than their rows. A filter on image_id skips row groups, and one on ``folder`` (see
    :func:`image_folder`) reads one folder. Tables that are replaced image by image need :func:`write_by_image`.
    """
    (
        df.withColumn("folder", image_folder(folders))
        .hint("rebalance", *by, "folder")
        .sortWithinPartitions(*by, "folder", "image_id")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy(*by, "folder")
        .parquet(path)
    )


def write_layers(df: DataFrame, path: str, layers: Sequence[str], folders: int) -> None:
    """Persist several value columns of one pixel table as layers, each in its own folders."""
    pairs = ", ".join(f"'{c}', cast({c} as bigint)" for c in layers)
    long = df.selectExpr("image_id", "y", "x", f"stack({len(layers)}, {pairs}) as (layer, v)")
    write_in_folders(long, path, folders, by=("layer",))


def write_html(fragments: DataFrame, path: str) -> None:
    """Gallery fragments (image_id, part, html) as text, one folder per image, in part order."""
    (
        fragments.repartitionByRange("image_id", "part")
        .sortWithinPartitions("image_id", "part")
        .select("image_id", F.col("html").alias("value"))
        .write.mode("overwrite")
        .partitionBy("image_id")
        .text(path)
    )
