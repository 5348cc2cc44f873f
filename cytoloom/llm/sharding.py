"""Contiguous shards of nearly equal byte size from global prefix sums.

The order is (doc_id, hash of the text), nulls first. Rows equal in both are folded to one row with a count
before anything is sorted. A range partitioning puts the folded rows in order; each partition's total is one row, prefix
sums of those totals give every partition its start, and a window inside the partition gives every row its own. A row
belongs to the shard in which the middle of its bytes falls, so each shard misses the equal target by at most half a
row at either end. Only (id, hash, size, checksum) is shuffled, never text.

Defined cases: a null text has the size of an empty one (1) and checksum 0; repeated rows get neighbouring slots; a null
doc_id sorts first; an empty table gives no rows; more shards than rows leave some shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored

#: Copies expanded from one folded row at a time.
CHUNK = 65_536


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).cast("long").alias("text_crc32"),
    )


def _placed(docs: DataFrame) -> DataFrame:
    """Folded rows with ``copies`` and, over all rows before them, ``rows_before`` and ``bytes_before``; plus totals."""
    key = ["doc_id", "text_hash", "size", "text_crc32"]
    folded = _keyed(docs).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    # Stored once: the range cut points must not be drawn anew in another pass.
    ranged = stored(folded.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "shard-order")
    totals = ranged.groupBy("part").agg(
        F.sum("copies").alias("part_rows"), F.sum(F.col("copies") * F.col("size")).alias("part_bytes")
    )
    # One row per partition, so this window is as small as the partition list.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_rows_before"),
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("part_bytes_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    rows = F.coalesce(F.sum("copies").over(inside), F.lit(0))
    size = F.coalesce(F.sum(F.col("copies") * F.col("size")).over(inside), F.lit(0))
    return (
        ranged.withColumn("rows_before", rows)
        .withColumn("bytes_before", size)
        .join(starts, "part")
        .withColumn("rows_before", F.col("rows_before") + F.col("part_rows_before"))
        .withColumn("bytes_before", F.col("bytes_before") + F.col("part_bytes_before"))
        .select(*key, "copies", "rows_before", "bytes_before", "all_bytes")
    )


def _copies(placed: DataFrame) -> DataFrame:
    """One row per original row, with its own ``position`` and ``bytes_before``."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long")))
    last = F.least(F.col("copies"), F.col("_from") + CHUNK) - 1
    return (
        placed.withColumn("_from", first)
        .withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
        .withColumn("position", F.col("rows_before") + F.col("_copy"))
        .withColumn("bytes_before", F.col("bytes_before") + F.col("_copy") * F.col("size"))
        .drop("_from", "_copy", "copies", "rows_before")
    )


def assign_shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text_hash, size, text_crc32, shard, slot)``, one row per input row.

    ``slot`` numbers the rows of a shard from 0 in the global order. ``n_shards`` times the total size must stay
    below 2**62.
    """
    rows = stored(
        _copies(_placed(docs)).withColumn(
            "shard",
            F.least(
                F.lit(n_shards - 1).cast("long"),
                F.expr(f"(2 * bytes_before + size) * {n_shards} div (2 * all_bytes)"),
            ).cast("int"),
        ),
        "shard-rows",
    )
    # At most n_shards rows.
    first = rows.groupBy("shard").agg(F.min("position").alias("_first"))
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "text_hash", "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot")
    )


def with_shard(docs: DataFrame, n_shards: int) -> DataFrame:
    """All columns of ``docs`` and ``shard``, without shuffling any text.

    The cuts come from the same prefix sums as :func:`assign_shards`. Their first keys, at most ``n_shards`` rows, are
    read by the driver and compared with each row. Rows equal in (doc_id, text) go to one shard.
    """
    lowest = -(2**63)
    order = F.struct(F.coalesce("doc_id", F.lit(lowest)).alias("a"), F.col("text_hash").alias("b"))
    placed = _placed(docs).withColumn(
        "shard",
        F.least(
            F.lit(n_shards - 1).cast("long"),
            F.expr(f"(2 * bytes_before + size * copies) * {n_shards} div (2 * all_bytes)"),
        ).cast("int"),
    )
    cuts = placed.groupBy("shard").agg(F.min(order).alias("at")).orderBy("shard").collect()
    mine = F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("a"), F.xxhash64("text").alias("b")
    )
    shard = F.lit(0)
    for cut in cuts:
        at = F.struct(F.lit(cut["at"]["a"]).cast("long").alias("a"), F.lit(cut["at"]["b"]).cast("long").alias("b"))
        shard = F.when(mine >= at, F.lit(cut["shard"])).otherwise(shard)
    return docs.withColumn("shard", shard.cast("int"))
