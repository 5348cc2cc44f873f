"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.session import scratch_path

A_TO_Z = string.ascii_uppercase
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same on pure ASCII text and is much faster there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, A_TO_Z, A_TO_Z.lower())).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is computed once per row however often ``x`` is used."""
    return F.transform(F.array(value), body)[0]
