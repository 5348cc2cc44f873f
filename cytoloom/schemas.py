"""Explicit schemas of the nested and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CELL_DOCUMENT = _struct(
    _id=_S,
    source_image_id=_L,
    shard_filename=_S,
    shard_index=_L,
    spatial_coordinates=_struct(bbox=T.ArrayType(_L), centroid_x=_D, centroid_y=_D),
    morphometrics=_struct(soma_area_px=_D, circularity=_D, fractal_dimension=_D),
    cluster_id=_L,
    active_learning=_struct(uncertainty_score=_D, is_flagged_for_review=T.BooleanType()),
    label=_struct(class_id=_L, class_name=_S, annotated_by=_S, annotated_at=T.TimestampType()),
)

CELL_DOCUMENT_SHORT = _struct(
    cell_id=_S,
    image_id=_S,
    bbox=T.ArrayType(_L),
    cluster_id=_L,
    active_label=_S,
    confidence=_D,
    is_verified=T.BooleanType(),
)

SHARD_ROW = _struct(
    image_id=_L,
    shard_index=_L,
    image=T.BinaryType(),
    mask=T.BinaryType(),
    embedding=T.ArrayType(T.FloatType()),
    label=T.IntegerType(),
    bbox=T.ArrayType(_L),
)

LABEL_EVENT = _struct(cluster_id=_L, label=_S, ts=T.TimestampType())

EVENT_LOG = _struct(
    event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S
)
