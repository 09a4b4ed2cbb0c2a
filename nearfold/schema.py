"""The record that every plan works on."""

from __future__ import annotations

from pyspark.sql import types as T

#: hash holds 64 bits as a signed number.
MAPPED_IMAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("physical_path", T.StringType()),
        T.StructField("hash", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("resolution", T.LongType()),
        T.StructField("last_write_time", T.TimestampType()),
        T.StructField("is_grayscale", T.BooleanType()),
    ]
)
