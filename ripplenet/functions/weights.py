"""Inverse-value weights of the bootstrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT_SCALE = 1000


def inverse_weight(value: Column, scale: int = WEIGHT_SCALE) -> Column:
    """``floor(scale / value)``, at least 1. A value below 1 has no inverse weight and stops the job."""
    usable = F.when(value >= 1, value).otherwise(
        F.raise_error(F.concat(F.lit("bootstrap needs values of at least 1, got "), value.cast("string"))).cast("bigint")
    )
    return F.greatest(F.floor(F.lit(scale) / usable), F.lit(1)).cast("bigint")
