"""Capacity-bounded retention: the newest records by arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import CapacityError, SizeModel, usable


def newest(df: DataFrame, total: int, capacity: int) -> DataFrame:
    """The last `capacity` of `total` records (all for 0), as a bound on seq that reaches the scan."""
    return df.where(F.col("seq") >= total - capacity) if capacity and total > capacity else df


def trimmed(retained: int, model: SizeModel, free_space_bytes: int = 0, allow_trim: bool = False) -> int:
    """How many of the retained records fit the space budget (0 bytes: no check)."""
    if not free_space_bytes or model.bytes_for(retained) <= usable(free_space_bytes):
        return retained
    if not allow_trim:
        raise CapacityError(f"{model.bytes_for(retained)} bytes are needed, {usable(free_space_bytes)} may be used")
    if not (fit := model.fit(usable(free_space_bytes))):
        raise CapacityError("no record fits the space budget")
    return min(fit, retained)
