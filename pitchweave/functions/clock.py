"""Camera clocks and the frame grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reference_time(t: str, offset: str, drift: str) -> Column:
    """Reference time of a camera time; a NULL drift is none."""
    return F.col(t) + F.col(offset) + F.coalesce(F.col(drift), F.lit(0.0)) * F.col(t)


def grid_position(t: str, offset: str, drift: str, start: str, fps: str) -> Column:
    """Position on the frame grid, in frames; the grid frame is this rounded half to even."""
    return (reference_time(t, offset, drift) - F.col(start)) * F.col(fps)


def camera_time(reference: str, offset: str, drift: str) -> Column:
    """Camera time of a reference time: the inverse of ``reference_time``."""
    return (F.col(reference) - F.col(offset)) / (1 + F.coalesce(F.col(drift), F.lit(0.0)))


def composed(offset: Column, drift: Column, further_offset: Column, further_drift: Column, start: Column) -> tuple[Column, Column]:
    """(offset, drift) of a clock that is corrected once more by ``further_offset + further_drift * (reference - start)``."""
    return offset * (1 + further_drift) + further_offset - further_drift * start, drift + further_drift * (1 + drift)
