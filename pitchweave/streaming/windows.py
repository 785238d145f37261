"""Structured Streaming: event-time windows, sessions, and live tracks with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pitchweave.functions.kernels import follow


def file_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 16) -> DataFrame:
    """Parquet files of a folder as they land; each file is one event of the ingest queue, processed once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def sliding_counts(events: DataFrame, *, time: str, keys: list[str], length: str = "300 seconds", step: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Events and sum of ``value`` per key and sliding window; with ``late`` a watermark, so that a stream can append."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, length, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.unix_seconds("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, *, time: str, keys: list[str], gap: str = "600 seconds", late: str | None = None) -> DataFrame:
    """Events per key and session that a pause of ``gap`` ends."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n", "total")


def live_tracks(points: DataFrame, *, keys: list[str], gate: float = 1.5, forget: int = 20) -> DataFrame:
    """Provisional tracks of a stream of points (keys, k, x, y): each point is linked to the track of its camera whose
    predicted place is nearest.

    The state of a key is the last frames of its points with their tracks, at most ``forget`` frames back; it is dropped
    ten minutes after the last point.  Points of a frame that arrive after later frames get tracks of their own.
    """
    out = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys) + ", k bigint, x double, y double, track bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ks, xs, ys, ts, number = (list(v) if isinstance(v, (list, tuple)) else v for v in state.get) if state.exists else ([], [], [], [], 0)
        fresh = pd.concat(batches).sort_values(["k", "x", "y"])
        n = len(ks)
        k = np.array([*ks, *fresh["k"]], np.int64)
        xy = np.c_[[*xs, *fresh["x"]], [*ys, *fresh["y"]]].astype(float)
        own = follow(k, xy, gate, forget)
        # a linked group keeps the number its earlier points had
        name: dict[int, int] = {}
        for local, old in zip(own[:n].tolist(), ts):
            name.setdefault(local, old)
        for local in own.tolist():
            if local not in name:
                name[local], number = number, number + 1
        track = np.array([name[t] for t in own.tolist()], np.int64)
        keep = k > k.max() - forget if len(k) else np.zeros(0, bool)
        state.update((k[keep].tolist(), xy[keep, 0].tolist(), xy[keep, 1].tolist(), track[keep].tolist(), number))
        state.setTimeoutDuration(600_000)
        yield fresh.assign(**dict(zip(keys, key)), track=track[n:])[[*keys, "k", "x", "y", "track"]]

    held = "k array<bigint>, x array<double>, y array<double>, track array<bigint>, number bigint"
    return points.groupBy(*keys).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout)
