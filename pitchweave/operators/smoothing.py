"""Smoothing, tracking and assignment kernels on Spark groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.kernels import Follower, assign, blank_long_gaps, local_polynomial, smooth_positions
from pitchweave.operators.blocks import in_blocks


def smooth_tracks(df: DataFrame, *, keys: list[str], order: str, dt: str, method: str = "kalman", gap_s: float = 2.0, block: int = 4096, halo: int = 64) -> DataFrame:
    """(keys, order, x, y): positions on every frame between a block's first and last row, smoothed by a Kalman smoother
    (gaps of more than ``gap_s`` NULL) or by local polynomials (``method`` "polynomial", seen frames only).

    ``df`` has x, y and the frame interval ``dt`` in seconds; with ``method`` "gated" also ``var``, each position's own variance,
    and positions that are far off their track count less.  Blocks carry ``halo`` frames of context, after which both
    smoothers have forgotten what came before.
    """
    rows = in_blocks(df.select(*keys, F.col(order).cast("bigint").alias("k_"), "x", "y", F.col("var" if method == "gated" else "x").cast("double").alias("var_"), F.col(dt).alias("dt_")).where("k_ is not null"), "k_", before=halo, after=halo, block=block)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["k_", "x", "y"]).drop_duplicates("k_")
        k, blk = g["k_"].to_numpy(), int(g["_blk"].iloc[0])
        own, dt_ = k[g["_core"].to_numpy(bool)], float(g["dt_"].iloc[0])
        if not len(own):
            return g[[*keys, "k_", "x", "y"]].iloc[:0]
        grid = {}
        for c in ("x", "y", "var_"):
            v = np.full(k[-1] - k[0] + 1, np.nan)
            v[k - k[0]] = g[c].to_numpy(float)
            grid[c] = v
        var = grid.pop("var_")
        seen = np.isfinite(grid["x"]) & np.isfinite(grid["y"])
        out = {}
        for c, v in grid.items():
            v = np.where(seen, v, np.nan)
            if method == "polynomial":
                out[c] = local_polynomial(v)
                continue
            smooth = smooth_positions(v, dt_) if method == "kalman" else smooth_positions(v, dt_, 4.0, var, 9.21, 3.0)
            out[c] = blank_long_gaps(smooth, seen, int(gap_s / dt_))
        at = np.arange(k[0], k[-1] + 1)
        inside = (at >= blk * block) & (at < (blk + 1) * block)
        n = int(inside.sum())
        return pd.DataFrame({**{c: [g[c].iloc[0]] * n for c in keys}, "k_": at[inside], **{c: v[inside] for c, v in out.items()}})

    done = rows.groupBy(*keys, "_blk").applyInPandas(kernel, f"{fields}, k_ bigint, x double, y double")
    return done.where("x is not null and not isnan(x)").select(*keys, F.col("k_").alias(order), "x", "y")


def track_stream(df: DataFrame, *, keys: list[str], frame: str, id: str, columns: list[str], tracker: Callable[[], Any], block: int = 4096) -> DataFrame:
    """(keys, id, block, track): rows of each series handed in order of their frames to a tracker of its own, and the block of
    ``block`` frames each lies in.

    ``tracker()`` has ``feed(k, values)``, which gets whole frames and returns a track number for each row; ``values`` are
    the Arrow-backed columns ``columns``.  What a tracker does hangs on all that came before, so a series is one task; but its
    rows stream through in order, and only the tracker's live state and a batch are held, however long it is.
    Rows with a NULL frame are left out.
    """
    rows = df.select(*keys, F.col(frame).cast("bigint").alias("k_"), F.col(id).alias("id_"), *columns).where("k_ is not null")
    rows = rows.withColumn("block", F.floor(F.col("k_") / block)).withColumn("series_", F.to_json(F.struct(*keys)))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, own, rest = None, tracker(), None
        for g in chain(batches, [None]):
            if g is None:
                g, cut = rest, 0 if rest is None else len(rest)
            else:
                g = g if rest is None else pd.concat([rest, g], ignore_index=True)
                at, k = g["series_"].to_numpy(), g["k_"].to_numpy()
                # the last frame may go on in the next batch
                cut = int(np.flatnonzero((at[1:] != at[:-1]) | (k[1:] != k[:-1])).max(initial=-1)) + 1
                g, rest = g.iloc[:cut], g.iloc[cut:]
            if not cut:
                continue
            at, k, track = g["series_"].to_numpy(), g["k_"].to_numpy(), np.empty(cut, np.int64)
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), cut]
            for lo, hi in zip(edges, edges[1:]):
                if at[lo] != series:
                    series, own = at[lo], tracker()
                track[lo:hi] = own.feed(k[lo:hi], g[columns].iloc[lo:hi])
            yield g[[*keys, "id_", "block"]].assign(track=track)

    ordered = rows.repartition("series_").sortWithinPartitions("series_", "k_", "id_")
    done = ordered.mapInPandas(kernel, f"{fields}, id_ {rows.schema['id_'].dataType.simpleString()}, block bigint, track bigint")
    return done.withColumnRenamed("id_", id)


class _PointFollower(Follower):
    def feed(self, k: np.ndarray, values: pd.DataFrame) -> np.ndarray:
        return super().feed(k, values.to_numpy(float))


def motion_tracks(df: DataFrame, *, keys: list[str], frame: str, id: str, block: int = 4096) -> DataFrame:
    """(keys, id, block, track): points (x, y) of each series linked by the greedy motion tracker; tracks are numbered within a
    series and go on from block to block.  Rows without a frame or position are left out."""
    return track_stream(df.where("x is not null and y is not null"), keys=keys, frame=frame, id=id, columns=["x", "y"], tracker=_PointFollower, block=block)


def assign_pairs(pairs: DataFrame, *, group: list[str], a: str, b: str, cost: str, unpaired: float) -> DataFrame:
    """(group, a, b, cost): for each group the pairs of least total cost, one to one; a pair dearer than leaving both
    sides unpaired at ``unpaired`` each is not taken.

    Groups are small (the rivals of one frame or window) and many: sorted rows stream through, many groups a call.  Pairs
    with a NULL side or cost are left out; of repeated pairs the cheapest counts.
    """
    rows = pairs.select(*group, F.col(a).alias("a_"), F.col(b).alias("b_"), F.col(cost).cast("double").alias("c_")).where("a_ is not null and b_ is not null and c_ is not null")
    rows = rows.withColumn("g_", F.to_json(F.struct(*group)))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in group)
    far = 2 * unpaired

    def best(g: pd.DataFrame) -> np.ndarray:
        """Positions of the rows of one group that are taken."""
        left, r = np.unique(g["a_"].to_numpy(), return_inverse=True)
        right, c = np.unique(g["b_"].to_numpy(), return_inverse=True)
        value = g["c_"].to_numpy()
        matrix, at = np.full((len(left), len(right)), far), np.full((len(left), len(right)), -1)
        for i in np.argsort(-value, kind="stable").tolist():
            if value[i] < far:
                matrix[r[i], c[i]], at[r[i], c[i]] = value[i], i
        taken = at[assign(matrix)]
        return taken[taken >= 0]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for g in chain(batches, [None]):
            last = g is None
            g = rest if last else g if rest is None else pd.concat([rest, g], ignore_index=True)
            if g is None or not len(g):
                continue
            names = g["g_"].to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(g)]
            if not last:  # the last group may go on in the next batch
                edges, rest = edges[:-1], g.iloc[edges[-2] :]
            taken = [lo + best(g.iloc[lo:hi]) for lo, hi in zip(edges, edges[1:])]
            if taken:
                yield g.iloc[np.concatenate(taken)][[*group, "a_", "b_", "c_"]]

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("a_", "b_")}
    done = rows.repartition("g_").sortWithinPartitions("g_", "a_", "b_").mapInPandas(kernel, f"{fields}, a_ {kinds['a_']}, b_ {kinds['b_']}, c_ double")
    return done.select(*group, F.col("a_").alias(a), F.col("b_").alias(b), F.col("c_").alias(cost))
