"""Order-dependent choices among a frame's or a series' rows: overlapping boxes, one source frame each, the ball's path, broken tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchweave.functions import kernels
from pitchweave.functions.kernels import link_ball
from pitchweave.operators.identity import expanded_overlap
from pitchweave.operators.smoothing import track_stream


class _Suppressor:
    """Marks the boxes of a frame that overlap a surer one too much: 1 kept, 0 not."""

    def __init__(self, most: float):
        self.most = most

    def feed(self, k: np.ndarray, values: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(k), np.int64)
        box, conf = values[["x1", "y1", "x2", "y2"]].to_numpy(float), values["conf"].to_numpy(float)
        for rows in np.split(np.arange(len(k)), np.flatnonzero(k[1:] != k[:-1]) + 1):
            left = rows[np.argsort(-conf[rows], kind="stable")]
            while len(left):
                out[left[0]] = 1
                left = left[1:][expanded_overlap(box[left[:1]], box[left[1:]], 0.0)[0] <= self.most]
        return out


def suppress_overlaps(boxes: DataFrame, *, keys: list[str], frame: str, id: str = "box_id", most: float = 0.5) -> DataFrame:
    """(keys, id): boxes (x1, y1, x2, y2, conf) of each frame without those that overlap a surer one by over ``most``.

    Of equally sure boxes the smaller id goes first.  Boxes with a NULL side or confidence are left out.
    """
    rows = boxes.where(" and ".join(f"{c} is not null" for c in ("x1", "y1", "x2", "y2", "conf")))
    kept = track_stream(rows, keys=keys, frame=frame, id=id, columns=["x1", "y1", "x2", "y2", "conf"], tracker=lambda: _Suppressor(most))
    return kept.where("track = 1").select(*keys, id)


class _OneEach:
    """Hands a camera's frames to ``one_frame_each`` batch by batch."""

    def __init__(self):
        self.last = -(1 << 62)

    def feed(self, k: np.ndarray, values: pd.DataFrame) -> np.ndarray:
        out = kernels.one_frame_each(values["position"].to_numpy(float), self.last)
        taken = out[out != -1]
        self.last = int(taken[-1]) if len(taken) else self.last
        return out


def one_frame_each(frames: DataFrame, *, keys: list[str], id: str = "fid") -> DataFrame:
    """(keys, id, k): source frames (keys, id, position on the grid), each on a grid frame of its own, in order of position;
    k is NULL for a surplus frame."""
    rows = frames.where("position is not null and not isnan(position)").withColumn("order_", F.rint(F.col("position") * 1e6).cast("bigint"))
    placed = track_stream(rows, keys=keys, frame="order_", id=id, columns=["position"], tracker=_OneEach, block=1 << 40)
    return placed.select(*keys, id, F.when(F.col("track") != -1, F.col("track")).cast("int").alias("k"))


def ball_paths(candidates: DataFrame, *, video: str = "video", frame: str = "frame", step: float = 60.0, sure: float = 0.2, gap: int = 8) -> DataFrame:
    """(video, frame, u, v, conf, source): the ball in each frame of its paths, ``detected`` or ``interpolated`` in holes of up to
    ``gap`` frames.

    Paths grow both ways from the surest candidates (u, v, conf); weak ones of under three points are dropped.  A video is
    one group: its candidates are few a frame, and which of them is the ball hangs on the whole of it.
    """
    rows = candidates.where("u is not null and v is not null and conf is not null").select(F.col(video).alias("video_"), F.col(frame).cast("bigint").alias("f_"), F.col("u").cast("double"), F.col("v").cast("double"), F.col("conf").cast("double"))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["f_", "conf", "u", "v"], ascending=[True, False, True, True])
        f, uv, conf = g["f_"].to_numpy(), g[["u", "v"]].to_numpy(), g["conf"].to_numpy()
        own = np.flatnonzero(link_ball(f, uv, conf, step, sure, gap))
        own = own[np.r_[True, f[own][1:] != f[own][:-1]]] if len(own) else own
        at, last = f[own], None
        out = []
        for i, n in zip(own.tolist(), at.tolist()):
            if last is not None and 1 < n - f[last] <= gap + 1:
                for m in range(int(f[last]) + 1, n):
                    s = (m - f[last]) / (n - f[last])
                    p = (1 - s) * uv[last] + s * uv[i]
                    out.append((m, p[0], p[1], 0.0, "interpolated"))
            out.append((n, uv[i, 0], uv[i, 1], conf[i], "detected"))
            last = i
        return pd.DataFrame(out, columns=["f_", "u", "v", "conf", "source"]).assign(video_=g["video_"].iloc[0])[["video_", "f_", "u", "v", "conf", "source"]]

    kind = rows.schema["video_"].dataType.simpleString()
    done = rows.groupBy("video_").applyInPandas(kernel, f"video_ {kind}, f_ bigint, u double, v double, conf double, source string")
    return done.withColumnsRenamed({"video_": video, "f_": frame})


def stitch_tracks(ends: DataFrame, *, vmax: float = 7.0, slack: float = 1.5, gap_s: float = 4.0) -> DataFrame:
    """(match_id, track_id, chain): tracks joined end to start, the pair that needs the least speed first; one to one.

    ``ends`` has match_id, track_id, first, fx, fy, last, lx, ly, team and fps.  Candidates (starts within ``gap_s`` after an end,
    within reach, of no two known teams) are a join; which of them hold is decided match by match on those alone.  A chain is
    named by its smallest track.
    """
    from pitchweave.operators.graphs import components
    from pitchweave.operators.joins import band_join

    a = ends.select("match_id", "fps", F.col("track_id").alias("a"), F.col("last").alias("ak"), F.col("lx").alias("ax"), F.col("ly").alias("ay"), F.col("team").alias("at"))
    b = ends.select("match_id", F.col("track_id").alias("b"), F.col("first").alias("bk"), F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("team").alias("bt"))
    pairs = band_join(a, b, keys=["match_id"], left_at="ak", right_at="bk", least=1, most=1000).where((F.col("bk") - F.col("ak")) / F.col("fps") <= gap_s)
    d, dt = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2), (F.col("bk") - F.col("ak")) / F.col("fps")
    clash = F.coalesce(F.col("at").isin("A", "B") & F.col("bt").isin("A", "B") & (F.col("at") != F.col("bt")), F.lit(False))
    pairs = pairs.where(~clash & (d <= vmax * dt + slack)).select("match_id", "a", "b", (d / dt).alias("speed"))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["speed", "a", "b"])
        used_a, used_b, keep = set(), set(), []
        for x, y in zip(g["a"].tolist(), g["b"].tolist()):
            keep.append(x not in used_a and y not in used_b)
            if keep[-1]:
                used_a.add(x)
                used_b.add(y)
        return g[np.array(keep, bool)][["match_id", "a", "b"]]

    links = pairs.groupBy("match_id").applyInPandas(kernel, "match_id string, a bigint, b bigint")
    return components(ends.select("match_id", "track_id"), links, keys=["match_id"], node="track_id", a="a", b="b").withColumnRenamed("component", "chain")
