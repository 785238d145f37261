"""Camera calibrations as a table: fitted to known points, joined by camera, applied to image points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.kernels import robust_homography

#: Points of a camera that a calibration is fitted to at most, and the error in metres within which a point agrees with it.
SAMPLE, TOLERANCE_M = 2_000, 0.35


def fit_calibrations(points: DataFrame, *, keys: list[str], uv: tuple[str, str] = ("u", "v"), xy: tuple[str, str] = ("x", "y"), sample: int = SAMPLE, tolerance: float = TOLERANCE_M) -> DataFrame:
    """(keys, h ARRAY<DOUBLE>, used, rms_m): the homography from image to pitch that most points of each camera agree with.

    ``h`` is row-major with a last entry of 1.  At most about ``sample`` points of a camera, drawn by hash, are fitted, so a
    camera with a third of all rows is no larger a group than any other.  Cameras with fewer than four usable points
    (NULL, NaN and infinite ones are none) give no row; a NULL key is a camera of its own.
    """
    cols = [*uv, *xy]
    usable = " and ".join(f"abs(`{c}`) < double('infinity')" for c in cols)
    rows = points.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).where(usable).distinct()
    size = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    drawn = rows.alias("r").join(size.alias("s"), on).where(F.pmod(F.xxhash64(*[f"r.{c}" for c in cols]), F.lit(1 << 30)) < F.lit((1 << 30) * float(sample)) / F.col("n_")).select("r.*")
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(cols)
        out = {k: g[k].iloc[:1].tolist() for k in keys}
        src, dst = g[list(uv)].to_numpy(), g[list(xy)].to_numpy()
        if len(src) < 4 or np.linalg.matrix_rank(np.c_[src, np.ones(len(src))]) < 3:
            return pd.DataFrame({**out, "h": [None], "used": [0], "rms_m": [None]})
        h, good = robust_homography(src, dst, tolerance)
        p = np.c_[src[good], np.ones(int(good.sum()))] @ h.T
        rms = float(np.sqrt(np.mean(((p[:, :2] / p[:, 2:] - dst[good]) ** 2).sum(axis=1))))
        return pd.DataFrame({**out, "h": [h.ravel().tolist()], "used": [int(good.sum())], "rms_m": [rms]})

    return drawn.groupBy(*keys).applyInPandas(kernel, f"{fields}, h array<double>, used bigint, rms_m double").where("h is not null")


def project_by(h: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Projective image of (u, v) under the row-major matrix in an array column."""
    w = h[6] * u + h[7] * v + h[8]
    return (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w


def shifted_by(h: Column, dx: Column, dy: Column) -> Column:
    """The matrix in an array column for an image that has moved by (dx, dy) pixels."""
    return F.array(*[h[3 * r + c] if c < 2 else h[3 * r + 2] - h[3 * r] * dx - h[3 * r + 1] * dy for r in range(3) for c in range(3)])


def inverse_by(h: Column) -> Column:
    """Inverse of the row-major matrix in an array column, scaled so that its last entry is 1; NULL where it has none."""
    a, b, c, d, e, f, g, i, j = (h[n] for n in range(9))
    adj = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    last = F.nullif(adj[8], F.lit(0.0))
    return F.when(last.isNotNull(), F.array(*[x / last for x in adj]))


def framing(calibrations: DataFrame, courts: DataFrame, *, keys: list[str], cell: float = 1.0) -> DataFrame:
    """(keys, cells, seen, left, right, above, below, mpp): how much of its court each camera has in its image.

    ``calibrations`` has keys, h, width and height in pixels; ``courts`` has the first key, length and width of the court in
    metres as court_length and court_width.  A cell is seen if its centre is in the image; else it counts by where it lies
    (beside the image before above or below it).  ``mpp`` is the median ground distance of a pixel over the seen cells.
    """
    from pitchweave.functions.geometry import hypot

    grid = courts.select(keys[0], F.explode(F.sequence(F.lit(0), F.ceil(F.col("court_length") / cell).cast("int") - 1)).alias("cx"), "court_length", "court_width")
    grid = grid.withColumn("cy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("court_width") / cell).cast("int") - 1)))
    x, y = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    rows = calibrations.withColumn("inv", inverse_by(F.col("h"))).where("inv is not null").join(grid.select(keys[0], x.alias("x"), y.alias("y")), keys[0])
    u, v = project_by(F.col("inv"), F.col("x"), F.col("y"))
    rows = rows.withColumns({"u": u, "v": v})
    px, py = project_by(F.col("h"), F.col("u") + 1, F.col("v"))
    qx, qy = project_by(F.col("h"), F.col("u"), F.col("v") + 1)
    scale = F.greatest(hypot(px - F.col("x"), py - F.col("y")), hypot(qx - F.col("x"), qy - F.col("y")))
    side = F.when(F.col("u") < 0, "left").when(F.col("u") >= F.col("width"), "right").when(F.col("v") < 0, "above").when(F.col("v") >= F.col("height"), "below").otherwise("seen")
    rows = rows.withColumn("side", side).withColumn("mpp", F.when(F.col("side") == "seen", scale))
    return rows.groupBy(*keys).agg(F.count("*").alias("cells"), *[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("seen", "left", "right", "above", "below")], F.percentile("mpp", 0.5).alias("mpp"))


def calibrated(rows: DataFrame, calibrations: DataFrame, *, keys: list[str], missing: str = "error") -> DataFrame:
    """``rows`` with the calibration of their camera.  Cameras without one are an error, or left out with ``missing="skip"``."""
    if missing == "error":
        absent = rows.select(*keys).distinct().join(calibrations, keys, "left_anti").limit(5).collect()
        if absent:
            raise ValueError(f"no calibration for {[tuple(r) for r in absent]}")
    return rows.join(calibrations, keys)


def moves_timeline(moves: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, from_s, dx, dy): versions of a camera's image shift from its moves (keys, t, dx, dy), which add up; the first
    version, without a shift, is valid from the start.  A camera moves a few times in a match."""
    from pyspark.sql import Window as W

    line = W.partitionBy(*keys).orderBy("t", "dx", "dy").rowsBetween(W.unboundedPreceding, 0)
    steps = moves.where("t is not null").select(*keys, F.col("t").alias("from_s"), F.sum("dx").over(line).alias("dx"), F.sum("dy").over(line).alias("dy"))
    start = moves.select(*keys).distinct().select(*keys, F.lit(float("-inf")).alias("from_s"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return start.unionByName(steps)
