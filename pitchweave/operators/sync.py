"""Clocks of cameras from their sound: onset envelopes, offsets of segments, and a robust line through them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.functions.kernels import best_lag
from pitchweave.operators.blocks import core, in_blocks, series

#: Samples of an envelope's step and of a second; seconds of a segment; largest offset; confidence a segment needs.
HOP, RATE, SEGMENT_S, MOST_S, SURE = 256, 16_000, 60.0, 5.0, 3.0


def envelopes(audio: DataFrame, *, keys: list[str], hop: int = HOP) -> DataFrame:
    """(keys, j, onset): how much louder each step of ``hop`` samples is than the one before, in units of its series' spread.

    ``audio`` has keys, ``i`` (sample number) and ``sample``.  Samples are summed up by step before anything else, and series
    are cut into blocks, so an hour of one camera is spread over many tasks.
    """
    power = audio.where("i is not null and sample is not null").groupBy(*keys, F.floor(F.col("i") / hop).alias("j")).agg(F.sqrt(F.avg(F.col("sample").cast("double") ** 2)).alias("rms"))
    rows = in_blocks(power.withColumn("loud", F.log(F.col("rms") + 1e-6)), "j", before=1, after=0)
    line = series(keys, "j")
    rise = F.when(F.col("j") - F.lag("j").over(line) == 1, F.greatest(F.col("loud") - F.lag("loud").over(line), F.lit(0.0)))
    rows = core(rows.withColumn("rise", F.coalesce(rise, F.lit(0.0))))
    spread = rows.groupBy(*keys).agg(F.avg("rise").alias("m"), F.stddev_pop("rise").alias("s"))
    return rows.join(spread, keys).select(*keys, "j", ((F.col("rise") - F.col("m")) / F.greatest("s", F.lit(1e-9))).alias("onset"))


def segment_offsets(envelope: DataFrame, *, camera: str, reference: str, keys: list[str] | None = None, step_s: float = HOP / RATE, segment_s: float = SEGMENT_S, most_s: float = MOST_S) -> DataFrame:
    """(keys, camera, t, offset_s, confidence): the lag of each camera's segments behind the reference, by cross-correlation.

    ``envelope`` has keys, camera, j, onset; ``reference`` names the camera that all others are compared with.  A segment is
    one group of a few thousand steps; ``offset_s`` is what must be added to the camera's time.
    """
    keys = keys or []
    n, most = int(segment_s / step_s), int(most_s / step_s)
    part = envelope.withColumn("segment", F.floor(F.col("j") / n))
    other = part.where(F.col(camera) != reference).withColumnRenamed(camera, "camera_")
    names = other.select(*keys, "camera_").distinct()
    own = part.where(F.col(camera) == reference).drop(camera)
    own = own.join(names, keys) if keys else own.join(F.broadcast(names))  # every camera is compared with the reference: a few rows
    both = other.select(*keys, "camera_", "segment", "j", F.col("onset").alias("o"), F.lit(None).cast("double").alias("r")).unionByName(own.select(*keys, "camera_", "segment", "j", F.lit(None).cast("double").alias("o"), F.col("onset").alias("r")))
    both = both.groupBy(*keys, "camera_", "segment", "j").agg(F.max("o").alias("o"), F.max("r").alias("r"))
    fields = "".join(f"`{k}` {both.schema[k].dataType.simpleString()}, " for k in keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        j = g["j"].to_numpy()
        at = j - int(g["segment"].iloc[0]) * n
        series_ = [np.zeros(n), np.zeros(n)]
        for v, c in zip(series_, ("r", "o")):
            ok = np.isfinite(g[c].to_numpy(float))
            v[at[ok]] = g[c].to_numpy(float)[ok]
        first = {k: [g[k].iloc[0]] for k in keys}
        if min(v.std() for v in series_) == 0:
            return pd.DataFrame({**first, "camera_": [g["camera_"].iloc[0]], "t": [float(g["segment"].iloc[0] + 0.5) * n * step_s], "offset_s": [np.nan], "confidence": [0.0]})
        lag, sure = best_lag(series_[0], series_[1], most)
        return pd.DataFrame({**first, "camera_": [g["camera_"].iloc[0]], "t": [float(g["segment"].iloc[0] + 0.5) * n * step_s], "offset_s": [-lag * step_s], "confidence": [min(sure, 1e9)]})

    kind = both.schema["camera_"].dataType.simpleString()
    done = both.groupBy(*keys, "camera_", "segment").applyInPandas(kernel, f"{fields}camera_ {kind}, t double, offset_s double, confidence double")
    return done.where(~F.isnan("offset_s")).withColumnRenamed("camera_", camera)


def clock_line(offsets: DataFrame, *, keys: list[str], sure: float = SURE, span_s: float = 600.0) -> DataFrame:
    """(keys, offset_s, drift, used, stderr_s): the clock of each camera from its segments' offsets (t, offset_s, confidence).

    Segments less sure than ``sure``, and those beyond three scatters (of the median absolute deviation) of the median or of
    a first line, are left out.  A drift is only kept where it is over 2.5 times its error and the segments span ten minutes.
    """
    rows = offsets.where((F.col("confidence") >= sure) & F.col("offset_s").isNotNull())
    slope, cut_ = (F.regr_slope("offset_s", "t"), F.regr_intercept("offset_s", "t"))
    line = rows.groupBy(*keys).agg(F.percentile("offset_s", 0.5).alias("m"), slope.alias("b"), cut_.alias("a"), (F.max("t") - F.min("t")).alias("span"))
    rows = rows.join(line, keys)
    rest = F.abs(F.col("offset_s") - F.when(F.col("span") > span_s, F.col("a") + F.col("b") * F.col("t")).otherwise(F.col("m")))
    rows = rows.withColumn("e", rest)
    mad = rows.groupBy(*keys).agg((1.4826 * F.percentile("e", 0.5)).alias("mad"))
    kept = rows.join(mad, keys).where(F.col("e") <= 3 * F.greatest("mad", F.lit(1e-3)))
    sxx = F.var_pop("t") * F.count("*")
    fit = kept.groupBy(*keys).agg(slope.alias("b"), cut_.alias("a"), F.percentile("offset_s", 0.5).alias("m"), F.count("*").alias("used"), sxx.alias("sxx"), F.regr_syy("offset_s", "t").alias("syy"), F.regr_sxy("offset_s", "t").alias("sxy"), (F.max("t") - F.min("t")).alias("span"), F.stddev_samp("offset_s").alias("sd"))
    noise = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("used") - 2, F.lit(1)))
    error = noise / F.sqrt(F.nullif("sxx", F.lit(0.0)))
    real = F.coalesce((F.col("used") > 2) & (F.col("span") > span_s) & (F.abs("b") > 2.5 * error), F.lit(False))
    return fit.select(*keys, F.when(real, F.col("a")).otherwise(F.col("m")).alias("offset_s"), F.when(real, F.col("b")).otherwise(F.lit(0.0)).alias("drift"), "used", (F.when(real, noise).otherwise(F.col("sd")) / F.sqrt("used")).alias("stderr_s"))


def loudest_moments(envelope: DataFrame, *, keys: list[str], n: int, half_s: float = 15.0, step_s: float = HOP / RATE) -> DataFrame:
    """(keys, moment, t): the strongest onset near each of ``n`` evenly spaced times of a series; of equal ones the first."""
    span = envelope.groupBy(*keys).agg(F.max("j").alias("last"))
    middle = span.withColumn("moment", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("at", F.col("last") * F.col("moment") / (n + 1))
    width = max(int(half_s / step_s), 1)
    near = middle.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - width) / width), F.floor((F.col("at") + width) / width))))
    rows = envelope.withColumn("bucket", F.floor(F.col("j") / width)).join(near, [*keys, "bucket"]).where(F.abs(F.col("j") - F.col("at")) <= width)
    return rows.groupBy(*keys, "moment").agg(F.min(F.struct((-F.col("onset")).alias("o"), "j")).alias("b")).select(*keys, "moment", (F.col("b.j") * step_s).alias("t"))


def implicit_starts(segments: DataFrame, *, keys: list[str]) -> DataFrame:
    """``segments`` (keys, seq, t0, duration) with ``start``: t0, or where it is NULL the end of the segment before.

    Durations add up from the last segment with a t0; segments before any t0 start from 0.  A camera has a few segments.
    """
    line = W.partitionBy(*keys).orderBy("seq")
    rows = segments.withColumn("part", F.count("t0").over(line))
    inside = W.partitionBy(*keys, "part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    base = F.first("t0").over(W.partitionBy(*keys, "part").orderBy("seq"))
    return rows.withColumn("start", F.coalesce(base, F.lit(0.0)) + F.coalesce(F.sum("duration").over(inside), F.lit(0.0))).drop("part")


def contiguous_chunks(chunks: DataFrame, *, keys: list[str]) -> DataFrame:
    """``chunks`` (keys, arrived, offset, length) with ``accepted``: whether each begins where the accepted ones before it
    end.  As an append is only accepted at the end, that is the case as long as no chunk before it was refused or repeated."""
    line = W.partitionBy(*keys).orderBy("arrived").rowsBetween(W.unboundedPreceding, -1)
    ends = F.coalesce(F.max(F.col("offset") + F.col("length")).over(line), F.lit(0))
    fits = F.col("offset") == ends
    whole = F.min(fits.cast("int")).over(W.partitionBy(*keys).orderBy("arrived").rowsBetween(W.unboundedPreceding, 0))
    return chunks.withColumn("accepted", whole == 1)
