"""Two cameras of a match brought to one another: a smooth field of shifts between their views of the same players."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.geometry import cubic_terms, hypot
from pitchweave.session import cut

#: Pairs a field needs; rounds and share of residuals kept in a round; metres beyond the lines up to which it is evaluated.
LEAST_PAIRS, ROUNDS, KEPT, CLAMP_M = 200, 3, 0.85, 3.0


def _terms(x: Column, y: Column, length: Column, width: Column) -> list[Column]:
    return cubic_terms(2 * x / length - 1, 2 * y / width - 1)


def fit_fields(pairs: DataFrame, *, keys: list[str], least: int = LEAST_PAIRS, rounds: int = ROUNDS, kept: float = KEPT) -> DataFrame:
    """(keys, bx, by, pairs, before_m, after_m): cubic fields that carry points (ax, ay) to (bx, by), by trimmed least squares.

    ``pairs`` has keys, ax, ay, bx, by, length, width.  The normal equations are sums, so a match with a third of all pairs
    is pre-aggregated like any other; only their 10 by 10 matrices are solved in groups.  Each of ``rounds`` refits
    leaves out residuals at or above the ``kept`` quantile.  Matches with fewer than ``least`` pairs give no row.
    """
    rows = pairs.where("ax is not null and ay is not null and bx is not null and by is not null").withColumnsRenamed({"bx": "tx", "by": "ty"})
    terms = _terms(F.col("ax"), F.col("ay"), F.col("length"), F.col("width"))
    rows = cut(rows.withColumn("f", F.array(*terms)).withColumns({"dx": F.col("tx") - F.col("ax"), "dy": F.col("ty") - F.col("ay")}))
    n = len(terms)
    entries = [(i, j) for i in range(n) for j in range(i, n)]
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in g.to_dict("records"):
            m = np.zeros((n, n))
            for (i, j), v in zip(entries, r["m"]):
                m[i, j] = m[j, i] = v
            field = [np.linalg.lstsq(m, np.array(r[c]), rcond=None)[0].tolist() for c in ("vx", "vy")]
            out.append({**{k: r[k] for k in keys}, "fx": field[0], "fy": field[1]})
        return pd.DataFrame(out, columns=[*keys, "fx", "fy"])

    counted = rows.groupBy(*keys).agg(F.count("*").alias("pairs"), F.percentile(hypot(F.col("dx"), F.col("dy")), 0.5).alias("before_m")).where(F.col("pairs") >= least)
    used = rows.join(counted.select(*keys), keys)
    fitted, apart = None, None
    for i in range(rounds + 1):
        sums = used.groupBy(*keys).agg(
            F.array(*[F.sum(F.col("f")[a] * F.col("f")[b]) for a, b in entries]).alias("m"),
            F.array(*[F.sum(F.col("f")[a] * F.col("dx")) for a in range(n)]).alias("vx"),
            F.array(*[F.sum(F.col("f")[a] * F.col("dy")) for a in range(n)]).alias("vy"),
        )
        fitted = cut(sums.groupBy(*keys).applyInPandas(solve, f"{fields}, fx array<double>, fy array<double>"))
        apart = rows.join(fitted, keys)
        apart = apart.withColumn("e", hypot(F.col("dx") - value(F.col("fx"), F.col("f")), F.col("dy") - value(F.col("fy"), F.col("f"))))
        if i < rounds:
            gate = apart.groupBy(*keys).agg(F.percentile("e", kept).alias("gate"))
            used = cut(apart.join(gate, keys).where("e < gate").select(*rows.columns))
    after = apart.groupBy(*keys).agg(F.percentile("e", 0.5).alias("after_m"))
    return fitted.join(counted, keys).join(after, keys).select(*keys, F.col("fx").alias("bx"), F.col("fy").alias("by"), "pairs", "before_m", "after_m")


def value(field: Column, terms: Column) -> Column:
    return F.aggregate(F.zip_with(field, terms, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def apply_fields(rows: DataFrame, fields: DataFrame, *, keys: list[str], sign: Column, x: str, y: str, length: str, width: str) -> DataFrame:
    """``rows`` with (x_aligned, y_aligned): moved by half the field, the one way or the other by ``sign``.

    The field is evaluated at the position clipped to ``CLAMP_M`` beyond the lines, and added to the raw position, so
    applying it again to the same raw positions changes nothing.  Rows of matches without a field stay where they are.
    """
    cx = F.greatest(F.least(F.col(x), F.col(length) + CLAMP_M), F.lit(-CLAMP_M))
    cy = F.greatest(F.least(F.col(y), F.col(width) + CLAMP_M), F.lit(-CLAMP_M))
    joined = rows.join(fields.select(*keys, F.col("bx").alias("fx_"), F.col("by").alias("fy_")), keys, "left")
    terms = F.array(*_terms(cx, cy, F.col(length), F.col(width)))
    moved = joined.withColumns({f"{c}_aligned": F.col(v) + F.coalesce(0.5 * sign * value(F.col(f), terms), F.lit(0.0)) for c, v, f in (("x", x, "fx_"), ("y", y, "fy_"))})
    return moved.drop("fx_", "fy_")
