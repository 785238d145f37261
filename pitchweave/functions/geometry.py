"""Projective geometry, covariances and box overlap as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse_3x3(h: list[float]) -> list[float]:
    """Inverse of a row-major 3x3 matrix, scaled so that its last entry is 1."""
    a, b, c, d, e, f, g, i, j = h
    adj = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return [x / adj[8] for x in adj]


def project(h: list[float], u: Column, v: Column) -> tuple[Column, Column]:
    """Projective image of (u, v) under a row-major 3x3 matrix."""
    w = h[6] * u + h[7] * v + h[8]
    return (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w


def jacobian(h: list[float], u: Column, v: Column, step: float = 1.0) -> tuple[Column, Column, Column, Column]:
    """(dx/du, dx/dv, dy/du, dy/dv) by central differences of one pixel."""
    xr, yr = project(h, u + step, v)
    xl, yl = project(h, u - step, v)
    xd, yd = project(h, u, v + step)
    xu, yu = project(h, u, v - step)
    return (xr - xl) / (2 * step), (xd - xu) / (2 * step), (yr - yl) / (2 * step), (yd - yu) / (2 * step)


def metres_per_pixel(h: list[float], u: Column, v: Column) -> Column:
    """Largest singular value of the forward-difference Jacobian: the worst ground distance a pixel stands for."""
    x, y = project(h, u, v)
    xu, yu = project(h, u + 1.0, v)
    xv, yv = project(h, u, v + 1.0)
    a, b, c, d = xu - x, xv - x, yu - y, yv - y
    s, det = a * a + b * b + c * c + d * d, a * d - b * c
    return F.sqrt((s + F.sqrt(F.greatest(s * s - 4 * det * det, F.lit(0.0)))) / 2)


def box_covariance(j: tuple[Column, Column, Column, Column], w: Column, h: Column) -> tuple[Column, Column, Column]:
    """(xx, xy, yy) of a foot point: pixel noise of 3 % of the width and 5 % of the height, at least a pixel, carried by
    the Jacobian, plus 0.15 m of its own."""
    su, sv = F.greatest(0.03 * w, F.lit(1.0)), F.greatest(0.05 * h, F.lit(1.0))
    a, b, c, d = j
    return a * a * su * su + b * b * sv * sv + 0.15**2, a * c * su * su + b * d * sv * sv, c * c * su * su + d * d * sv * sv + 0.15**2


def largest_eigenvalue(xx: Column, xy: Column, yy: Column) -> Column:
    return 0.5 * (xx + yy) + F.sqrt(0.25 * (xx - yy) * (xx - yy) + xy * xy)


def mahalanobis2(dx: Column, dy: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """Squared Mahalanobis distance for a symmetric 2x2 covariance."""
    return (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / (xx * yy - xy * xy)


def overlap(a: str, b: str, expand: float = 0.0) -> Column:
    """Intersection over union of the boxes (x1, y1, x2, y2) of two aliases, each widened by ``expand`` of its size."""

    def side(alias: str, lo: str, hi: str) -> tuple[Column, Column]:
        low, high = F.col(f"{alias}.{lo}"), F.col(f"{alias}.{hi}")
        grow = (high - low) * expand
        return low - grow, high + grow

    ax1, ax2 = side(a, "x1", "x2")
    ay1, ay2 = side(a, "y1", "y2")
    bx1, bx2 = side(b, "x1", "x2")
    by1, by2 = side(b, "y1", "y2")
    inner = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0.0)) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0.0))
    return inner / F.greatest((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inner, F.lit(1e-9))


def cubic_terms(x: Column, y: Column) -> list[Column]:
    """The ten terms of a cubic field over a normalised position."""
    return [F.lit(1.0), x, y, x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y]


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def contains(x: str | Column, y: str | Column, length: str | Column, width: str | Column, margin: float = 0.0) -> Column:
    """Whether a position lies on a court or up to ``margin`` metres beyond its lines, borders included."""
    x, y, length, width = (F.col(c) if isinstance(c, str) else c for c in (x, y, length, width))
    return x.between(F.lit(-margin), length + margin) & y.between(F.lit(-margin), width + margin)


def shifted(h: list[float], dx: float, dy: float) -> list[float]:
    """The image-to-pitch matrix of a camera whose image has moved by (dx, dy) pixels: points are moved back first."""
    return [v for r in range(3) for v in (h[3 * r], h[3 * r + 1], h[3 * r + 2] - h[3 * r] * dx - h[3 * r + 1] * dy)]


def reachable(dx: Column, dy: Column, seconds: Column, spread: Column | float = 0.0, *, vmax: float = 9.0, slack: float = 1.0) -> Column:
    """Whether a player can cover (dx, dy) in the time; ``spread`` is the largest eigenvalue of both positions' covariance."""
    return hypot(dx, dy) <= vmax * seconds + slack + 3 * F.sqrt(F.lit(spread) if isinstance(spread, float) else spread)


def view_angle(focal_mm: Column | float) -> Column:
    """Horizontal angle of view in radians of a lens on the video crop of a small-format sensor 34.62 mm wide."""
    return 2 * F.atan(F.lit(17.31) / focal_mm)


def hue_of(number: Column) -> Column:
    """Hue of an id, 0 to 1, spread by the golden ratio."""
    return F.pmod(number * 0.618034, F.lit(1.0))


def clipped(box: tuple[Column, Column, Column, Column], tile: tuple[Column, Column, Column, Column]) -> tuple[tuple[Column, Column, Column, Column], Column]:
    """A box (x1, y1, x2, y2) clipped to a tile, in the tile's coordinates, and the share of its area that is inside."""
    x1, y1 = F.greatest(box[0], tile[0]), F.greatest(box[1], tile[1])
    x2, y2 = F.least(box[2], tile[2]), F.least(box[3], tile[3])
    inside = F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))
    return (x1 - tile[0], y1 - tile[1], x2 - tile[0], y2 - tile[1]), inside / F.nullif((box[2] - box[0]) * (box[3] - box[1]), F.lit(0.0))
