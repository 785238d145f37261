"""The court of a match: size, named points, and what cameras around it see."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named points that calibration documents refer to, as (name, part of the length, metres, part of the width, metres).
KEYPOINTS = """
corner_bl 0 0 0 0
corner_br 1 0 0 0
corner_tr 1 0 1 0
corner_tl 0 0 1 0
halfway_bottom .5 0 0 0
halfway_top .5 0 1 0
centre .5 0 .5 0
circle_bottom .5 0 .5 -3
circle_top .5 0 .5 3
penalty_left 0 6 .5 0
second_penalty_left 0 10 .5 0
area_goalline_top_left 0 0 .5 7.58
area_goalline_bottom_left 0 0 .5 -7.58
area_line_top_left 0 6 .5 1.58
area_line_bottom_left 0 6 .5 -1.58
post_top_left 0 0 .5 1.5
post_bottom_left 0 0 .5 -1.5
penalty_right 1 -6 .5 0
second_penalty_right 1 -10 .5 0
area_goalline_top_right 1 0 .5 7.58
area_goalline_bottom_right 1 0 .5 -7.58
area_line_top_right 1 -6 .5 1.58
area_line_bottom_right 1 -6 .5 -1.58
post_top_right 1 0 .5 1.5
post_bottom_right 1 0 .5 -1.5
sub_mark_0 .5 -10 0 0
sub_mark_1 .5 -5 0 0
sub_mark_2 .5 5 0 0
sub_mark_3 .5 10 0 0
"""


def court_size(text: str | Column) -> tuple[Column, Column]:
    """Length and width in metres of a size such as 40x20; NULL where the text is no size."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    return tuple(F.nullif(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)x(\d+(?:\.\d+)?)$", i), F.lit("")).cast("double") for i in (1, 2))


def court_keypoints(matches: DataFrame, *, keys: list[str], length: str = "court_length", width: str = "court_width") -> DataFrame:
    """(keys, name, x, y): the 29 named points of each match's court."""
    rows = [line.split() for line in KEYPOINTS.strip().splitlines()]
    points = F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(float(v)).alias(c) for v, c in zip(rest, ("a", "b", "c", "d"))]) for n, *rest in rows])
    p = matches.select(*keys, F.col(length).alias("l_"), F.col(width).alias("w_"), F.explode(points).alias("p"))
    return p.select(*keys, "p.name", (F.col("p.a") * F.col("l_") + F.col("p.b")).alias("x"), (F.col("p.c") * F.col("w_") + F.col("p.d")).alias("y"))


def tripod_camera(x: float, y: float, z: float, yaw_deg: float, hfov_deg: float, width: int = 1920, height: int = 1080, margin_deg: float = 2.0) -> list[float]:
    """Row-major 3 by 4 projection of a camera ``z`` metres above the floor that looks along ``yaw_deg`` and is tilted until the
    horizon lies ``margin_deg`` below its upper edge."""
    f = width / 2 / math.tan(math.radians(hfov_deg) / 2)
    pitch = math.atan(height / 2 / f) - math.radians(margin_deg)
    yaw = math.radians(yaw_deg)
    cy, sy, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    axes = [(sy, -cy, 0.0), (-cy * sp, -sy * sp, -cp), (cy * cp, sy * cp, -sp)]  # right, down, forward
    rows = [(*a, -(a[0] * x + a[1] * y + a[2] * z)) for a in axes]
    image = [[f * r + c * w for r, w in zip(rows[i], rows[2])] for i, c in ((0, width / 2), (1, height / 2))]
    return [*image[0], *image[1], *rows[2]]


def yaw_towards(x: float, y: float, to_x: float, to_y: float) -> float:
    """Direction in degrees from one place to another, 0 along x."""
    return math.degrees(math.atan2(to_y - y, to_x - x))


def seen_at(camera: list[float], x: Column, y: Column, z: Column | float, width: int = 1920, height: int = 1080) -> tuple[Column, Column, Column]:
    """(u, v, whether the point is in front of the camera and inside its image) of points under a 3 by 4 projection."""
    z = F.lit(z) if isinstance(z, (int, float)) else z
    p = [camera[4 * i] * x + camera[4 * i + 1] * y + camera[4 * i + 2] * z + camera[4 * i + 3] for i in range(3)]
    front = p[2] > 0.1
    depth = F.when(front, p[2])
    u, v = p[0] / depth, p[1] / depth
    return u, v, F.coalesce(front & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def floor_homography(camera: list[float]) -> list[float]:
    """Row-major matrix from image to floor of a 3 by 4 projection: the inverse of its columns for x, y and 1."""
    from pitchweave.functions.geometry import inverse_3x3

    return inverse_3x3([camera[4 * i + j] for i in range(3) for j in (0, 1, 3)])


def coverage(spark: SparkSession, cameras: dict[str, list[float]], length: float, width: float, cell: float = 1.0, head_m: float = 1.75) -> DataFrame:
    """(x, y, seen, zone, mpp): for each cell of a court the cameras that see a player there from feet to head, which these
    are, and the smallest ground distance of a pixel in any of them (NULL in a blind cell)."""
    from pitchweave.functions.geometry import metres_per_pixel

    nx, ny = math.ceil(length / cell), math.ceil(width / cell)
    grid = spark.range(nx * ny).select(((F.col("id") % nx + 0.5) * (length / nx)).alias("x"), ((F.floor(F.col("id") / nx) + 0.5) * (width / ny)).alias("y"))
    whole, scale = [], []
    for name, p in sorted(cameras.items()):
        u, v, feet = seen_at(p, F.col("x"), F.col("y"), 0.0)
        _, _, head = seen_at(p, F.col("x"), F.col("y"), head_m)
        whole.append(F.when(feet & head, F.lit(name)))
        scale.append(F.when(feet & head, metres_per_pixel(floor_homography(p), u, v)))
    names = F.array_compact(F.array(*whole))
    best = F.array_min(F.array_compact(F.array(*scale)))
    return grid.select("x", "y", F.size(names).alias("seen"), F.array_join(names, "+").alias("zone"), best.alias("mpp"))


def coverage_summary(cells: DataFrame, *, by: list[str] | None = None, cell_m2: float = 1.0, weak_mpp: float = 0.1) -> DataFrame:
    """Shares of cells seen by one and by several cameras, blind area, median, 95th percentile and largest ground distance of a
    pixel, and the share of all cells, blind ones too, that are worse than ``weak_mpp``."""
    return cells.groupBy(*(by or [])).agg(
        F.avg((F.col("seen") > 0).cast("double")).alias("seen"), F.avg((F.col("seen") > 1).cast("double")).alias("several"), (F.count(F.when(F.col("seen") == 0, 1)) * cell_m2).alias("blind_m2"),
        F.percentile("mpp", 0.5).alias("median_mpp"), F.percentile("mpp", 0.95).alias("p95_mpp"), F.max("mpp").alias("max_mpp"), F.avg((F.coalesce("mpp", F.lit(float("inf"))) > weak_mpp).cast("double")).alias("weak"),
    )
