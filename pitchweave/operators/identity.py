"""From boxes to identities: careful tracklets of a camera, views of one player joined, pieces linked within windows, windows chained."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.kernels import assign
from pitchweave.operators.graphs import components
from pitchweave.operators.smoothing import assign_pairs, track_stream


@dataclass(frozen=True)
class TrackletParams:
    """Expansions of boxes tried one after the other, least overlap, appearance distance and pitch speed that forbid a link,
    overlap with another box and advantage over a rival below which a tracklet ends, frames unseen after which it does."""

    expansions: tuple[float, ...] = (0.7, 0.85, 1.0)
    least_overlap: float = 0.3
    appearance: float = 0.3
    vmax: float = 9.0
    slack: float = 1.0
    crowded: float = 0.5
    margin: float = 0.1
    gap: int = 3
    keep: float = 0.9


@dataclass(frozen=True)
class LinkParams:
    """Seconds of a window and of its overlap with the next, speed and slack of a player, weights of appearance and motion,
    dearest link, cost of unknown appearance, frames two pieces of one player may overlap."""

    window_s: float = 360.0
    overlap_s: float = 60.0
    vmax: float = 8.0
    slack: float = 1.0
    appearance: float = 1.0
    motion: float = 0.35
    dearest: float = 0.55
    unknown: float = 0.5
    shared: int = 1
    least_boxes: int = 10
    least_share: float = 0.5


def expanded_overlap(a: np.ndarray, b: np.ndarray, expand: float) -> np.ndarray:
    """Intersection over union of all boxes (x1, y1, x2, y2) of ``a`` with all of ``b``, each widened by ``expand`` of its size."""

    def wide(x: np.ndarray) -> np.ndarray:
        size = x[:, 2:] - x[:, :2]
        return np.c_[x[:, :2] - expand * size / 2, x[:, 2:] + expand * size / 2]

    a, b = wide(a)[:, None], wide(b)[None]
    inner = np.prod(np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0), axis=2)
    area = [np.prod(x[..., 2:] - x[..., :2], axis=2) for x in (a, b)]
    return inner / np.maximum(area[0] + area[1] - inner, 1e-9)


class TrackletBuilder:
    """Links the boxes of one camera only where there is no doubt, and ends tracklets where there is."""

    def __init__(self, params: TrackletParams, fps: float = 10.0, dim: int = 512):
        self.p, self.fps, self.dim, self.number = params, fps, dim, 0
        self.id, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.box, self.xy, self.look = np.zeros((0, 4)), np.zeros((0, 2)), np.zeros((0, dim))

    def feed(self, k: np.ndarray, values: pd.DataFrame) -> np.ndarray:
        box, xy = values[["x1", "y1", "x2", "y2"]].to_numpy(float), values[["x", "y"]].to_numpy(float)
        look = np.zeros((len(k), self.dim))
        for i, v in enumerate(values["reid"].tolist()):
            if v is not None and len(v) == self.dim:
                look[i] = v
        look /= np.maximum(np.linalg.norm(look, axis=1, keepdims=True), 1e-9)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        return np.concatenate([self._frame(int(k[lo]), box[lo:hi], xy[lo:hi], look[lo:hi]) for lo, hi in zip(edges, edges[1:]) if hi > lo] or [np.zeros(0, np.int64)])

    def _frame(self, frame: int, box: np.ndarray, xy: np.ndarray, look: np.ndarray) -> np.ndarray:
        p = self.p
        self._keep(frame - self.last <= p.gap)
        known = (np.linalg.norm(self.look, axis=1) > 0.5)[:, None] & (np.linalg.norm(look, axis=1) > 0.5)[None]
        unlike = 1 - self.look @ look.T
        far = np.linalg.norm(self.xy[:, None] - xy[None], axis=2) > p.vmax * (frame - self.last)[:, None] / self.fps + p.slack
        forbidden = (known & (unlike > p.appearance)) | far
        track = np.full(len(box), -1)
        doubtful = np.zeros(len(self.id), bool)
        free_t, free_j = np.arange(len(self.id)), np.arange(len(box))
        for e in p.expansions:
            if not len(free_t) or not len(free_j):
                break
            overlap = expanded_overlap(self.box[free_t], box[free_j], e)
            cost = 1 - overlap
            cost = np.where(known[np.ix_(free_t, free_j)], np.minimum(cost, unlike[np.ix_(free_t, free_j)]), cost)
            cost = np.where(forbidden[np.ix_(free_t, free_j)] | (overlap < p.least_overlap), 10.0, cost)
            r, c = assign(cost)
            ranked_r, ranked_c = np.sort(cost, axis=1), np.sort(cost, axis=0)
            done_t, done_j = [], []
            for i, j in zip(r, c):
                if cost[i, j] >= 1:
                    continue
                rivals = [ranked[1] for ranked in (ranked_r[i], ranked_c[:, j]) if len(ranked) > 1 and ranked[1] < 1]
                done_t.append(i)
                if rivals and min(rivals) - cost[i, j] < p.margin:  # could be another's: both begin anew
                    doubtful[free_t[i]] = True
                    continue
                track[free_j[j]] = free_t[i]
                done_j.append(j)
            free_t, free_j = np.delete(free_t, done_t), np.delete(free_j, done_j)
        pile = expanded_overlap(box, box, 0.0)
        np.fill_diagonal(pile, 0)
        crowded = pile.max(axis=1, initial=0) > p.crowded
        out = np.empty(len(box), np.int64)
        for j, t in enumerate(track):
            if t >= 0 and not crowded[j]:
                out[j] = self.id[t]
                self.last[t], self.box[t], self.xy[t] = frame, box[j], xy[j]
                if np.linalg.norm(look[j]) > 0.5:
                    mixed = p.keep * self.look[t] + (1 - p.keep) * look[j] if np.linalg.norm(self.look[t]) > 0.5 else look[j]
                    self.look[t] = mixed / np.linalg.norm(mixed)
            else:
                out[j] = self.number
                self.number += 1
        new = np.flatnonzero((track < 0) | crowded)
        ended = doubtful.copy()
        ended[track[(track >= 0) & crowded]] = True
        self._keep(~ended)
        self.id, self.last = np.r_[self.id, out[new]], np.r_[self.last, np.full(len(new), frame)]
        self.box, self.xy, self.look = np.r_[self.box, box[new]], np.r_[self.xy, xy[new]], np.r_[self.look, look[new]]
        return out

    def _keep(self, rows: np.ndarray) -> None:
        self.id, self.last, self.box, self.xy, self.look = (v[rows] for v in (self.id, self.last, self.box, self.xy, self.look))


def camera_tracklets(boxes: DataFrame, *, params: TrackletParams = TrackletParams(), fps: float = 10.0, dim: int = 512) -> DataFrame:
    """(match_id, camera, box_id, block, track): boxes (k, x1 .. y2, x, y, reid) of each camera in careful tracklets.

    Boxes without a frame, a box or a position are left out; those without an appearance vector are linked by overlap.
    Tracks are numbered within a camera.
    """
    rows = boxes.where("x is not null and y is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    return track_stream(rows, keys=["match_id", "camera"], frame="k", id="box_id", columns=["x1", "y1", "x2", "y2", "x", "y", "reid"], tracker=lambda: TrackletBuilder(params, fps, dim))


def paired_views(points: DataFrame, *, gate: float = 1.0, shared: int = 10, inside: float = 0.7) -> DataFrame:
    """(match_id, a, b, cost): tracklets of two cameras that show one player, one to one.

    ``points`` has match_id, camera, piece, k, x, y.  Two tracklets are candidates if they share ten frames, are a metre apart
    in the median and within two in seven tenths; of a match's candidates those of least total distance are paired.
    """
    a, b = points.alias("a"), points.alias("b")
    d = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    pairs = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k"), F.col("a.camera") < F.col("b.camera"), d < 6 * gate])
    pairs = pairs.groupBy("a.match_id", F.col("a.camera").alias("ca"), F.col("b.camera").alias("cb"), F.col("a.piece").alias("a"), F.col("b.piece").alias("b"))
    stats = pairs.agg(F.count("*").alias("n"), F.percentile(d, 0.5).alias("cost"), F.avg((d <= 2 * gate).cast("double")).alias("near"), F.min("a.k").alias("first"))
    good = stats.where((F.col("n") >= shared) & (F.col("cost") <= gate) & (F.col("near") >= inside))
    # a tracklet may go with several of the other camera one after the other: stretches of 256 frames are paired apart
    good = good.withColumn("part", F.floor(F.col("first") / 256))
    return assign_pairs(good, group=["match_id", "ca", "cb", "part"], a="a", b="b", cost="cost", unpaired=gate).select("match_id", "a", "b", "cost")


def link_pieces(start: np.ndarray, end: np.ndarray, head: np.ndarray, tail: np.ndarray, team: list[str], look: np.ndarray, weight: np.ndarray, fps: float, p: LinkParams = LinkParams()) -> np.ndarray:
    """Identity of each piece: clusters grow by their cheapest link, as long as one is cheap enough and possible.

    Pieces of one player overlap in at most ``shared`` frames, bear no two known teams, and can be walked from one to the
    next.  A link costs the weighted mean appearance distance of both clusters' pieces, and how fast the walk is.
    """
    n = len(start)
    unit = look / np.maximum(np.linalg.norm(look, axis=1, keepdims=True), 1e-9)
    seen = np.linalg.norm(look, axis=1) > 0
    unlike = np.where(seen[:, None] & seen[None], np.clip(1 - unit @ unit.T, 0, 2), p.unknown)
    overlap = np.minimum(end[:, None], end[None]) - np.maximum(start[:, None], start[None]) + 1
    teams = np.array(team, object)
    known = np.isin(teams, ["A", "B"])
    clash = known[:, None] & known[None] & (teams[:, None] != teams[None])
    gap = np.maximum(start[None] - end[:, None], 1) / fps
    walk = np.linalg.norm(head[None] - tail[:, None], axis=2) / (p.vmax * gap + p.slack)  # from a piece's end to another's start
    barred = (overlap > p.shared) | clash
    np.fill_diagonal(barred, False)
    groups: list[list[int]] = [[i] for i in range(n)]

    def cost(a: list[int], b: list[int]) -> float:
        line = sorted(a + b, key=lambda i: (start[i], end[i], i))
        inside = set(a)
        steps = [walk[i, j] for i, j in zip(line, line[1:]) if (i in inside) != (j in inside)]
        if max(steps) > 1:
            return np.inf
        w = np.outer(weight[a], weight[b])
        return float(p.appearance * (w * unlike[np.ix_(a, b)]).sum() / w.sum() + p.motion * np.mean(steps))

    earlier = (start[:, None] < start[None]) | ((start[:, None] == start[None]) & ((end[:, None] < end[None]) | ((end[:, None] == end[None]) & (np.arange(n)[:, None] < np.arange(n)[None]))))
    step = np.where(earlier, walk, walk.T)
    costs = np.where(barred | (step > 1), np.inf, p.appearance * unlike + p.motion * step)
    costs[np.tril_indices(n)] = np.inf
    alive = np.ones(n, bool)
    while n > 1:
        i, j = np.unravel_index(np.argmin(costs), costs.shape)
        if not costs[i, j] <= p.dearest:
            break
        groups[i] = groups[i] + groups[j]
        alive[j] = False
        costs[j], costs[:, j], costs[i], costs[:, i] = np.inf, np.inf, np.inf, np.inf
        barred[i] |= barred[j]
        barred[:, i] |= barred[:, j]
        for o in np.flatnonzero(alive & ~barred[i]):  # what may not meet one of them may not meet both
            if o != i:
                costs[min(i, o), max(i, o)] = cost(groups[i], groups[o])
    label = np.empty(n, np.int64)
    for number, g in enumerate(sorted((groups[i] for i in np.flatnonzero(alive)), key=lambda g: min((start[x], x) for x in g))):
        label[g] = number
    return label


def identities(pieces: DataFrame, *, fps: str = "fps", params: LinkParams = LinkParams()) -> DataFrame:
    """(match_id, piece, identity): pieces of tracks linked into identities, within overlapping windows that are then chained.

    ``pieces`` has match_id, piece, start, end (frames), hx, hy, tx, ty (first and last position), team, look (ARRAY<DOUBLE>,
    may be NULL), boxes (BIGINT) and ``fps``.  A window is one group, which bounds a task by the people on a court in six
    minutes.  Identities of two windows are one if their common pieces hold ten boxes and half of the smaller's boxes in
    the overlap; one to one, at most boxes in total.  A piece in two windows keeps the earlier one's identity.  ``identity`` is the
    smallest piece of the identity.  Pieces with a NULL frame or position are left out.
    """
    p = params
    rows = pieces.where("piece is not null and start is not null and end is not null and hx is not null and hy is not null and tx is not null and ty is not null")
    length, step = F.rint(p.window_s * F.col(fps)), F.rint((p.window_s - p.overlap_s) * F.col(fps))
    first = F.greatest(F.ceil((F.col("start") - length + 1) / step), F.lit(0))
    spread = rows.withColumn("window", F.explode(F.sequence(first.cast("bigint"), F.greatest(F.floor(F.col("end") / step), first).cast("bigint"))))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "piece"])
        dim = max((len(v) for v in g["look"] if v is not None), default=1)
        look = np.array([v if v is not None and len(v) == dim else np.zeros(dim) for v in g["look"]], float).reshape(len(g), dim)
        label = link_pieces(g["start"].to_numpy(), g["end"].to_numpy(), g[["hx", "hy"]].to_numpy(float), g[["tx", "ty"]].to_numpy(float), g["team"].fillna("").tolist(), look, np.maximum(g["boxes"].to_numpy(float), 1), float(g["fps_"].iloc[0]), p)
        return g[["match_id", "window", "piece", "boxes"]].assign(own=label)

    linked = spread.select("match_id", "window", "piece", "start", "end", "hx", "hy", "tx", "ty", "team", "look", "boxes", F.col(fps).alias("fps_")).groupBy("match_id", "window").applyInPandas(
        kernel, "match_id string, window bigint, piece bigint, boxes bigint, own bigint"
    )
    from pitchweave.session import cut

    linked = cut(linked.withColumn("node", F.col("window") * 1_000_000 + F.col("own")))
    later = linked.select("match_id", (F.col("window") - 1).alias("window"), "piece", F.col("node").alias("next"))
    common = linked.join(later, ["match_id", "window", "piece"])
    shared = common.groupBy("match_id", "window", "node", "next").agg(F.sum("boxes").alias("boxes"))
    sizes = [common.groupBy("match_id", c).agg(F.sum("boxes").alias(f"all_{c}")) for c in ("node", "next")]
    shared = shared.join(sizes[0], ["match_id", "node"]).join(sizes[1], ["match_id", "next"])
    shared = shared.where((F.col("boxes") >= p.least_boxes) & (F.col("boxes") >= p.least_share * F.least("all_node", "all_next")))
    links = assign_pairs(shared.withColumn("cost", -F.col("boxes").cast("double")), group=["match_id", "window"], a="node", b="next", cost="cost", unpaired=0.0)
    named = components(linked.select("match_id", "node").distinct(), links, keys=["match_id"], node="node", a="node", b="next")
    owner = linked.groupBy("match_id", "piece").agg(F.min_by("node", "window").alias("node")).join(named, ["match_id", "node"])
    name = owner.groupBy("match_id", "component").agg(F.min("piece").alias("identity"))
    return owner.join(name, ["match_id", "component"]).select("match_id", "piece", "identity")
