"""Implausible readings: spikes by robust principal components, stuck values and impossible values by their own tests.

A series (source, entity) is cut into blocks of frames with a halo, so no single task ever holds a whole hot series.
In each block every measured column becomes a profile matrix whose columns are overlapping windows of ``width``
frames.  Alternating projections split it into a low-rank part, the series' normal course, and a sparse part.  The
scatter of a series is 1.4826 times the median absolute residual against that course.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of context on either side of a block, window and ranks of the profiles.
HALO = 40
WIDTH, RANK, FINE_RANK = 12, 3, 5
#: Share of the scatter by which a course moves in a round once it has settled; rounds; rows, series and grid cells computed at once.
SETTLED, ROUNDS, ROWS, STACK, CELLS = 0.01, 12, 32_768, 256, 1 << 21


def spike_scores(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(course, deviations in units of the usual scatter, scatter) of one series on a regular grid (NaN = missing)."""
    course, score, scatter = spike_scores_of(v[None, :], np.array([len(v)]))
    return course[0], score[0], float(scatter[0])


def spike_scores_of(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spike_scores`` of many series at once: row i of ``v`` holds ``n[i]`` frames, and NaN beyond.

    The scatter is that of the residuals against the rank-3 course, widened for the share of noise the course takes
    up.  A second, finer low-rank completion without the suspicious readings follows sharp turns that a rank-3 course
    rounds off; a reading counts as far from both.  It is made only where some reading stands out.
    """
    seen = np.isfinite(v)
    course, score, scatter = np.full(v.shape, np.nan), np.where(seen, 0.0, np.nan), np.full(len(v), np.nan)
    for lo in range(0, len(v), STACK):
        rows = np.flatnonzero(seen[lo : lo + STACK].sum(axis=1) >= 8) + lo
        width = np.minimum(WIDTH, np.maximum(4, n[rows] // 3))
        for w in np.unique(width).tolist():
            at = rows[width == w]
            size = int(n[at].max())
            course[at, :size], score[at, :size], scatter[at] = _scores(v[at, :size], n[at], w)
    return course, score, scatter


def _scores(v: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen, size = np.isfinite(v), v.shape[1]
    level = _median(v, seen)[:, None]
    frame = np.arange(size)
    inside = frame < n[:, None]
    start = np.zeros_like(v)
    for i in range(len(v)):
        start[i] = v[i] if seen[i].all() else np.interp(frame, frame[seen[i]], v[i, seen[i]])
    start = _rolling_median(np.where(inside, start, np.take_along_axis(start, n[:, None] - 1, axis=1)), 9) - level
    v = np.where(seen, v - level, 0.0)
    course = _project(v, seen, n, start, width, RANK, None)
    residual = np.abs(v - course)
    scatter = 1.4826 * _median(residual, seen) / np.sqrt(1 - RANK / WIDTH)
    floor = np.maximum(np.maximum(scatter, 1e-3 * _median(np.abs(v), seen)), 1e-9)[:, None]
    far = seen & (residual > 4 * floor)
    out = np.flatnonzero(far.any(axis=1))
    if len(out):
        fine = _project(v[out], seen[out], n[out], course[out], width, FINE_RANK, seen[out] & ~far[out])
        residual[out] = np.minimum(residual[out], np.abs(v[out] - fine))
    return np.where(inside, course + level, np.nan), np.where(seen, residual / floor, np.nan), scatter


def _median(v: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Median of each row's values that are in use; there is one at least."""
    ordered, count = np.sort(np.where(use, v, np.inf), axis=1), use.sum(axis=1)
    row = np.arange(len(v))
    return (ordered[row, (count - 1) // 2] + ordered[row, count // 2]) / 2


def _project(v: np.ndarray, seen: np.ndarray, n: np.ndarray, course: np.ndarray, width: int, rank: int, trusted: np.ndarray | None) -> np.ndarray:
    """Alternating projections between the low-rank window profiles and the readings that are not in the sparse part.

    ``trusted`` fixes the readings to follow; without it they are found anew each round: those within six, later four,
    scatters of the course.  The first course is a rolling median, which an excursion of up to four frames cannot move.

    The profile matrix of a series has a column for each window.  Its covariance is summed up by differences of running
    sums, and its projection on the principal components is a correlation followed by a convolution with each; so the
    matrix itself is never written down.
    """
    result, active = course.copy(), np.arange(len(v))
    size = v.shape[1]
    rank, most = min(rank, width), size - width + 1
    frame = np.arange(size)
    for i in range(ROUNDS):
        vi, ni, old, si = v[active], n[active], result[active], seen[active]
        columns = ni - width + 1
        scatter = 1.4826 * _median(np.abs(vi - old), si)
        keep = si & (np.abs(vi - old) <= max(4.0, 6.0 - i) * np.maximum(scatter, 1e-9)[:, None]) if trusted is None else trusted[active]
        w = np.where(frame < ni[:, None], np.where(keep, vi, old), 0.0)
        ends = columns[:, None] + np.arange(width)

        def between(x: np.ndarray) -> np.ndarray:  # sums over the windows, for each position in a window
            sums = np.zeros((len(x), size + 1))
            np.cumsum(x, axis=1, out=sums[:, 1 : x.shape[1] + 1])
            return np.take_along_axis(sums, ends[:, : width - (size - x.shape[1])], axis=1) - sums[:, : width - (size - x.shape[1])]

        mean = between(w) / columns[:, None]
        cov = np.empty((len(w), width, width))
        for d in range(width):
            r = np.arange(width - d)
            cov[:, r, r + d] = cov[:, r + d, r] = between(w[:, : size - d] * w[:, d:]) - columns[:, None] * mean[:, r] * mean[:, r + d]
        top = np.linalg.eigh(cov)[1][:, :, -rank:]
        parts = np.repeat(-np.einsum("bwr,bw->br", top, mean)[:, :, None], most, axis=2)
        for r in range(width):
            parts += top[:, r, :, None] * w[:, None, r : r + most]
        valid = np.arange(most) < columns[:, None]
        low = top @ (parts * valid[:, None, :]) + mean[:, :, None] * valid[:, None, :]
        fresh = np.zeros_like(w)
        for r in range(width):
            fresh[:, r : r + most] += low[:, r]
        times = np.minimum(np.minimum(frame + 1, ni[:, None] - frame), np.minimum(width, columns)[:, None])
        fresh /= np.maximum(times, 1)
        moved = np.sqrt(((fresh - old) ** 2 * (frame < ni[:, None])).sum(axis=1) / ni)
        result[active] = fresh
        if i > 2:
            active = active[moved >= SETTLED * np.maximum(scatter, 1e-6)]
            if not len(active):
                break
    return result


def _rolling_median(v: np.ndarray, width: int) -> np.ndarray:
    half = width // 2
    padded = np.concatenate([np.repeat(v[:, :1], half, axis=1), v, np.repeat(v[:, -1:], half, axis=1)], axis=1)
    return np.partition(np.lib.stride_tricks.sliding_window_view(padded, width, axis=1), half, axis=2)[:, :, half]


def short_excursions(score: np.ndarray, seen: np.ndarray, threshold: float, longest: int) -> np.ndarray:
    """Readings whose own score passes ``threshold``, in runs that are back on course within ``longest`` frames.

    ``score`` is on the regular grid; missing frames (``seen`` false) neither end nor lengthen a run's membership, but
    count as frames.  A run takes in neighbours above 5/8 of the threshold.  Around a huge spike the course itself is
    off; so a run that is too long is cut again at a third of its highest score.  A run must have readings on course
    on both sides.
    """
    hit = np.zeros(len(score), bool)
    at = np.flatnonzero(seen)
    score_at = score[at]
    todo = [(0, len(at), threshold * 0.625)]
    while todo:
        lo, hi, low = todo.pop()
        edges = np.flatnonzero(np.diff(np.r_[False, score_at[lo:hi] > low, False].view(np.int8))) + lo
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            run = score_at[i:j]
            highest = run.max()
            if not highest > threshold:
                continue
            if i > 0 and j < len(at) and at[j] - at[i] <= longest and at[j - 1] - at[i] < longest:
                hit[at[i:j]] = run > threshold
            elif j - i > 1 and (cut := max(highest / 3, low * 1.01)) > low and (run > cut).sum() < j - i:
                todo.append((i, j, cut))
    return hit


def constant_runs(v: np.ndarray, least: int) -> np.ndarray:
    """Frames in runs of at least ``least`` consecutive grid frames with one exact value (NaN breaks a run)."""
    n = len(v)
    if n == 0:
        return np.zeros(0, bool)
    first = np.r_[True, ~(v[1:] == v[:-1])]
    run = np.cumsum(first) - 1
    return (np.bincount(run)[run] >= least) & np.isfinite(v)


def _starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row begins a new group of equal values (NULL like NULL) in these columns."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        column = rows[c].combine_chunks()
        a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
        new[1:] |= ~same.astype(bool)
    return new


def flag_readings(
    df: DataFrame,
    *,
    keys: list[str],
    order: str,
    values: list[str],
    impossible: Column | None = None,
    threshold: float = 8.0,
    longest: int = 3,
    constant: int = 10,
    block: int = 4096,
) -> DataFrame:
    """Flag each reading of each series: ``spike``, ``stuck``, ``impossible``, with ``score`` and the courses.

    Result: keys, ``order`` (BIGINT), spike, stuck, impossible (BOOLEAN), score (DOUBLE, the largest deviation over the
    value columns in scatters), and ``<value>_course``; one row per series and frame that has a row.

    A series is judged by its own scatter within a block of ``block`` frames plus context, so a series that holds a
    third of all rows is spread over many tasks.  NULL and NaN readings are never flagged themselves.  Rows with a NULL
    ``order`` are left out; NULL keys form a series of their own; of several rows at one frame the smallest reading is
    judged (repeated rows are one record).  Series with fewer than eight readings get no spike.  An empty table gives
    an empty result; other columns of ``df`` are not read, whatever their names.
    """
    bad = impossible if impossible is not None else F.lit(False)
    number = F.col(order).cast("bigint")
    own = F.floor(number / block)
    rows = df.where(F.col(order).isNotNull()).select(
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)],
        number.alias("k"),
        *[F.when(~F.isnan(v), F.col(v).cast("double")).alias(f"v{i}") for i, v in enumerate(values)],
        F.coalesce(bad, F.lit(False)).alias("bad"),
        F.explode(F.array_distinct(F.array(F.floor((number - HALO) / block), own, F.floor((number + HALO) / block)))).alias("blk"),
    )
    n = len(values)
    names = [f"key{i}" for i in range(len(keys))]
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    schema = f"{fields}, k bigint, spike boolean, stuck boolean, impossible boolean, score double, " + ", ".join(f"c{i} double" for i in range(n))

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The flags of whole groups (series, block), sorted."""
        new, blk, k = _starts(rows, [*names, "blk"]), rows["blk"].to_numpy(), rows["k"].to_numpy()
        once = new | np.r_[True, k[1:] != k[:-1]]  # of several rows at one frame the first
        rows = rows.filter(pa.array(once))
        new, blk, k, bad = new[once], blk[once], k[once], rows["bad"].to_numpy(zero_copy_only=False).astype(bool)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        at = k - k[first][group]
        size = at[np.r_[first[1:], len(k)] - 1] + 1
        shape = (len(first), int(size.max()))
        if len(first) > 1 and shape[0] * shape[1] > CELLS:  # few readings over many frames: fewer groups at once
            middle = int(first[len(first) // 2])
            yield from judge(rows.slice(0, middle).combine_chunks())
            yield from judge(rows.slice(middle).combine_chunks())
            return
        spike, stuck, score, courses = np.zeros(len(k), bool), np.zeros(len(k), bool), np.zeros(len(k)), []
        for i in range(n):
            grid = np.full(shape, np.nan)
            grid[group, at] = rows[f"v{i}"].to_numpy()
            grid[~np.isfinite(grid)] = np.nan
            apart = np.concatenate([grid, np.full((len(first), 1), np.nan)], axis=1)  # a run ends with its series
            stuck |= constant_runs(apart.ravel(), constant).reshape(apart.shape)[group, at]
            grid[group[bad], at[bad]] = np.nan
            course, deviation, _ = spike_scores_of(grid, size)
            seen = np.isfinite(grid)
            deviation = np.where(seen, np.nan_to_num(deviation), 0.0)
            hit = np.zeros(shape, bool)
            for g in np.flatnonzero((deviation > threshold).any(axis=1)).tolist():
                hit[g] = short_excursions(deviation[g], seen[g], threshold, longest)
            spike |= hit[group, at]
            score = np.maximum(score, deviation[group, at])
            courses.append(course[group, at])
        own = (k >= blk * block) & (k < (blk + 1) * block)
        keys_ = [rows[c].combine_chunks() for c in names]
        flags = [pa.array(k), pa.array(spike), pa.array(stuck), pa.array(bad), pa.array(score), *map(pa.array, courses)]
        out = pa.RecordBatch.from_arrays([*keys_, *flags], names=[*names, "k", "spike", "stuck", "impossible", "score", *[f"c{i}" for i in range(n)]])
        yield out.filter(pa.array(own))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        waiting = 0
        for b in batches:
            rest.append(b)
            waiting += b.num_rows
            if waiting < ROWS:
                continue
            rows = pa.Table.from_batches(rest)
            end = int(np.flatnonzero(_starts(rows, [*names, "blk"])).max())  # the last group may go on
            if end:
                yield from judge(rows.slice(0, end).combine_chunks())
            rest, waiting = rows.slice(end).combine_chunks().to_batches(), rows.num_rows - end
        if waiting:
            yield from judge(pa.Table.from_batches(rest).combine_chunks())

    line = [*names, "blk", "k", *[F.col(f"v{i}").asc_nulls_last() for i in range(n)]]
    flagged = rows.repartition(*names, "blk").sortWithinPartitions(*line).mapInArrow(kernel, schema)
    return flagged.select(
        *[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)],
        F.col("k").alias(order),
        "spike", "stuck", "impossible", "score",
        *[F.col(f"c{i}").alias(f"{v}_course") for i, v in enumerate(values)],
    )
