"""The most similar vectors of every vector, by a neighbour graph that NN-descent builds.

1. Equal vectors become one node, named by the smallest id, before any vector is exchanged.
2. A coarse quantizer, fitted on a bounded sample, only says which nodes may meet: every node goes to the blocks of its
   two nearest cells.  There it starts with links to a few random nodes.
3. NN-descent: the neighbours of a node's neighbours are compared with it, until a block has settled.  Then every node
   visits, with its vector and its list, the blocks where its neighbours live, and joins theirs there, round by round,
   until hardly any list changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.session import cut, release

#: Vectors the quantizer is fitted on, nodes aimed at in a cell, cells, and nodes of a cell from which it is split.
SAMPLE, AIM, CELLS, MOST = 12_288, 100, 2048, 256
#: Vectors whose similarities to all centres are held at once.
STRIP = 512
#: Nodes that are compared at once, neighbours kept of a node, rounds at most, share of new list entries at which the graph has settled.
CHUNK, POOL, ROUNDS, SETTLED = 512, 10, 12, 0.01


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes without loss: as int8 or int16 multiples of a power of two where they are, else as they are."""
    out: list[bytes] = [b""] * len(x)
    todo = np.arange(len(x))
    for kind, most in ((np.int8, 127), (np.int16, 32767)):
        for e in range(4, 21):
            if not len(todo):
                return out
            scaled = x[todo[:1]] * np.float32(2.0**e)  # a cheap look at one row before all are scaled
            if e < 20 and len(todo) > 64 and (scaled != np.rint(scaled)).any():
                some = x[todo[:: max(1, len(todo) // 16)]] * np.float32(2.0**e)
                if ((some != np.rint(some)).any(axis=1)).all():
                    continue
            scaled = x[todo] * np.float32(2.0**e)
            whole = (scaled == np.rint(scaled)).all(axis=1) & (np.abs(scaled).max(axis=1, initial=0) <= most)
            for i, row in zip(todo[whole].tolist(), scaled[whole].astype(kind)):
                out[i] = bytes([e]) + row.tobytes()
            todo = todo[~whole]
    for i in todo.tolist():
        out[i] = b"\xff" + x[i].astype(np.float32).tobytes()
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The rows of ``pack`` as unit vectors."""
    if rows and all(len(r) == dim + 1 for r in rows):
        return _unit(np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), dim + 1)[:, 1:].astype(np.float32))
    x = np.empty((len(rows), dim), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r, np.int8 if len(r) == dim + 1 else np.int16 if len(r) == 2 * dim + 1 else np.float32, offset=1)
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-30)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


class Quantizer:
    """Spherical k-means around the sample's mean; where a cell is crowded, planes through its centre split it.

    The planes differ from cell to cell, and again between the two ways (``way`` 0 and 1) a crowded cell is split, so
    that nodes parted by one way meet in the other.  How crowded a cell is, is estimated from the sample: a wrong estimate
    costs time, as blocks are cut into chunks of a bounded size anyway, but drops nothing.
    """

    def __init__(self, sample: np.ndarray, cells: int, nodes: int, rounds: int = 4):
        dim = sample.shape[1]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(dim, np.float32)
        y = self._centred(sample)
        self.centres = y[:cells].copy() if len(y) else np.zeros((1, dim), np.float32)
        at = np.zeros(0, np.int64)
        for _ in range(rounds if len(y) > cells else 0):
            at = self._nearest(y)
            total = np.zeros_like(self.centres)
            np.add.at(total, at, y)
            held = np.bincount(at, minlength=len(total)) > 0
            self.centres[held] = _unit(total[held])
        rng = np.random.default_rng(7)
        self.planes = rng.standard_normal((dim, 16)).astype(np.float32)
        self.signs = rng.choice(np.array([-1, 1], np.int8), (2, len(self.centres), dim))
        size = np.bincount(at if len(at) else self._nearest(y), minlength=len(self.centres)) * (nodes / max(len(y), 1))
        self.bits = np.clip(np.ceil(np.log2(np.maximum(size, 1) / MOST)), 0, 16).astype(np.int64)

    def _centred(self, x: np.ndarray) -> np.ndarray:
        return _unit(x - self.mean + np.float32(1e-12))

    def _nearest(self, y: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[(y[lo : lo + STRIP] @ self.centres.T).argmax(axis=1) for lo in range(0, len(y), STRIP)]])

    def _block(self, y: np.ndarray, cell: np.ndarray, way: int) -> np.ndarray:
        side = np.zeros(len(y), np.int64)
        split = np.flatnonzero(self.bits[cell] > 0)
        for lo in range(0, len(split), STRIP):
            at = split[lo : lo + STRIP]
            off = (y[at] - self.centres[cell[at]]) * self.signs[way][cell[at]]
            side[at] = ((off @ self.planes) > 0) @ (1 << np.arange(16)) & (1 << self.bits[cell[at]]) - 1
        return cell << 17 | way << 16 | side

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest cells of each unit vector, the nearest one first."""
        y, n = self._centred(x), min(2, len(self.centres))
        out = np.empty((len(x), n), np.int64)
        for lo in range(0, len(x), STRIP):
            s = y[lo : lo + STRIP] @ self.centres.T
            near = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out[lo : lo + STRIP] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)
        return out

    def blocks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of every block a vector goes to; the first block of each row is its home."""
        y, cells = self._centred(x), self.cells(x)
        rows, blocks = [np.arange(len(x))], [self._block(y, cells[:, 0], 0)]
        if cells.shape[1] > 1:
            rows.append(rows[0])
            blocks.append(self._block(y, cells[:, 1], 0))
        crowded = np.flatnonzero(self.bits[cells[:, 0]] > 0)
        rows.append(crowded)
        blocks.append(self._block(y[crowded], cells[crowded, 0], 1))
        return np.concatenate(rows), np.concatenate(blocks)


def descend(x: np.ndarray, links: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, similarities to six decimals) of each row of ``x`` after NN-descent from the links (boolean matrix).

    Rows are in the order of their ids, which settles ties.  In a round each row is compared with the neighbours of its
    neighbours in both directions, and keeps the ``pool`` best; rounds go on until no list changes.  -1 and -2 stand for none.
    """
    m = len(x)
    k = min(pool, m - 1)
    if k < 1:
        return np.full((m, 1), -1), np.full((m, 1), -2.0)
    at = np.arange(m)
    key = (np.rint(np.clip(x @ x.T, -1, 1).astype(np.float64) * 1e6).astype(np.int64) + 2_000_000) * 4096 + (4095 - at)
    near, held = np.zeros((m, k), np.int64), np.full((m, k), -1)
    links, first = links.copy(), True
    while True:
        both = links | links.T
        both[at, at] = True
        row, col = np.nonzero(both)
        bits = np.bitwise_or.reduceat(np.packbits(both, axis=1)[col], np.searchsorted(row, at), axis=0)
        met = np.unpackbits(bits, axis=1, count=m).view(bool)
        met[at, at] = False
        if first:
            seen = np.where(met, key, -1)
            near = np.argpartition(seen, m - k, axis=1)[:, m - k :]
            held = np.take_along_axis(seen, near, axis=1)
        else:  # only what is better than the worst of a list changes it
            met &= (key > held.min(axis=1, keepdims=True)) & ~links
            row, col = np.nonzero(met)
            if not len(row):
                break
            some, row = np.unique(row, return_inverse=True)
            row, col = np.r_[np.repeat(np.arange(len(some)), k), row], np.r_[near[some].ravel(), col]
            value = np.r_[held[some].ravel(), key[some[row[len(some) * k :]], col[len(some) * k :]]]
            order = np.argsort((row << 35) - value)  # values are below 2^34
            top = order[np.searchsorted(row[order], np.arange(len(some)))[:, None] + np.arange(k)]
            near[some], held[some] = col[top], value[top]
        first = False
        links = np.zeros((m, m), bool)
        links[np.repeat(at, k)[held.ravel() >= 0], near.ravel()[held.ravel() >= 0]] = True
    return np.where(held >= 0, near, -1), np.where(held >= 0, (held >> 12) / 1e6 - 2, -2.0)


GRAPH = "u bigint, home bigint, v array<bigint>, vh array<bigint>, s array<float>"


def _lists(u: np.ndarray, home: np.ndarray, row: np.ndarray, v: np.ndarray, vh: np.ndarray, s: np.ndarray) -> list[pa.Array]:
    """The columns of ``GRAPH`` for nodes ``u``; ``row`` (ascending) says whose list an entry belongs to."""
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(u)))].astype(np.int32))
    each = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (v.astype(np.int64), vh.astype(np.int64), s.astype(np.float32))]
    return [pa.array(u.astype(np.int64)), pa.array(home.astype(np.int64)), *each]


def _start(batches: Iterator[pa.RecordBatch], dim: int, pool: int) -> Iterator[pa.RecordBatch]:
    """First lists of the members (blk, guest, node, x; sorted by blk) of each block, and the homes of its own nodes.

    A block is cut into chunks of a bounded size; the chunk is a node's home.  Homes are only known once a chunk is full, so
    entries name the home of each neighbour that lives here, and -1 for guests.
    """

    def chunk(home: int, guest: np.ndarray, node: np.ndarray, x: list[bytes]) -> pa.RecordBatch:
        order = np.argsort(node, kind="stable")
        guest, node = guest[order], node[order]
        m, rng = len(node), np.random.default_rng(home)
        links = np.zeros((m, m), bool)
        if m > 1:
            links[np.arange(m)[:, None], rng.integers(0, m, (m, pool))] = True
            links[np.arange(m), np.arange(1, m + 1) % m] = True  # no node is alone
        near, sim = descend(unpack([x[i] for i in order.tolist()], dim), links, pool)
        row, col = np.nonzero(near >= 0)
        to, here = near[row, col], np.where(guest, -1, home)
        return pa.RecordBatch.from_arrays(_lists(node, here, row, node[to], here[to], sim[row, col]), names=["u", "home", "v", "vh", "s"])

    blk, number, held = None, 0, ([], [], [])

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number, held
        while len(held[1]) > (0 if last else 2 * CHUNK):
            n = len(held[1])
            n = min(n, CHUNK) if not last else -(-n // -(-n // CHUNK))
            yield chunk(blk << 20 | number, np.array(held[0][:n]), np.array(held[1][:n]), held[2][:n])
            held, number = tuple(h[n:] for h in held), number + 1

    for b in batches:
        at = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if at[lo] != blk:
                yield from flush(True)
                blk, number, held = int(at[lo]), 0, ([], [], [])
            for h, c in zip(held, (1, 2, 3)):
                h.extend(b.column(c).slice(lo, hi - lo).to_pylist())
            yield from flush(False)
    yield from flush(True)


def _visit(batches: Iterator[pa.RecordBatch], dim: int, pool: int) -> Iterator[pa.RecordBatch]:
    """New list entries from the rows (blk, visitor, u, home, v, vh, s, changed, x; sorted by blk and visitor) of each block.

    The nodes that live in a block are at most a chunk; visitors come a chunk at a time, however many a popular node has.
    """

    def join(rows: pa.Table) -> pa.RecordBatch | None:
        if not np.any(rows["visitor"].to_numpy()) or not np.any(rows["changed"].to_numpy()):
            return None
        rows = rows.take(np.argsort(rows["u"].to_numpy(), kind="stable"))
        u, home = rows["u"].to_numpy(), rows["home"].to_numpy()
        lists = rows["v"].combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        v, s = lists.flatten().to_numpy(), rows["s"].combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(u)), count)
        worst = np.full(len(u), -3.0)
        full = count >= pool
        least = np.full(len(u), np.inf)
        np.minimum.at(least, row, s)
        worst[full] = least[full]
        to = np.minimum(np.searchsorted(u, v), len(u) - 1)
        here = u[to] == v
        links = np.zeros((len(u), len(u)), bool)
        links[row[here], to[here]] = True
        near, sim = descend(unpack(rows["x"].to_pylist(), dim), links, pool)
        r, c = np.nonzero(near >= 0)
        to, sim = near[r, c], sim[r, c]
        fresh = ~links[r, to] & (sim >= worst[r] - 1e-6)
        r, to, sim = r[fresh], to[fresh], sim[fresh]
        if not len(r):
            return None
        some, r = np.unique(r, return_inverse=True)
        return pa.RecordBatch.from_arrays(_lists(u[some], home[some], r, u[to], home[to], sim), names=["u", "home", "v", "vh", "s"])

    blk, own, guests = None, [], []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal guests
        if not guests:
            return
        waiting = pa.Table.from_batches(guests)
        while waiting.num_rows > (0 if last else CHUNK):
            out = join(pa.concat_tables([*([pa.Table.from_batches(own)] if own else []), waiting.slice(0, CHUNK)]))
            waiting = waiting.slice(CHUNK)
            if out is not None:
                yield out
        guests = waiting.to_batches()

    for b in batches:
        at, visitor = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (visitor[1:] != visitor[:-1])) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if at[lo] != blk:
                yield from flush(True)
                blk, own, guests = at[lo], [], []
            (guests if visitor[lo] else own).append(b.slice(lo, hi - lo))
            if len(guests) and sum(g.num_rows for g in guests) > 2 * CHUNK:
                yield from flush(False)
    yield from flush(True)


def _merge(batches: Iterator[pa.RecordBatch], pool: int) -> Iterator[pa.RecordBatch]:
    """One list of the ``pool`` best for each node, and how many of its entries are new, of the rows (u, home, v, vh, s, old) sorted by u."""

    def whole(rows: pa.Table) -> pa.RecordBatch:
        u, home = rows["u"].to_numpy(), rows["home"].to_numpy()
        count = np.diff(rows["v"].combine_chunks().offsets.to_numpy())
        v, vh, s = (rows[c].combine_chunks().flatten().to_numpy() for c in ("v", "vh", "s"))
        owner = np.repeat(u, count)
        old = np.repeat(rows["old"].to_numpy(), count)
        order = np.lexsort((-vh, ~old, v, owner))  # of a pair the old entry, and one that knows the neighbour's home
        owner, v, vh, s, old = owner[order], v[order], vh[order], s[order], old[order]
        first = np.r_[True, (owner[1:] != owner[:-1]) | (v[1:] != v[:-1])] if len(v) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        known = np.full(int(first.sum()), -1, np.int64)
        np.maximum.at(known, group, vh)
        owner, v, vh, s, old = owner[first], v[first], known, s[first], old[first]
        order = np.lexsort((v, -np.round(s.astype(float), 6), owner))
        owner, v, vh, s, old = owner[order], v[order], vh[order], s[order], old[order]
        start = np.searchsorted(owner, owner)
        keep = np.arange(len(owner)) - start < pool
        owner, v, vh, s, old = owner[keep], v[keep], vh[keep], s[keep], old[keep]
        nodes, at = np.unique(u, return_inverse=True)
        homes = np.full(len(nodes), -1, np.int64)
        np.maximum.at(homes, at, home)
        row = np.searchsorted(nodes, owner)
        fresh = np.bincount(row[~old], minlength=len(nodes)).astype(np.int32)
        return pa.RecordBatch.from_arrays([*_lists(nodes, homes, row, v, vh, s), pa.array(fresh)], names=["u", "home", "v", "vh", "s", "fresh"])

    rest = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        u = rows["u"].to_numpy()
        end = int(np.searchsorted(u, u[-1])) if len(u) else 0  # the last node may go on in the next batch
        rest = rows.slice(end)
        if end:
            yield whole(rows.slice(0, end))
    if rest is not None and rest.num_rows:
        yield whole(rest)


class Neighbours:
    """The neighbour graph of one table: ``members`` (id, node), ``nodes`` (node, x packed), ``graph`` (u, home, v, vh, s):
    for each node its block and the lists of its neighbours, their blocks and similarities, the most similar first."""

    def __init__(self, df: DataFrame, *, id: str, vector: str, dim: int, pool: int = POOL, rounds: int = ROUNDS):
        self.dim, self.pool, self.changed = dim, pool, []
        spark = df.sparkSession
        self._take(df, id, vector)
        release(spark)
        self._begin()
        release(spark)
        for _ in range(rounds):
            grown = self._descend()
            release(spark)
            if not grown or self.changed[-1] <= SETTLED:
                break

    def _take(self, df: DataFrame, id: str, vector: str) -> None:
        """The members and the nodes of ``df``."""
        dim, v = self.dim, F.col(vector)
        usable = (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = df.where(F.col(id).isNotNull() & v.isNotNull()).where(usable)
        rows = rows.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(v).alias("g1"), F.xxhash64(F.lit(1), v).alias("g2"), v.cast("array<float>").alias("v"))
        copies = cut(rows.groupBy("id").agg(F.min(F.struct("g1", "g2")).alias("g")).select("id", "g.g1", "g.g2"))
        names = copies.groupBy("g1", "g2").agg(F.min("id").alias("node"))
        self.members = copies.join(names, ["g1", "g2"]).select("id", "node")

        def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:  # a vector leaves a batch once, so that a hot one is not exchanged row by row
                g = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
                _, at = np.unique(g, axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(g[at, 0]), pa.array(g[at, 1]), pa.array(pack(_matrix(b.column(2), dim)[at]), pa.binary())], names=["g1", "g2", "x"])

        vectors = rows.select("g1", "g2", "v").mapInArrow(packs, "g1 bigint, g2 bigint, x binary").dropDuplicates(["g1", "g2"])
        self.nodes = cut(vectors.join(names, ["g1", "g2"]).select("node", "x"))

    def _begin(self) -> None:
        """The quantizer, and the graph as it is within blocks."""
        spark, dim, pool = self.nodes.sparkSession, self.dim, self.pool
        n = self.nodes.count()
        below = F.lit(min(2**63 - 1, -(2**63) + int(2**64 * SAMPLE / max(n, 1))))
        sample = self.nodes.where(F.xxhash64("node") <= below).orderBy(F.xxhash64("node")).select("x").toArrow()["x"].to_pylist()
        self.quantizer = Quantizer(unpack(sample, dim), max(1, min(CELLS, n // AIM)), n)
        shared = spark.sparkContext.broadcast(self.quantizer)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, block = shared.value.blocks(unpack(b.column(1).to_pylist(), dim))
                guest = np.arange(len(row)) >= b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(guest), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["blk", "guest", "node", "x"])

        placed = self.nodes.mapInArrow(place, "blk bigint, guest boolean, node bigint, x binary").repartition("blk").sortWithinPartitions("blk", F.xxhash64("node"))
        lists = placed.mapInArrow(lambda b: _start(b, dim, pool), GRAPH)
        # what a list says of guests' homes is filled in from the rows of their own
        merged = cut(self._merged(lists.withColumn("old", F.lit(False))))
        self.graph = self._with_homes(merged)

    def _merged(self, lists: DataFrame) -> DataFrame:
        pool = self.pool
        return lists.repartition("u").sortWithinPartitions("u").mapInArrow(lambda b: _merge(b, pool), f"{GRAPH}, fresh int")

    def _with_homes(self, merged: DataFrame) -> DataFrame:
        """``merged`` with the home of every neighbour: one join of the entries that lack it."""
        homes = merged.select(F.col("u").alias("v"), F.col("home").alias("known"))
        entries = merged.select("u", "home", "fresh", F.explode_outer(F.arrays_zip("v", "vh", "s")).alias("e")).select("u", "home", "fresh", F.col("e.v").alias("v"), F.col("e.s").alias("s"))
        entries = entries.join(homes, "v", "left").select("u", "home", "fresh", F.when(F.col("v").isNotNull(), F.struct((-F.col("s")).alias("n"), "v", F.col("known").alias("vh"))).alias("e"))
        lists = entries.groupBy("u").agg(F.first("home").alias("home"), F.first("fresh").alias("fresh"), F.array_sort(F.collect_list("e")).alias("e"))
        out = lists.select("u", "home", F.col("e.v").alias("v"), F.col("e.vh").alias("vh"), F.transform("e", lambda x: (-x["n"]).cast("float")).alias("s"), "fresh")
        return cut(out)

    def _descend(self) -> bool:
        """One round of NN-descent over all blocks; false where no list changed."""
        dim, pool = self.dim, self.pool
        to = F.explode(F.array_distinct(F.concat(F.array("home"), "vh"))).alias("blk")
        rows = self.graph.join(self.nodes.withColumnRenamed("node", "u"), "u").select(to, "u", "home", "v", "vh", "s", (F.col("fresh") > 0).alias("changed"), "x")
        rows = rows.select("blk", (F.col("blk") != F.col("home")).alias("visitor"), "u", "home", "v", "vh", "s", "changed", "x")
        rows = rows.repartition("blk").sortWithinPartitions("blk", "visitor")
        new = rows.mapInArrow(lambda b: _visit(b, dim, pool), GRAPH).withColumn("old", F.lit(False))
        graph = cut(self._merged(self.graph.drop("fresh").withColumn("old", F.lit(True)).unionByName(new)))
        total, fresh = graph.agg(F.sum(F.size("v")), F.sum("fresh")).first()
        self.graph = graph
        self.changed.append((fresh or 0) / max(total or 0, 1))
        return bool(fresh)

    def edges(self) -> DataFrame:
        """(u, v, sim): the graph with one row for each neighbour of a node."""
        return self.graph.select("u", F.explode(F.arrays_zip("v", "s")).alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").cast("double").alias("sim"))

    def search(self, queries: DataFrame, *, id: str, vector: str, k: int = 3, beam: int = 24, rounds: int = 8) -> DataFrame:
        """(id, other, sim): the ``k`` nodes most similar to each query vector, by greedy search of the graph.

        A query enters at some nodes of its two cells, and goes on to the neighbours of the ``beam`` best nodes met so
        far, in either direction, until these no longer change.  A round is one join of the beams with the graph and one with
        the vectors.  Queries with NULL ids, and those whose vector takes no part (see ``most_similar``), find nothing.
        """
        dim, spark = self.dim, queries.sparkSession
        shared = spark.sparkContext.broadcast(self.quantizer)
        v = F.col(vector)
        rows = queries.where(F.col(id).isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        rows = rows.select(F.col(id).cast("bigint").alias("q"), v.cast("array<float>").alias("v")).groupBy("q").agg(F.min("v").alias("v"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dim)
                cells = shared.value.cells(_unit(x))
                k = cells.shape[1]
                packed = pack(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(cells.ravel()), pa.array([p for p in packed for _ in range(k)], pa.binary())], names=["q", "cell", "xa"])

        placed = cut(rows.mapInArrow(place, "q bigint, cell bigint, xa binary"))
        vectors = placed.select("q", "xa").dropDuplicates(["q"])
        homes = self.graph.select(F.col("u").alias("b"), F.shiftright("home", 37).alias("cell"))
        entry = homes.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("b")))).where(F.col("r") <= beam).drop("r")
        met = cut(self._rank(placed.select("q", "cell").join(entry, "cell").select("q", "b").distinct(), vectors, beam))
        known = self.edges()
        links = known.select(F.col("u").alias("b"), "v").unionByName(known.select(F.col("v").alias("b"), F.col("u").alias("v")))
        for _ in range(rounds):
            steps = met.join(links, "b").select("q", F.col("v").alias("b")).distinct()
            new = self._rank(steps.join(met.select("q", "b"), ["q", "b"], "left_anti"), vectors, beam)
            rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "b"))
            both = met.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0))).withColumn("r", rank).where(F.col("r") <= beam).drop("r")
            both = cut(both)
            grown = both.where("old = 0").limit(1).count()
            met = both.drop("old")
            if not grown:
                break
        last = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "b"))
        return met.withColumn("r", last).where(F.col("r") <= k).select(F.col("q").alias("id"), F.col("b").alias("other"), "sim")

    def _rank(self, pairs: DataFrame, vectors: DataFrame, beam: int) -> DataFrame:
        """The ``beam`` most similar of the nodes ``pairs`` (q, b) for each query."""
        dim = self.dim
        rows = pairs.join(self.nodes.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b").join(vectors, "q").select("q", "b", "xa", "xb")

        def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = unpack(b.column(2).to_pylist(), dim), unpack(b.column(3).to_pylist(), dim)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y).astype(float))], names=["q", "b", "sim"])

        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "b"))
        return rows.mapInArrow(dots, "q bigint, b bigint, sim double").withColumn("sim", F.round("sim", 6)).withColumn("r", rank).where(F.col("r") <= beam).drop("r")

    def top(self, k: int) -> DataFrame:
        """(id, other, sim, r): the ``k`` most similar other records of every record; at equal similarity the smaller id."""
        first = self.members.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("node", "id")
        own = first.select(F.col("node").alias("u"), F.col("id").alias("other"), F.lit(1.0).alias("sim"))
        # no more than k + 1 neighbours can hold the first k records
        near = self.graph.select("u", F.explode(F.slice(F.arrays_zip("v", "s"), 1, k + 1)).alias("e"))
        near = near.select("u", F.col("e.v").alias("node"), F.least(F.round(F.col("e.s").cast("double"), 6), F.lit(1.0)).alias("sim"))
        near = near.join(first, "node").select("u", F.col("id").alias("other"), "sim")
        rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "other"))
        lists = own.unionByName(near).withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("r", "other", "sim"))).alias("list"))
        rows = self.members.join(lists.withColumnRenamed("u", "node"), "node")
        kept = F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, k)
        return rows.select("id", F.posexplode(kept).alias("r", "e")).select("id", "e.other", "e.sim", (F.col("r") + 1).alias("r"))


def most_similar(df: DataFrame, *, id: str, vector: str, dim: int, k: int = 3, pool: int = POOL, rounds: int = ROUNDS) -> DataFrame:
    """(id, other, sim, r): for every record the ``k`` most similar other records by cosine, r = 1 .. k.

    At equal similarity (to six decimals) the smaller id goes first.  Records without a vector, with an all-zero one,
    one of another length than ``dim``, or one with a NULL, NaN or infinite value take no part, nor do NULL ids; of
    several vectors under one id one is taken, repeated rows are one record.  Equal vectors are compared once and their
    records still all get their ``k``.  Tables of fewer than two records give fewer rows or none.  Other columns are not
    read.

    Approximate: each record is compared with random others of its two cells, and then with neighbours of neighbours
    until hardly any list changes.
    """
    return Neighbours(df, id=id, vector=vector, dim=dim, pool=max(pool, k + 1), rounds=rounds).top(k)
