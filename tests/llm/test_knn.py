import numpy as np
import pytest

from pitchweave.llm import knn


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>, cell string, u int")


def clustered(n, dim, seed=0, size=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // size + 1, dim))
    return (centres[np.arange(n) // size] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]}


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    x = np.r_[np.rint(rng.normal(size=(5, 16)) * 40) / 512, np.rint(rng.normal(size=(5, 16)) * 4000) / 4096, rng.normal(size=(5, 16)), np.zeros((1, 16)), 1e30 * np.ones((1, 16))].astype(np.float32)
    rows = knn.pack(x)
    assert [len(r) for r in rows[:5]] == [17] * 5 and [len(r) for r in rows[5:10]] == [33] * 5
    ok = np.abs(x).max(axis=1) > 0
    want = knn._unit(x[ok])
    assert np.allclose(knn.unpack([r for r, o in zip(rows, ok) if o], 16), want, atol=1e-6)


def test_recall_against_brute_force(spark):
    x = clustered(1500, 32)
    ids = np.random.default_rng(2).permutation(5000)[:1500]
    out = knn.most_similar(table(spark, [(int(i), v.tolist(), "x", 1) for i, v in zip(ids, x)]), id="id", vector="v", dim=32, k=3).toPandas()
    want = brute(x, ids, 3)
    assert len(out) == 4500 and len(want & set(zip(out.id, out.other))) >= 0.97 * len(want)


def test_descent_repairs_a_poor_start(spark, monkeypatch):
    x = clustered(1200, 24, seed=3)
    monkeypatch.setattr(knn, "SAMPLE", 40)  # a quantizer that hardly fits
    monkeypatch.setattr(knn, "AIM", 20)
    df = table(spark, [(i, v.tolist(), "x", 1) for i, v in enumerate(x)])
    want = brute(x, np.arange(1200), 3)

    def recall(rounds):
        out = knn.most_similar(df, id="id", vector="v", dim=24, k=3, rounds=rounds).toPandas()
        return len(want & set(zip(out.id, out.other))) / len(want)

    assert recall(3) > recall(0) and recall(3) >= 0.9


def test_crowded_cells_are_split_in_two_ways():
    rng = np.random.default_rng(4)
    q = knn.Quantizer(rng.normal(size=(200, 8)).astype(np.float32), 4, 200)
    q.bits[:] = 3
    row, block = q.blocks(knn._unit(rng.normal(size=(500, 8)).astype(np.float32)))
    assert np.bincount(row).tolist() == [3] * 500 and (block & 0xFFFF).max() == 7
    home, other = block[:500], block[1000:]
    assert (home >> 17 == other >> 17).all() and set(home >> 16 & 1) == {0} and set(other >> 16 & 1) == {1}
    assert len(set(zip(home, other))) > 1.5 * len(set(home))  # nodes parted by one way meet in the other


@pytest.mark.parametrize("size, spread", [(20, 0.5), (600, 1.0)])
@pytest.mark.parametrize("cells, most, chunk", [(4, 750, 512), (4, 47, 512), (1, 94, 128)])
def test_recall_where_cells_are_split(spark, monkeypatch, size, spread, cells, most, chunk):
    """Cells split 2- to 4-fold and 32- to 64-fold, and blocks cut into chunks; tight and loose groups."""
    rng = np.random.default_rng(0)
    n, dim = 6000, 64
    centres = rng.normal(size=(n // size + 1, dim))
    x = (centres[np.arange(n) // size] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    for name, value in (("CELLS", cells), ("MOST", most), ("CHUNK", chunk)):
        monkeypatch.setattr(knn, name, value)
    graph = knn.Neighbours(table(spark, [(i, v.tolist(), "", 1) for i, v in enumerate(x)]), id="id", vector="v", dim=dim)
    assert graph.quantizer.bits.max() >= (1 if most == 750 else 5)
    out = graph.top(3).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argpartition(-(u @ u.T) + 3 * np.eye(n, dtype=np.float32), 3, axis=1)[:, :3]
    want = {(i, int(j)) for i in range(n) for j in near[i]}
    assert len(want & set(zip(out.id, out.other))) >= 0.93 * len(want)


def test_pairs_come_through_the_descent(spark):
    """Of the final pairs at most a few are links that the start drew at random."""
    x = clustered(2000, 32, seed=8)
    drawn = []
    plain = knn.descend

    def watched(x, links, pool):
        near, sim = plain(x, links, pool)
        drawn.append((np.take_along_axis(links, np.maximum(near, 0), axis=1) & (near >= 0)).sum() / max((near >= 0).sum(), 1))
        return near, sim

    rows = [(7, bool(i % 2), i, p) for i, p in enumerate(knn.pack(x[:400]))]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["blk", "guest", "node", "x"])
    knn.descend = watched
    try:
        list(knn._start(iter([batch]), 32, 10))
    finally:
        knn.descend = plain
    assert max(drawn) < 0.25


def test_a_hot_vector_is_one_node(spark):
    """A third of the rows hold one vector: it is exchanged once a batch, and lies in one block only once."""
    x = clustered(900, 16, seed=9)
    rows = [(i, v.tolist(), "", 1) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist(), "", 1) for i in range(450)]
    graph = knn.Neighbours(table(spark, rows), id="id", vector="v", dim=16)
    assert graph.nodes.count() == 900 and graph.members.count() == 1350
    out = graph.top(3).where("id >= 1000").toPandas()
    assert len(out) == 1350 and set(out.other) <= {5, 1000, 1001, 1002}


def test_popular_nodes_have_visitors_a_chunk_at_a_time(spark, monkeypatch):
    """Everything is near one node, so its block has every node as a visitor."""
    rng = np.random.default_rng(11)
    hub = np.zeros(24)
    hub[0] = 1
    x = np.r_[[hub], hub * 0.4 + rng.normal(size=(1500, 24)) / 5].astype(np.float32)
    monkeypatch.setattr(knn, "CHUNK", 64)
    out = knn.most_similar(table(spark, [(i, v.tolist(), "", 1) for i, v in enumerate(x)]), id="id", vector="v", dim=24, k=3).toPandas()
    want = brute(x, np.arange(1501), 3)
    assert len(want & set(zip(out.id, out.other))) >= 0.9 * len(want)


def test_copies_zeros_nulls_and_odd_rows(spark):
    a, b, c = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]
    rows = [(i, a, "x", 1) for i in (1, 2, 3, 4, 5, 6)] + [(10, b, "", 1), (11, c, "", 1), (11, c, "", 1), (12, [0.0, 0.0], "", 1), (13, None, "", 1), (14, [1.0], "", 1), (15, [float("nan"), 1.0], "", 1), (None, a, "", 1), (16, [None, 1.0], "", 1)]
    out = knn.most_similar(table(spark, rows), id="id", vector="v", dim=2, k=3).toPandas()
    got = {i: g.sort_values("r").other.tolist() for i, g in out.groupby("id")}
    assert got[1] == [2, 3, 4] and got[2] == [1, 3, 4] and got[6] == [1, 2, 3]
    assert got[10] == [1, 2, 3] and got[11] == [10, 1, 2] and set(got) == {1, 2, 3, 4, 5, 6, 10, 11}
    assert knn.most_similar(table(spark, []), id="id", vector="v", dim=2).count() == 0
    assert knn.most_similar(table(spark, rows[:1]), id="id", vector="v", dim=2).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_graph_search_for_new_vectors(spark, k):
    x = clustered(1500, 32, seed=5)
    graph = knn.Neighbours(table(spark, [(i, v.tolist(), "", 1) for i, v in enumerate(x[:1300])]), id="id", vector="v", dim=32)
    out = graph.search(table(spark, [(i, v.tolist(), "", 1) for i, v in enumerate(x[1260:1320])]), id="id", vector="v", k=k).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[1260:1320] @ u[:1300].T
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:k]}
    near = {p for p in want if s[p[0], p[1]] > 0.5}
    assert len(near & set(zip(out.id, out.other))) >= 0.9 * len(near)


def plain_descent(x, links, pool):
    """Every list anew in every round."""
    m = len(x)
    at = np.arange(m)
    key = (np.rint(np.clip(x @ x.T, -1, 1).astype(np.float64) * 1e6).astype(np.int64) + 2_000_000) * 4096 + (4095 - at)
    links, best = links.copy(), None
    while True:
        both = (links | links.T).astype(np.float32)
        met = (both @ both > 0) | (both > 0)
        met[at, at] = False
        seen = np.where(met, key, -1)
        near = np.argpartition(seen, m - pool, axis=1)[:, m - pool :]
        held = np.take_along_axis(seen, near, axis=1)
        now = np.sort(held, axis=1)
        if best is not None and (now == best).all():
            return now
        best, links = now, np.zeros((m, m), bool)
        np.put_along_axis(links, near, held >= 0, axis=1)


def test_large_blocks_descend_by_what_changes():
    import time

    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(50, 64))
    x = knn._unit((kinds[rng.integers(0, 50, 1024)] + 0.5 * rng.normal(size=(1024, 64))).astype(np.float32))
    x[1000:] = x[:24]  # ties
    links = np.zeros((1024, 1024), bool)
    links[np.arange(1024)[:, None], rng.integers(0, 1024, (1024, 10))] = True
    spent = {}
    for what in (knn.descend, plain_descent):
        what(x, links, 10)
        began = time.process_time()
        out = what(x, links, 10)
        spent[what] = time.process_time() - began
        if what is knn.descend:
            near, sim = out
    key = np.where(near >= 0, (np.rint(sim * 1e6).astype(np.int64) + 2_000_000) * 4096 + 4095 - near, -1)
    assert (np.sort(key, axis=1) == out).all()
    assert spent[knn.descend] < 0.7 * spent[plain_descent], spent
