import numpy as np
import pytest

from quadframe.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = []
    for i, (vid, v, _) in enumerate(rows):
        if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append(i)
    x = np.array([rows[i][1] for i in usable], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    n, low = {}, {i: -(1 << 63) if r[0] is None else r[0] for i, r in enumerate(rows)}
    for a, i in enumerate(usable):
        n[i] = int(linked[a].sum())
    for _ in rows:
        before = dict(low)
        for a, i in enumerate(usable):
            for b in np.flatnonzero(linked[a]):
                low[i] = min(low[i], low[usable[b]])
        if before == low:
            break
    out = []
    for i, r in enumerate(rows):
        own = -(1 << 63) if r[0] is None else r[0]
        out.append((r[0], n.get(i, 0), None if low[i] == -(1 << 63) else low[i], low[i] == own))
    return sorted(out, key=str)


def rows(n=400):
    r = np.random.default_rng(0)
    centre = r.standard_normal((60, 16))
    out = []
    for i in range(n):
        v = centre[i % 60] + r.standard_normal(16) * (0.05 if i % 3 else 0.5)
        out.append((i, v.astype(np.float32).tolist(), 0))
    hub = r.standard_normal(16)
    out += [(1000 + i, (hub + r.standard_normal(16) * 0.02).astype(np.float32).tolist(), 1) for i in range(150)]
    out += [(2000 + i, out[7][1], None) for i in range(50)]
    nan, inf = float("nan"), float("inf")
    out += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [nan] * 16, 0), (3004, [inf] + [1.0] * 15, 0), (3005, [None] + [1.0] * 15, 0), (3006, [1.0] * 5, 0), (None, out[8][1], 0), (5, out[5][1], 0), (3007, [2 * x for x in out[9][1]], 0)]
    return out


@pytest.mark.parametrize("chunk,cell", [(2048, 512), (20, 20)])
def test_matches_brute_force(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(V, "CELL", cell)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' AS id", "1 AS rep", "2 AS vec")
    assert sorted(map(tuple, V.near_duplicates(df, chunk=chunk).collect()), key=str) == brute(data)


def test_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.near_duplicates(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}


def test_recall_of_boundary_pairs():
    r = np.random.default_rng(3)
    x = V._unit(r.standard_normal((4000, 64)))
    index = V.MultiIndex(x, 50_000)
    noise = r.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.92 * x + np.sqrt(1 - 0.92**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    vx, vy = index.visit(x[:800]), index.visit(y[:800])
    hit = [(vy[i][0] in vx[i]) or (vx[i][0] in vy[i]) for i in range(800)]
    assert np.mean(hit) >= 0.95 and index.probes < index.k**2


def test_traversal_is_in_order():
    r = np.random.default_rng(5)
    a, b = r.random(12), r.random(9)
    cells = V.multi_sequence(a, b, 40)
    want = sorted(a[i] + b[j] for i in range(12) for j in range(9))[:40]
    assert np.allclose([a[i] + b[j] for i, j in cells], want)


def test_every_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(V, "SMALL", 50, raising=False)
    r = np.random.default_rng(7)
    data, linked = [], {}
    for size, groups in ((8, 50), (12, 40), (5, 6), (3, 1)):  # the most frequent, one with an index of its own, two compared in full
        for g in range(groups):
            centre, first = r.standard_normal(size), len(data)
            for copy in range(3):
                v = centre if copy < 2 else centre + r.standard_normal(size) * 0.001
                data.append((len(data), v.astype(np.float32).tolist(), 0))
    x = [np.array(v) / np.linalg.norm(v) for _, v, _ in data]
    for i, a in enumerate(x):
        linked[i] = {j for j, b in enumerate(x) if i != j and len(a) == len(b) and a @ b >= 0.9}
    low = list(range(len(data)))
    for _ in data:
        low = [min([low[i], *(low[j] for j in linked[i])]) for i in range(len(data))]
    got = V.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(i, len(linked[i]), low[i], low[i] == i) for i in range(len(data))]
