import numpy as np
import pytest
from boundwise.llm import collision_search, pivot_index
from boundwise.llm import components as components_module
from boundwise.llm.common import table
from boundwise.llm.components import components, forest
from duck import assert_same

SCHEMA = "vec_id long, embedding array<float>, label int, h long, v string, ok int"
ODD = [
    (1, [1.0, 0.0, 0.5], 1),
    (2, [1.0, 0.01, 0.5], 1),
    (3, [2.0, 0.0, 1.0], 1),  # another length, the same direction
    (4, [1.0, 0.0, 0.5], 2),
    (5, [1.0, 0.0, 0.5], None),
    (6, None, 1),
    (7, [0.0, 0.0, 0.0], 1),
    (8, [1.0, None, 0.5], 1),
    (9, [float("nan"), 1.0, 1.0], 1),
    (10, [float("inf"), 1.0, 1.0], 1),
    (11, [1.0, 0.0], 1),
    (12, [], 1),
    (13, [1.0, 0.0, 0.5], 1),
    (13, [1.0, 0.0, 0.5], 1),
    (None, [1.0, 0.0, 0.5], 1),
    (20, [0.0, 1.0, 0.0], 3),
    (40, [0.0, 1.0, 0.0], 3),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA)


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_index.near_duplicates(frame(spark, ODD)).collect()), key=str)
    linked = {1: 4, 2: 4, 3: 4, 13: 4}
    want = [(i, linked.get(i, 1 if i in (20, 40) else 0), 1 if i in linked else 20 if i == 40 else i, i not in (2, 3, 13, 40)) for i, _, _ in ODD]
    assert got == sorted(want, key=str)


def test_near_duplicates_of_nothing(spark):
    assert pivot_index.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [1024, 64])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    rows = [(int(i), [float(x) for x in centres[i % 40] + rng.standard_normal(16) * (0.02 + 0.12 * (i % 7 == 0))], int(i % 3)) for i in range(1500)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(200)]  # many copies
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_duplicates(frame(spark, rows)).collect()}
    x, label, ids = np.array([r[1] for r in rows], np.float32).astype(float), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    parts = forest(len(ids), *np.nonzero(linked))
    found = sum(got[i][0] for i in ids) / linked.sum()
    assert 0.99 <= found <= 1
    assert np.mean([got[i][1] == ids[parts[k]] for k, i in enumerate(ids)]) >= 0.99


@pytest.mark.parametrize("n", [2, 3])
def test_blocks_of_a_list_may_be_empty(spark, monkeypatch, n):
    monkeypatch.setattr(pivot_index, "BLOCK", 1)
    rows = [(10 * g + k, [float(g == i) + 0.01 * (k == i) for i in range(12)], 1) for g in range(12) for k in range(n)]
    got = pivot_index.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, n - 1, i // 10 * 10) for i, _, _ in rows]


@pytest.mark.parametrize("to_centre", [0.985, 0.992, 0.998])
def test_a_third_of_the_rows_are_distinct_near_copies(spark, to_centre):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    x, centre = unit(rng.standard_normal((2400, 64))), unit(rng.standard_normal(64))
    off = x[:800] - np.outer(x[:800] @ centre, centre)
    x[:800] = to_centre * centre + np.sqrt(1 - to_centre**2) * unit(off)
    # around the group, at its edge and away from it, pairs of which one is in the cells and the other need not be
    x[800:1200] = unit(x[800:1200] + np.linspace(0.2, 4, 400)[:, None] * centre)
    x[1200:1600] = unit(x[800:1200] + 0.02 * rng.standard_normal((400, 64)))
    x = x.astype(np.float32)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_duplicates(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()}
    x = unit(x.astype(float))
    linked = x @ x.T >= 0.98
    np.fill_diagonal(linked, False)
    assert [got[i][0] for i in range(800)] == linked[:800].sum(axis=1).tolist()
    assert sum(n for n, _ in got.values()) >= 0.999 * linked.sum() and all(got[i][0] <= linked[i].sum() for i in got)
    assert [got[i][1] for i in range(800)] == forest(len(x), *np.nonzero(linked))[:800].tolist()


def test_near_duplicates_match_sql(spark):
    sf = "/root/testdata/sf0.1"
    assert_same(pivot_index.near_duplicates(table(spark, sf, "embeddings")), pivot_index.ORACLE, sf)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7000, i) for i in range(6000, 6050)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("order", ["up", "shuffled"])
def test_long_chains_take_few_rounds(spark, order, monkeypatch):
    nodes = np.arange(1000) if order == "up" else np.random.default_rng(3).permutation(1000)
    names, save = [], components_module.save
    monkeypatch.setattr(components_module, "save", lambda df, name: names.append(name) or save(df, name))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(nodes[:-1], nodes[1:], strict=True)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(1000)}
    assert names.count("edges") <= 1 + 10 and names.count("least") <= 10 * 11


def test_forest_matches_one_edge_at_a_time():
    """Sparse graphs, in which chains join in several rounds, and shuffled paths."""
    graphs = []
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n, m = rng.integers(2, 60, 2)
        graphs.append((int(n), rng.integers(0, n, m), rng.integers(0, n, m)))
        path = rng.permutation(n)
        graphs.append((int(n), path[:-1], path[1:]))
    for n, a, b in graphs:
        want = np.arange(n)
        for x, y in zip(want[a], want[b], strict=True):
            want[np.isin(want, [want[x], want[y]])] = min(want[x], want[y])
        assert (forest(n, a, b) == want).all()


def brute(rows, k=20):
    out = {}
    ok = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, qv in ok:
        if q % 20 == 0:
            s = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(qv).astype(float))), i) for i, v in ok if i != q and len(v) == len(qv))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_search_of_odd_rows(spark):
    rows = [*ODD, (0, [0.3, 0.2, 0.1], 1), (-20, [1.0, 1.0, 1.0], 1)]
    got = {}
    for r in sorted(collision_search.nearest(frame(spark, rows)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert collision_search.nearest(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [8192, 700])
def test_search_recall(spark, monkeypatch, block):
    monkeypatch.setattr(collision_search, "BLOCK", block)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want, got = brute(rows), {}
    for r in collision_search.nearest(frame(spark, rows)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("spread", [0.1, 0.3, 1.0, 3.0])
def test_search_recall_with_norms_that_vary(spread):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 32))
    x *= np.exp(spread * rng.standard_normal((3000, 1))) / np.sqrt((x * x).sum(axis=1, keepdims=True))
    index, ids = collision_search.Index(x), np.arange(3000)
    row, found, _ = index.search(x[:60], ids, ids[:60])
    full = x[:60] @ x.T
    np.fill_diagonal(full, -np.inf)
    want = np.argsort(-full, axis=1)[:, :20]
    assert np.mean([len(set(found[row == i]) & set(want[i])) / 20 for i in range(60)]) >= 0.95
    assert index.verified < 0.6 * 60 * 3000


def test_search_of_enormous_and_tiny_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8))
    x[:20] *= 1e200
    x[20:30] *= 1e-300
    x[30, :] = [1e308, -1e308] * 4
    schema = "vec_id long, embedding array<double>"
    got = {}
    for r in collision_search.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {0, 20, 40} and all(len(v) == 20 for v in got.values())
    for q, rows in got.items():
        rows.sort()
        scores = [s for _, _, s in rows]
        assert scores == sorted(scores, reverse=True) and not np.isnan(scores).any()
        want = collision_search.products(x, x[q])
        assert all(s == want[i] for _, i, s in rows)
    assert got[0][0][2] == np.inf and got[40][0][2] < np.inf


def test_threshold_of_collisions():
    rng = np.random.default_rng(3)
    need = collision_search.threshold(64, 1.0, 0.05)
    hits = (np.abs(rng.standard_normal((20000, 64))) <= 1).sum(axis=1)
    assert (hits < need).mean() <= 0.06 and (hits < need + 1).mean() > 0.04


def test_more_pivots_for_more_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "PER_PIVOT", 3)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((400, 16))
    rows = [(int(i), [float(x) for x in centres[i % 400] + rng.standard_normal(16) * 0.05], 1) for i in range(1200)]
    got = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(frame(spark, rows)).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = (x @ x.T >= 0.98).sum() - len(x)
    assert 0.99 * linked <= sum(got.values()) <= linked
