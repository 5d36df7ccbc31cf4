"""Nearest neighbours against all inner products."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import ann


def brute_force(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        rest = ids != q
        order = np.lexsort((ids[rest], -s[rest]))[:k]
        out[q] = list(zip(ids[rest][order].tolist(), s[rest][order].tolist()))
    return out


def test_recall_and_scores_on_whole_table(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float32).astype(np.float64)
    at = {i: k for k, i in enumerate(ids.tolist())}
    got = ann.op3_ann(spark, sf).collect()
    by: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    want = brute_force(ids, x, [i for i in ids.tolist() if i % 20 == 0])
    assert by.keys() == want.keys()
    hit = total = 0
    for q, mine in by.items():
        assert [r.rank for r in mine] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            assert r.score == pytest.approx(float(x[at[r.vec_id]] @ x[at[q]]), rel=1e-12)
            assert r.vec_id != q
        hit += len({r.vec_id for r in mine} & {i for i, _ in want[q]})
        total += len(want[q])
    assert hit / total >= 0.9


def test_clusters_of_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(6, 16)), 50, axis=0).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    by: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    want = brute_force(np.arange(len(x)), x.astype(np.float64), by)
    assert len(by) == 15
    same = sum(len({r.vec_id for r in by[q]} & {i for i, _ in want[q]}) for q in by)
    assert same / (15 * 20) >= 0.9


def test_few_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [2.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (40, [nan, nan])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, list string, score int")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 4.0), (0, 2, 21, 4.0), (20, 1, 21, 5.0), (20, 2, 0, 4.0)]
    none = df.limit(0)
    assert ann.nearest(none, none).collect() == []
    assert ann.nearest(df, none).collect() == []


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    s = q @ x.T
    bound = np.sort(s, axis=1)[:, -20]
    qi, ci, score = ann.scan(q, q @ rotation, np.arange(1000, 1020), bound, x, x @ rotation, np.arange(500), 20)
    want = {(1000 + i, j) for i in range(20) for j in np.argsort(-s[i])[:20].tolist()}
    got = set(zip(qi.tolist(), ci.tolist()))
    assert len(got & want) / len(want) >= 0.95
    assert score == pytest.approx(s[qi - 1000, ci])


def test_doubles_are_scored_as_doubles(spark):
    """Scores to the last digit, ties by it, and values beyond the range of floats and of squares."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) + 1e-9 * rng.normal(size=(300, 8))
    x[50:60] = x[40] + 1e-11 * np.arange(10)[:, None]  # equal as floats
    x[290], x[291], x[292] = 1e60 * x[290], 1e200 * x[291], 1e-300 * x[292]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    want = brute_force(np.arange(300), x, range(0, 300, 20))
    for r in got:
        assert r.score == pytest.approx(float(x[r.vec_id] @ x[r.query_id]), rel=1e-14, abs=1e-14)
    same = sum((r.query_id, r.vec_id) in {(q, i) for q, w in want.items() for i, _ in w} for r in got)
    assert len(got) == 15 * 20 and same / len(got) >= 0.95
    assert {r.rank: r.vec_id for r in got if r.query_id == 40} == {k + 1: i for k, (i, _) in enumerate(want[40])}


def test_recall_of_the_scan_alone(spark):
    """20,000 vectors in 200 clusters, without anchors: lists, probes and the test alone reach the neighbours."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(200, 32))[rng.integers(0, 200, 20_000)] + 0.5 * rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(df, df.where("vec_id % 200 = 0"), 20, anchors=0).collect()
    want = brute_force(np.arange(20_000), x.astype(np.float64), range(0, 20_000, 200))
    pairs = {(q, i) for q, w in want.items() for i, _ in w}
    assert sum((r.query_id, r.vec_id) in pairs for r in got) / len(pairs) >= 0.95


def _pair_by_pair(q, rq, q_ids, bound, x, rx, ids):
    """The tests of the scan, one pair after the other."""
    dim, out = x.shape[1], set()
    for i in range(len(q)):
        for j in range(len(x)):
            qq, xx = q[i] @ q[i], x[j] @ x[j]
            most = qq + xx - 2 * bound[i] + 1e-5 * (qq + xx)
            part = np.cumsum((rq[i] - rx[j]) ** 2)
            ends = [min(dim, a + ann.COLUMNS) for a in range(0, dim, ann.COLUMNS)]
            allowed = [((1 + ann.EPSILON / np.sqrt(b)) ** 2 if b < dim else 1) * (b / dim) * most + 1e-9 for b in ends]
            if q_ids[i] != ids[j] and most >= 0 and all(part[b - 1] <= a for b, a in zip(ends, allowed)):
                out.add((int(q_ids[i]), int(ids[j])))
    return out


@pytest.mark.parametrize("spread", [0.2, 50.0])
def test_tiles_and_gathered_pairs_abandon_the_same(spread):
    """Clustered vectors (few pairs live after a block) and shapeless ones (most live), more queries than a tile, a last block that isn't full."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(10, 40))
    x, q = (centers[rng.integers(0, 10, n)] + spread * rng.normal(size=(n, 40)) for n in (90, 2 * ann.TILE + 5))
    rotation = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    bound = np.sort(q @ x.T, axis=1)[:, -8]
    q_ids, ids = np.arange(50, 50 + len(q)), np.arange(len(x))
    qi, ci, _ = ann.scan(q, q @ rotation, q_ids, bound, x, x @ rotation, ids, len(x))
    assert set(zip(qi.tolist(), ci.tolist())) == _pair_by_pair(q, q @ rotation, q_ids, bound, x, x @ rotation, ids)


def test_shapeless_vectors_are_not_gathered_pair_by_pair():
    """Where the tests abandon little, a block costs matrix products: no copy of a column block for every pair."""
    import tracemalloc

    rng = np.random.default_rng(9)
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(n, 64)) for n in (700, 500)))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    args = (q, q @ rotation, np.arange(1000, 1500), np.full(500, 0.4), x, x @ rotation, np.arange(700), 20)
    tracemalloc.start()
    ann.scan(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 * 700 * ann.COLUMNS * 8 / 4
