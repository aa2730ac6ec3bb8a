"""Nearest neighbours against brute force: scores, order, and recall of at least 0.9."""

import numpy as np
import pytest

from marketframe.llm import neighbours


def brute(rows, queries, k=5):
    good = {i: np.asarray(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            scored = sorted((-neighbours.cosine(v, good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("effort,least", [(1.1, 1.0), (neighbours.EFFORT, 0.9)])
def test_against_brute_force(spark, monkeypatch, effort, least):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 60)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # equal vectors
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [1.0, None] * 4), (3150, [float("nan")] * 8), (3200, [float("inf")] * 8), (3250, []), (3300, [1.0, 0.5, 0.1]), (3301, [1.0, 0.1, 0.1]), (3302, [-1.0] * 3), (3350, [1.0] * 4), (None, [1.0] * 8), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as v")
    got = {}
    for r in neighbours.search(df, df.filter("vec_id % 50 = 0"), effort=effort).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute([r for r in rows if r[0] is not None], [i for i, _ in rows if i is not None and i % 50 == 0])
    want = {q: near for q, near in want.items() if near}
    assert got.keys() == want.keys() and 3300 in got and 3350 not in got
    hits = 0
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        truth = dict(want[q])
        hits += len(truth.keys() & {i for i, _ in near})
    assert hits >= least * sum(map(len, want.values()))
    if effort > 1:
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-15)


def test_clustered_vectors_are_exact_for_little_work(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 40)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16))
    rows = [(i, (centres[i % 60] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    opened = []
    whole = neighbours.counted
    monkeypatch.setattr(neighbours, "counted", lambda x: (opened.append(sum(found.values())), found)[1] if (found := whole(x)) is not None else None)
    got = {}
    for r in neighbours.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    v = neighbours.unit(np.asarray([x for _, x in rows]))
    for q, near in got.items():
        s = v @ v[q]
        s[q] = -9
        assert near == np.argsort(-s, kind="stable")[:5].tolist()
    assert opened[2] < opened[1]  # less is opened behind the first tenth than in it


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.digest(df).collect()] == [(0, 1, 1)]
    assert neighbours.digest(df.limit(0)).count() == 0


def test_recall_on_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, v = np.asarray([i for i, _ in rows]), neighbours.unit(np.asarray([x for _, x in rows], dtype=float))
    got = {}
    for r in neighbours.digest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = v @ v[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(got[q] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)
