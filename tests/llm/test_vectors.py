import math

import numpy as np
import pytest

from foresight.llm.graph import Forest
from foresight.llm.hnsw import nearest
from foresight.llm.pivots import near_vectors

SF = "/root/testdata/sf0.01"
BAD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0] * 15 + [None], [float("inf")] + [0.0] * 15, [], [1.0, 2.0]]


def planted(seed, groups=30, copies=12):
    """Loose vectors, groups of near copies in chains of drift, and one large group of equal ones."""
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(200, 16)))
    for _ in range(groups):
        at = rng.normal(size=16)
        for _ in range(copies):
            at = at + rng.normal(size=16) * 0.05
            rows.append(at * rng.uniform(0.5, 2))
    rows += [rows[3]] * 90
    return [r.astype(np.float32).tolist() for r in rows]


def brute(vectors):
    rows = np.array(vectors, dtype=np.float64)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    near |= np.array([[a == b for b in vectors] for a in vectors])
    np.fill_diagonal(near, False)
    forest = Forest(len(rows))
    forest.link(*np.nonzero(near))
    return near.sum(axis=1), forest.parent


@pytest.mark.parametrize("unit_size", [32, 1024])
def test_links_and_components(spark, unit_size):
    good = planted(6)
    rows = list(enumerate(good)) + [(1000 + i, v) for i, v in enumerate(BAD)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, pivot int")
    out = {r.vec_id: r for r in near_vectors(frame, unit_size=unit_size).collect()}
    assert len(out) == len(rows)
    links, roots = brute(good)
    found = np.array([out[i].n_links for i in range(len(good))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    same = np.mean([out[i].component_id == roots[i] for i in range(len(good))])
    assert same > 0.98
    for i, v in rows:
        assert out[i].kept == (out[i].component_id == i)
        if i >= 1000:
            assert (out[i].n_links, out[i].component_id) == (0, i), v


def test_near_vectors_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [-1.0, 0.5])]
    out = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert out == sorted(
        [(5, 3, 2, False), (5, 3, 2, False), (2, 3, 2, True), (None, 3, 2, False), (9, 0, 9, True)], key=str
    )
    assert near_vectors(spark.createDataFrame([(1, None)], schema)).collect()[0].kept


def exact(rows, queries, k):
    table = {i: np.array(v, dtype=np.float64) for i, v in rows}
    out = {}
    for q in queries:
        near = sorted((math.sqrt(((table[q] - v) ** 2).sum()), i) for i, v in table.items() if i != q)
        out[q] = near[:k]
    return out


def test_recall_on_embeddings(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = exact(rows, range(0, 500, 10), 10)
    out = nearest(frame, frame.filter("vec_id % 10 = 0"), shard_rows=128, query_rows=20).collect()
    assert len(out) == 500
    hits = 0
    for r in out:
        hits += any(i == r.vec_id and abs(d - r.score) < 1e-12 for d, i in want[r.query_id])
    assert hits >= 0.95 * len(out)
    assert all(sorted(r.rank for r in out if r.query_id == q) == list(range(1, 11)) for q in want)


def test_ties_copies_and_unusable_vectors(spark):
    good = planted(8, groups=3, copies=4)
    rows = list(enumerate(good)) + [(1000 + i, v) for i, v in enumerate(BAD)] + [(None, good[0]), (0, good[0])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int")
    out = nearest(frame, frame).collect()
    want = exact(list(enumerate(good)), range(len(good)), 10)
    assert {r.query_id for r in out} == set(want)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in out}
    hits = [found[q, 1 + k][0] == i for q, near in want.items() for k, (_, i) in enumerate(near)]
    assert np.mean(hits) > 0.97
    copies = [i for i, v in enumerate(good) if v == good[3]]
    assert [found[3, k][0] for k in range(1, 11)] == copies[1:11]


def test_nearest_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(1, [0.0, 3.0]), (2, [4.0, 0.0]), (3, [0.0, 1.0])], schema)
    out = [tuple(r) for r in nearest(frame, frame.filter("vec_id = 1")).collect()]
    assert sorted(out) == [(1, 1, 3, 2.0), (1, 2, 2, 5.0)]
    assert nearest(frame.limit(0), frame).count() == 0
    assert nearest(frame, frame.limit(0)).count() == 0
    assert nearest(frame.filter("vec_id = 1"), frame).count() == 0
