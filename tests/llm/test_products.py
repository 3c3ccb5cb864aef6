import numpy as np
import pytest
from pyspark.sql import functions as F

from foresight.llm.products import best, exact, Rows, top_products

SCHEMA = "vec_id long, embedding array<double>, place int, block string"


def brute(rows, step, k):
    """Every query against every other row; null ids are candidates only, short vectors are padded."""
    good = [
        (i, [int(np.floor(256 * x)) if abs(x) < 2**52 else int(x) * 256 for x in v])
        for i, v in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % step:
            continue
        scores = []
        for b, (j, w) in enumerate(good):
            if a != b:
                s = sum(x * y for x, y in zip(v, w))
                scores.append((-max(-(2**63) + 1, min(2**63 - 1, s)), j is None, j or 0))
        for rank, (s, missing, j) in enumerate(sorted(scores)[:k], 1):
            out.append((i, rank, None if missing else j, -s))
    return sorted(out, key=str)


def run(spark, rows, step=5, **options):
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)
    found = top_products(frame, F.col("vec_id") % step == 0, **options)
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * rng.exponential()).tolist()) for i in range(300)]
    rows += [(300 + i, [0.25] * 12) for i in range(40)]  # ties and copies
    assert run(spark, rows, block_rows=block_rows, query_rows=32) == brute(rows, 5, 5)


def test_groups_meet_in_many_partitions(spark):
    """Both sides' keys hash alike: without merged shuffle partitions every block still meets its queries."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * rng.exponential()).tolist()) for i in range(300)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        for sizes in ({}, {"block_rows": 16, "query_rows": 7}):
            assert run(spark, rows, **sizes) == brute(rows, 5, 5)
    finally:
        spark.conf.set(name, before)


def test_vectors_longer_than_the_rotation(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=530).tolist()) for i in range(20)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, -2.0, 0.5]), (5, None), (10, [1.0, None, 0.0]), (15, [float("nan"), 0.0, 0.0]),
        (20, [float("inf"), 1.0, 1.0]), (25, [0.0, 0.0, 0.0]), (30, []), (35, [2.0]), (None, [1.0, 1.0, 1.0]),
        (40, [1e300, -1e300, 3.0]), (45, [1e9, 1e9, 1.0]), (1, [1.0, -2.0, 0.5]), (0, [1.0, -2.0, 0.5]),
        (0, [3.0, 0.0, 0.0]), (2, [-1e308, 1.0, 1.0]),
    ]
    assert run(spark, rows) == brute(rows, 5, 5)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(0, None), (5, [None])]) == []


def test_bounds_leave_pairs_out():
    """On vectors with a falling spectrum most pairs are never multiplied out, and none that counts is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    z = np.floor(rng.normal(size=(2000, 32)) * 256 * 0.7 ** np.arange(32) * rng.exponential(size=(2000, 1)))
    z = z[np.argsort(-np.linalg.norm(z, axis=1))]
    table = pa.table({"place": np.arange(2000), "id": np.arange(2000), "z": pa.array(z.tolist())})
    rotation = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    rows = Rows.load(table, rotation, 32)
    asked = Rows.load(table.slice(700, 40), rotation, 32)
    calls = []

    def counted(q, c, inner=exact):
        calls.append(len(q))
        return inner(q, c)

    import foresight.llm.products as module

    module.exact = counted
    try:
        q, c, s = best(asked, rows, np.full(40, -np.inf), 5)
    finally:
        module.exact = exact
    full = asked.z @ z.T * 65536
    full[np.arange(40), 700 + np.arange(40)] = -np.inf
    assert (np.sort(full, axis=1)[:, -5:][:, ::-1].ravel() == s).all()
    assert sum(calls) < 0.2 * full.size
