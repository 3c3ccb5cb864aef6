import random
import re
from collections import defaultdict

import pytest

from foresight.llm.mixing import draw, mix

SF = "/root/testdata/sf0.01"


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(sizes):
    """The contract by hand: stop at three times the size, share the excess again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        open_ = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: 3 * sizes[s] for s in above}


def check(rows, out):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
        longest[source] = max(longest[source], size(text))
    want = targets(sizes)
    taken = defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size
        whole = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.size == 0 or abs(r.copies - whole) < 1 + 1e-9
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6


@pytest.mark.parametrize("fan_in", [4, 64])
def test_targets_and_totals(spark, fan_in):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 80), rng.choice("abcdef" + "g" * 8)) for i in range(1500)]
    rows += [(2000 + i, "v " * 3, "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs, fan_in=fan_in).collect()
    check(rows, out)
    again = mix(docs.repartition(5), fan_in=fan_in).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_edges(spark):
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\x0b", None),
        (4, "one two", None),
        (None, "three four five", "b"),
        (5, "same row", "b"),
        (5, "same row", "b"),
        (6, "x" * 50_000 + " y", "é"),
        (7, "", "empty"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    out = mix(docs).collect()
    assert len(out) == len(rows)
    same = [r.taken for r in out if r.doc_id == 5]
    assert same[0] == same[1]
    by_source = {r.source: r.target for r in out}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    assert by_source == pytest.approx(targets(sizes))
    assert mix(docs.limit(0)).count() == 0 and draw(docs.limit(0)).count() == 0
    drawn = sorted((r.doc_id or 0, r.text) for r in draw(docs).collect())
    assert drawn == sorted((r.doc_id or 0, t) for r in out if r.taken for t in [named(rows, r)] * r.copies)


def named(rows, r):
    return next(t for i, t, s in rows if (i, s, size(t)) == (r.doc_id, r.source, r.size))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check(rows, mix(docs).collect())
