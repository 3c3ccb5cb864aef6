import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from foresight.llm.bktree import BKTree
from foresight.llm.graph import Forest, components
from foresight.llm.simhash import deduplicate, fingerprint, link_fingerprints, near_duplicates
from foresight.llm.workspace import Workspace


def plain(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(marks, radius):
    """Brute force: smallest index of each one's component."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(marks))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B c D e F a B c D", "é\x0bÀ x " * 50, "w " * 40_000])
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


def flipped(rng, mark, bits):
    for b in rng.sample(range(64), bits):
        mark ^= 1 << b
    return mark


def test_tree_finds_all_within_radius():
    rng = random.Random(5)
    marks = [rng.getrandbits(64) for _ in range(300)]
    marks += [flipped(rng, rng.choice(marks), rng.randint(0, 6)) for _ in range(500)]
    points = np.array(marks, dtype=np.uint64)
    found = {
        (int(q), int(p)) for qs, ps in BKTree(points).search(points, 4) for q, p in zip(qs, ps, strict=True)
    }
    assert found == {
        (i, j) for i in range(800) for j in range(800) if (marks[i] ^ marks[j]).bit_count() <= 4
    }


@pytest.mark.parametrize("unit_rows", [16, 4096])
def test_links_connect_what_brute_force_connects(spark, unit_rows):
    rng = random.Random(9)
    marks = [rng.getrandbits(64) for _ in range(60)] + [0]
    for _ in range(240):
        marks.append(flipped(rng, rng.choice(marks), rng.randint(1, 5)))
    marks = sorted({int(np.uint64(m).astype(np.int64)) for m in marks})
    space = Workspace(spark, "test")
    distinct = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    edges = link_fingerprints(distinct, space, unit_rows=unit_rows)
    roots = {r.node: r.root for r in components(edges, space).collect()}
    unsigned = [m % (1 << 64) for m in marks]
    want = grouped(unsigned, 4)
    assert [roots.get(m, m) for m in marks] == [marks[i] for i in want]


def test_components_of_chain_star_and_ties(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1, k) for k in range(2, 60)] + [(7, 7), (3, 1), (1, 3)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    out = {r.node: r.root for r in components(edges, Workspace(spark, "test")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)}


def test_forest():
    forest = Forest(6)
    forest.link(np.array([5, 3, 4]), np.array([4, 2, 3]))
    assert forest.parent.tolist() == [0, 1, 2, 2, 2, 2]


def test_documents(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words]
    near[7] = "other"
    rows = [
        (9, " ".join(words), 1),
        (4, " ".join(near), 1),
        (6, None, 1),
        (5, " \n", 1),
        (5, "", 1),
        (8, "quite another text with words of its own", 1),
        (None, " ".join(words), 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    out = sorted(
        (r.doc_id or -1, r.fingerprint % (1 << 64), r.component_id) for r in near_duplicates(docs).collect()
    )
    marks = [plain(t) for _, t, _ in rows]
    assert (marks[0] ^ marks[1]).bit_count() <= 4
    named = [4, 4, 5, 5, 5, 8, 4]
    assert out == sorted((i or -1, m, c) for (i, _, _), m, c in zip(rows, marks, named, strict=True))
    assert near_duplicates(docs.limit(0)).count() == 0
    left = sorted((r.doc_id or 0, r.text) for r in deduplicate(docs).collect())
    assert [i for i, _ in left] == [4, 5, 8] and left[0][1] == " ".join(near)
    nameless = docs.filter("doc_id is null").union(docs.filter("doc_id is null"))
    assert deduplicate(nameless).count() == 1 and deduplicate(docs.limit(0)).count() == 0
