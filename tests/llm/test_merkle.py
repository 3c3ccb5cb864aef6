import random
from hashlib import sha256

import pytest

from foresight.llm.merkle import fold, manifest, siblings, tree
from pyspark.sql import functions as F

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, group int, rank string, levels int, key int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows):
    """rows: tuples of FIELDS. Plain lists, levels rebuilt from the text of the contract."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    placed = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}

    def climb(nodes, place):
        codes = []
        while len(nodes) > 1:
            run = nodes[place // 2 * 2 : place // 2 * 2 + 2]
            codes.append((place % 2, [n for k, n in enumerate(run) if k != place % 2]))
            nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            place //= 2
        return codes, nodes[0]

    subroots = [climb([leaf_of(r) for r in placed[x]], 0)[1] for x in langs]
    root = climb(subroots, 0)[1] if rows else None
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(placed[x]):
            codes = climb([leaf_of(q) for q in placed[x]], i)[0] + climb(subroots, k)[0]
            proof = H(*[s for _, others in codes for s in others])
            changed = r[3] is not None and r[0] is not None and r[0] % 3 == 0
            node = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            for side, others in codes:
                node = H(*others, node) if side else H(node, *others)
            out.append((r[0], leaf_of(r), subroots[k], root, proof, node, node == root))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "r", 2, 3) for r in rows], SCHEMA)
    altered = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return sorted([tuple(r) for r in manifest(frame, FIELDS, altered=altered).collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 257, 1100])
def test_equals_plain_lists(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(-(10**12), 10**12) if i % 2 else i, "s", "en", i, f"text {i} é") for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_groups_ties_nulls_and_repeats(spark):
    rng = random.Random(7)
    rows = [(i * 37, rng.choice(["a", None]), rng.choice(["en", "de", None, "é", ""]), i, "x" * (i % 9)) for i in range(300)]
    rows += [(5, "a", "en", 1, f"other {i % 4}") for i in range(60)]  # one id, many rows, some equal
    rows += [(None, None, "en", None, None)] * 3 + [(None, "b", None, 4, "")]
    rows += [(-(2**63), "a", "de", 1, "low"), (2**63 - 1, "a", "de", 1, "high"), (64, "long", "fr", 9, "y" * 2_000_000)]
    found = run(spark, rows)
    assert found == brute(rows)
    assert all(r[6] == (r[5] == r[3]) for r in found) and {r[6] for r in found} == {True, False}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_every_proof_folds_to_the_root():
    for n in range(1, 20):
        nodes = [H(str(i)) for i in range(n)]
        levels = tree(nodes, (n - 1).bit_length())
        assert all(fold(nodes[i], siblings(levels, i)) == levels[-1][0] for i in range(n))
