import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from foresight.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int, conv string, part int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {k: 0 for k in members}
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            (
                min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k],
                sha256(",".join(map(str, sorted(c for c in cs if len(made[c]) == len(k)))).encode()).hexdigest(),
            )
            for k, cs in members.items()
        ),
        key=str,
    )


def run(spark, rows, partitions=None):
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    conv = F.col("conv")
    found = conversation_trie(frame, conv - conv % 5, F.crc32(conv.cast("string")) % 9, partitions=partitions)
    return sorted([tuple(r) for r in found.collect()], key=str)


def talks(seed, n=160):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, turn, rng.choice(["user", "system"]), rng.choice(["hi", "é" * 3, "x", None])))
    return rows


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_equals_brute_force(spark, partitions):
    rows = talks(4)
    assert run(spark, rows, partitions) == brute(rows)


def test_copies_long_talks_and_turnless_ones(spark):
    rows = [(5 * i, t, "user", f"turn {t}") for i in range(90) for t in range(6)]  # one large group of copies
    rows += [(1000, t, "user", f"turn {t}" if t < 60 else f"own {t}") for t in range(240)]  # one long talk
    rows += [(1005, t, "user", f"turn {t}") for t in range(60)]
    rows += [(c, 0, "user", "only") for c in range(2001, 2005)]  # bases are absent: some end up without a turn
    rows += [(c, None, None, None) for c in (3000, 3001)] + [(None, 0, "user", "lost")] * 3
    found = run(spark, rows, 9)
    assert found == brute(rows)
    assert found == run(spark, rows)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []
    for rows in ([(3, 0, "user", "x")], [(0, 0, None, None)], [(7, 1, "a", "y" * 3_000_000), (7, None, "b", "")]):
        assert run(spark, rows) == brute(rows)
