import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from foresight.llm import blocks
from foresight.llm.queries import QUERIES
from foresight.llm.repeats import remove_repeats


def brute(texts, length=200):
    starts = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        out.append((len(b), [(int(a), int(c)) for a, c in zip(edges[::2], edges[1::2], strict=True)]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{w}é" if w % 7 == 0 else f"w{w}" for w in range(800)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    line, passage = prose(30), prose(90)
    texts = [None, "", "x", "a" * 199, "b" * 200, "c" * 201, "c" * 900, "ab" * 300 + "q", prose(60)]
    texts += [f"{prose(rng.randint(0, 9))} {line} {prose(rng.randint(0, 9))}" for _ in range(30)]
    texts += [passage[rng.randint(0, 90) :] + prose(20) for _ in range(8)]
    long = prose(400)
    for _ in range(20):
        parts = long.split(" ")
        for _ in range(rng.randint(0, 6)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    texts += [long] * 5 + [prose(50) + long[300:505] + prose(50), prose(9) + long[700:898] + prose(9)]
    return texts


def check(out, texts):
    want = brute(texts)
    got = {r.doc_id: r for r in out}
    assert len(out) == len(texts)
    for i, (n, spans) in enumerate(want):
        assert got[i].n_bytes == n
        assert [(s.start, s.end) for s in got[i].spans] == spans, (i, texts[i])
        raw, kept, at = (texts[i] or "").encode(), b"", 0
        for a, b in [*spans, (n, n)]:
            kept, at = kept + raw[at:a], b
        assert bytes(got[i].kept) == kept


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    check(remove_repeats(docs).collect(), texts)


def test_texts_in_pieces(spark, monkeypatch):
    """Pieces shorter than a text: their borders must not show."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(blocks.PIECE + 5_000))
    texts = [long, long[:700] + "X" + long[blocks.PIECE - 400 : blocks.PIECE + 400], "tail " + long[-450:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(docs).collect()}
    at = blocks.PIECE
    assert out == {0: [(0, 700), (at - 400, at + 400), (at + 4_550, at + 5_000)], 1: [(0, 700), (701, 1501)], 2: [(5, 455)]}


def test_repeated_rows_and_empty_table(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, None)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, bytes(r.kept), r.n_bytes) for r in remove_repeats(docs).collect())
    assert out == [(0, b"", 0), (0, b"short", 5), (1, b"", len(text)), (1, b"", len(text))]
    assert remove_repeats(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op6_suffix_repeats"](spark, str(tmp_path)).collect()
    gone = next(r for r in rows if r.doc_id == 1)
    assert (gone.n_removed, gone.n_spans, gone.kept_sha256) == (len(text), 1, hashlib.sha256(b"").hexdigest())
