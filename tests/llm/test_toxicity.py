import math
import random
import zlib

import pytest

from foresight.llm.levenshtein import Trie
from foresight.llm.queries import QUERIES
from foresight.llm.toxicity import ToxicModel, allowed_edits, fit, score, with_features

SF = "/root/testdata/sf0.1"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(400)]
    terms = words[:40]
    trie = Trie((t, allowed_edits(t)) for t in terms)
    for word in words:
        near = [edits(word, t) for t in terms if edits(word, t) <= allowed_edits(t)]
        assert trie.distance(word) == (min(near) if near else None)
    assert Trie([]).distance("abc") is None


def model():
    weights = [-3.0, 2.0, 2.0, 1.0, -1.0, 1.0, 0.0, 0.0]
    import numpy as np

    return ToxicModel({"horrible", "nasty"}, {"rotte"}, {"you": 1.5}, np.array(weights))


def test_kinds_quotes_and_context():
    m = model()
    assert [m.kind(w) for w in ("nasty", "rotten", "horible", "nosty", "nice")] == [1, 2, 3, 3, 0]
    plain = m.features("You are NASTY, you horible rotten thing")
    assert plain[:5] == [math.log1p(1)] * 3 + [0.0, 1.0] and plain[5] > 0
    quoted = m.features('he said "you nasty thing" to her')
    assert quoted[0] == 0 and quoted[3] == math.log1p(1) and quoted[4] == 0
    assert m.features(None) == m.features("") == [0.0] * 7
    long = "word " * 500_000 + "nasty"
    assert m.features(long)[0] == math.log1p(1)


def test_held_out_documents(spark):
    rows = QUERIES["op10_toxic_lexicon"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    known = [(labels[r.doc_id], r.predicted) for r in held if r.doc_id in labels]
    caught = [p for t, p in known if t == 1]
    false = [p for t, p in known if t == 0]
    assert sum(caught) > 0.85 * len(caught) and sum(false) < 0.01 * len(false)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_edges(spark):
    def near(i):
        return "abcdefghij"[i % 10] * 3 + "klmnopqrst"[i // 10 % 10]

    bad = [
        (i, f"calm words {near(i)} awful{'abcdefgh'[i % 8]} {near(i + 7)} beastly tone", 1) for i in range(30)
    ]
    copied = [(40 + i, "a copied text with peculiar words of one author", 1) for i in range(30)]
    good = [(100 + i, f"calm words here then other things {i}", 0) for i in range(180)]
    rows = [*bad, *copied, *good, (500, None, 1), (501, "", 0), (None, "beastly", 1), (0, bad[0][1], 1)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(i, x) for i, _, x in rows] + [(3, None), (7, 0), (9999, 1)], "doc_id long, toxic int"
    )
    learned = fit(docs, labels)
    assert "beastly" in learned.terms and "awfu" in learned.prefixes
    assert "peculiar" not in learned.terms  # many copies are one piece of evidence
    out = {r.doc_id: r.score for r in score(docs, learned).collect()}
    assert len(out) == len({i for i, _, _ in rows})
    assert out[0] > 0.7 > 0.3 > out[100] and out[500] == out[501]
    assert score(docs.limit(0), learned).count() == 0
    assert with_features(docs, learned, "text").columns == ["doc_id", "score", "features"]
    never = fit(docs, labels.filter("toxic = 0"))
    assert max(r.score for r in score(docs, never).collect()) < 1e-6
    nothing = fit(docs.limit(0), labels)
    assert score(docs, nothing).first().score == pytest.approx(0, abs=1e-6)


def test_copied_texts_push_no_term_out(spark):
    """More candidates than one pass takes, and rarer genuine terms among them."""
    letters = "abcdefghij"

    def name(i):
        return "".join(letters[int(d)] for d in f"{i:05d}")

    copied = [
        (1000 * g + c, " ".join(f"copy{name(100 * g + k)}" for k in range(60)), 1) for g in range(45) for c in range(25)
    ]
    bad = [(90_000 + i, f"{name(i)} beastly {name(i + 500)} tone", 1) for i in range(22)]
    good = [(95_000 + i, f"{name(i)} calm {name(i + 700)} words", 0) for i in range(1500)]
    rows = [*copied, *bad, *good]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    whole = fit(docs, labels)
    parts = fit(docs, labels, candidates_per_pass=500)
    assert "beastly" in whole.terms and not any(t.startswith("copy") for t in whole.terms)
    assert parts.terms == whole.terms and parts.prefixes == whole.prefixes


def test_every_proved_term_is_kept(spark):
    """2,100 terms, more than the lexicon once held."""
    letters = "abcdefghij"

    def name(i):
        return "".join(letters[int(d)] for d in f"{i:05d}")[::-1]

    terms = [f"{name(7 * k)}bad" for k in range(2100)]
    bad = [(i, " ".join(f"{t} {name(i * 31 + k)}x" for k, t in enumerate(terms)), 1) for i in range(30)]
    good = [(100 + i, f"calm words here {name(i)}", 0) for i in range(40)]
    rows = [*bad, *good]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    learned = fit(docs, labels)
    assert all(learned.kind(t) in (1, 2) for t in terms)


def test_quotations_of_any_length():
    m = model()

    def counts(text):
        found = m.features(text)
        return found[0], found[3]

    one, far = math.log1p(1), "calm words " * 40
    assert counts(f'he said "{far}you nasty thing {far}" to her') == (0, one)
    assert counts(f'"{far}" she said. you nasty thing {far}"{far}"') == (one, 0)
    assert counts(f'"{far} one" nasty "two {far}"') == (one, 0)
    assert counts(f"„{far}nasty {far}“ and «a “b” nasty» and “a 5\" nasty”") == (0, math.log1p(3))
    assert counts('an "open mark, nasty') == counts('an "open mark\nnasty and" closed') == (one, 0)


def test_short_words_become_terms(spark):
    def name(i):
        return "".join("abcdefghij"[int(d)] for d in f"{i:04d}")

    rows = [(i, f"{name(i)} zub {name(i + 300)} 坏 {name(i + 600)} tone", 1) for i in range(60)]
    rows += [(100 + i, f"{name(i)} calm {name(i + 300)} fox tone", 0) for i in range(180)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    learned = fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert {"zub", "坏"} <= learned.terms and "fox" not in learned.terms


def test_fit_equals_brute_force(spark):
    """Candidates, proof by contexts, lexicon and leans of a small corpus, told word by word."""
    rng = random.Random(5)
    common = [f"wo{c}{d}" for c in "abcdefghij" for d in "abcdefghij"]
    bad_words = ["beastly", "zub", "awfula", "awfulb", "awfulc", "awfuld", "n" * 50]
    rows = []
    for i in range(240):
        toxic = int(i % 4 == 0)
        words = [rng.choice(common) for _ in range(rng.randint(0, 30))]
        for _ in range(2 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(bad_words))
        rows.append((i, " ".join(words), toxic))
    rows += [(1000 + i, "copied peculiar words", 1) for i in range(40)] + [(2000, None, 0), (2000, "x", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i != 2000] + [(2000, 0)], "doc_id long, toxic int")
    learned = fit(docs, labels, candidates_per_pass=3)

    n = [sum(x == label for *_, x in rows) for label in (0, 1)]

    def evidence(toxic, clean):
        base = n[1] / sum(n)
        g = 2 * sum(
            x * math.log(x / ((toxic + clean) * p)) for x, p in ((toxic, base), (clean, 1 - base)) if x
        )
        return g, toxic / n[1] / (toxic / n[1] + clean / n[0])

    holds, family, contexts = {}, {}, {}
    for _, text, toxic in rows:
        for word in set((text or "").split()):
            holds.setdefault(word, [0, 0])[toxic] += 1
    for word, (clean, toxic) in holds.items():
        for k in (4, 5, 6, 7):
            if len(word) > k:
                own = family.setdefault(word[:k], [0, 0, 0])
                own[0], own[1], own[2] = own[0] + clean, own[1] + toxic, own[2] + 1
    wanted = {w for w, (c, t) in holds.items() if evidence(t, c)[1] >= 0.9 and evidence(t, c)[0] >= 25}
    starts = {p for p, (c, t, m) in family.items() if m >= 3 and evidence(t, c)[1] >= 0.9 and evidence(t, c)[0] >= 40}
    for _, text, toxic in rows:
        words = (text or "").split()
        for place, word in enumerate(words):
            around = (words[place - 1] if place else "", words[place + 1] if place + 1 < len(words) else "")
            for key in [word] * (word in wanted) + [p + "*" for p in starts if word.startswith(p) and word != p]:
                contexts.setdefault(key, set()).add((around, toxic))
    proved = set()
    for key, seen in contexts.items():
        toxic = sum(x for _, x in seen)
        g, share = evidence(toxic, len(seen) - toxic)
        if share >= 0.9 and g >= (40 if key.endswith("*") else 25):
            proved.add(key)
    found = {k[:-1] for k in proved if k.endswith("*")}
    prefixes = {p for p in found if not any(p != q and p.startswith(q) for q in found)}
    terms = {k for k in proved if not k.endswith("*") and not any(k.startswith(p) for p in prefixes)}
    assert learned.terms == terms and learned.prefixes == prefixes
    assert {"zub", "n" * 50} <= terms and "awfu" in prefixes and "peculiar" not in terms
    assert learned.kind("n" * 48) == 3 and learned.kind("n" * 47) == 0

    size, slots = len(learned.context.slots), {}
    for word, (clean, toxic) in holds.items():
        if word not in proved:
            own = slots.setdefault(zlib.crc32(word.encode()) % size, [0, 0])
            own[0], own[1] = own[0] + clean, own[1] + toxic
    rate = n[1] / sum(n)
    for word in holds:
        clean, toxic = slots.get(zlib.crc32(word.encode()) % size, (0, 0))
        lean = math.log((toxic + 10 * rate) / (clean + 10 * (1 - rate))) - math.log(rate / (1 - rate))
        assert learned.context.get(word) == pytest.approx(lean, abs=1e-5)
    assert learned.context.get("neverseenword") == pytest.approx(0, abs=1e-6)
