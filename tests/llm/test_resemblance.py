import random

import corpus_pipeline
from foresight.llm.resemblance import bands, deduplicate, shingles


def jaccard(a, b):
    words = [t.lower().split() for t in (a, b)]
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words)
    return len(x & y) / len(x | y)


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def kept_by_brute_force(texts):
    roots = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                roots = [roots[j] if r == roots[i] else r for r in roots]
    return {min(i for i, r in enumerate(roots) if r == root) for root in roots}


def make(seed, families, length=200):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        texts += [" ".join(words), " ".join(words).upper()]
        texts += [changed(rng, words, rng.randint(1, 8)) for _ in range(5)]
    rng.shuffle(texts)
    return texts


def test_stage_equals_brute_force(spark):
    texts = [*make(3, 12), "one two", "one  Two", "three", "some line of few words", "some line of few word"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == kept_by_brute_force(texts)


def test_pairs_just_above_the_similarity_meet():
    rng, pairs, met = random.Random(5), 0, 0
    while pairs < 200:
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = changed(rng, words, 6)
        if 0.8 <= jaccard(" ".join(words), other) <= 0.85:
            pairs += 1
            met += bool((bands(shingles(" ".join(words))) == bands(shingles(other))).any())
    assert met == pairs


def test_small_units_and_odd_rows(spark):
    texts = make(4, 6, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (900, None), (901, ""), (902, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(texts) | {900}
    assert {r.doc_id for r in deduplicate(docs, unit_rows=4).collect()} == want
    assert deduplicate(docs.limit(0)).count() == 0


def test_fingerprint_groups_link_first(spark, monkeypatch):
    """Operator 1 takes part: with bands that never meet, what its radius holds is linked all the same."""
    from foresight.llm import resemblance
    from foresight.llm.simhash import fingerprint

    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(800)]
    texts = [" ".join(words), *(changed(rng, words, 1) for _ in range(6)), "quite another text of a few words"]
    marks = [fingerprint(t) for t in texts]
    near = [i for i, m in enumerate(marks) if (m ^ marks[0]).bit_count() <= 4]
    assert len(near) > 3 and len(texts) - 1 not in near
    monkeypatch.setattr(resemblance, "_signed", _without_bands(resemblance._signed))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in deduplicate(docs).collect()}
    assert kept == set(range(len(texts))) - (set(near) - {0})


def test_a_group_just_below_the_similarity_writes_no_pairs(spark, monkeypatch):
    """All rows share buckets and hardly any are alike: tables grow with the rows, not with their square."""
    from foresight.llm import resemblance
    from foresight.llm.workspace import Workspace

    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [changed(rng, words, 4) for _ in range(150)]
    written, put = {}, Workspace.put

    def counted(self, df, name):
        out = put(self, df, name)
        written[name] = out.count()
        return out

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept_by_brute_force(texts)
    assert len(want) > 100
    monkeypatch.setattr(Workspace, "put", counted)
    assert {r.doc_id for r in deduplicate(docs).collect()} == want
    assert max(written.values()) <= resemblance.BANDS * len(texts)  # 10,622 pairs before
    monkeypatch.setattr(resemblance, "UNIT_HASHES", 4000)  # some twenty texts a unit
    assert {r.doc_id for r in deduplicate(docs, unit_rows=64).collect()} == want


def _without_bands(signed):
    def run(batches, shingle):
        import pyarrow as pa

        for batch in signed(batches, shingle):
            empty = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], empty], names=batch.schema.names)

    return run


def test_unalike_texts_of_one_fingerprint_group_stay(spark):
    """Texts of one word each: a fingerprint group may hold them, their sets are not alike."""
    words = [f"x{i}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert deduplicate(docs).count() == len(words)


def test_batches_are_bounded_in_bytes(spark):
    corpus_pipeline.prepare(spark)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    wide = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) as x")
    assert max(r.n for r in wide.mapInArrow(sizes, "n bigint").collect()) < 2 * corpus_pipeline.BATCH_BYTES
