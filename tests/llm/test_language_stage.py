import random

import corpus_pipeline


def test_short_long_and_mixed_texts_stay(spark):
    """Four made-up languages, each with letters of its own."""
    rng, letters = random.Random(7), ["abcdefg", "hijklmn", "opqrstu", "vwxyzéß"]

    def text(k, n):
        return " ".join("".join(rng.choices(letters[k], k=rng.randint(2, 8))) for _ in range(n))

    rows = [(100 * k + i, text(k, 80), f"l{k}") for k in range(4) for i in range(40)]
    long = text(0, 100_000)
    mixed = " ".join(text(k, 40) for k in range(4))
    odd = [(900, "Hi", "l1"), (901, "a", "l0"), (902, long, "l0"), (903, mixed, "l2"), (904, "Ω", None)]
    gone = [(950, "12 !!", "l0"), (951, "", "l0"), (952, None, "l0")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in [*rows, *odd, *gone]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert set(out) == {r[0] for r in rows} - {950, 951, 952}
    assert out[900] == "l1" and out[904] is not None
