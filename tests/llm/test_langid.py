import numpy as np
import zlib

from foresight.llm.langid import GRAMS, LanguageModel, fit, grams, held_out, predict
from foresight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_grams_are_the_distinct_ones():
    seen = np.zeros(GRAMS, dtype=bool)
    assert grams("aba", seen).tolist() == [1, 2, 64 + 64 + 2, 64 + 128 + 1, 64 + 64**2 + 64 * 66 + 1]
    assert not seen.any()
    long = "ab cdé" * 400_000
    assert grams(long, seen).tolist() == grams("ab cdé" * 4, seen).tolist()
    assert grams("ABC", seen).tolist() == grams("abc", seen).tolist()
    assert grams("", seen).size == 0 and grams("x", seen).size == 1


def test_scores_equal_the_kernel_product():
    """Scores by whole matrices: kernel with every landmark times ridge weights."""
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(9)]
    marks, solved = texts[:4], rng.normal(size=(4, 2))
    holds = np.zeros((41, 4))
    column = np.zeros(GRAMS, np.int32)
    column[:40] = np.arange(1, 41)
    for j, t in enumerate(marks):
        holds[t + 1, j] = 1 / np.sqrt(len(t))
    model = LanguageModel(["a", "b"], column, holds @ solved)
    kernel = [[len(set(t) & set(m)) / np.sqrt(len(t) * len(m)) for m in marks] for t in texts]
    assert np.allclose(model.scores([*texts, np.zeros(0, np.int32)]), np.vstack([kernel @ solved, np.zeros(2)]))


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_language_kernel"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)


def test_edges(spark):
    rows = [
        (1, "the cat sat on the mat", "en", 0.5),
        (2, "le chat est sur la table", "fr", 0.5),
        (3, None, "en", 0.5),
        (4, "", None, 0.5),
        (5, "12 34 !?", "fr", 0.5),
        (None, "the cat", None, 0.5),
        (1, "the cat sat on the mat", "en", 0.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    out = predict(docs, fit(docs)).collect()
    assert [r.lang_pred for r in out] == ["en", "fr", "und", "und", "und", "en", "en"]
    assert [r.lang_score for r in out[2:5]] == [0, 0, 0]
    nothing = fit(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in predict(docs, nothing).collect()} == {"und"}
    assert {r.lang_pred for r in predict(docs, fit(docs.filter("doc_id = 5"))).collect()} == {"und"}
    assert predict(docs.limit(0), nothing).count() == 0
    assert docs.filter(held_out("doc_id", 5, 0)).filter("doc_id is null").count() == 1


def test_letters_of_every_plane_count(spark):
    """Deseret and Adlam lie above the basic plane, and so does much of Han."""
    seen = np.zeros(GRAMS, dtype=bool)
    for text in ("𐐀𐐁𐐂𐐃𐐄𐐅", "𞤀𞤁𞤂𞤃𞤄𞤅", "𠀀𠀁𠀂𠀃𠀄"):
        assert (grams(text, seen) > 0).any()
    assert grams("𐐀𐐁", seen).tolist() == grams("𐐨𐐩", seen).tolist()
    assert grams("😀😀😀", seen).tolist() == grams("...", seen).tolist()
    rows = [(i, "𐐀𐐁𐐂 𐐃𐐄𐐅 𐐆𐐇"[i % 3 :], "dsrt") for i in range(6)]
    rows += [(10 + i, "𞤀𞤁𞤂 𞤃𞤄𞤅 𞤆𞤇"[i % 3 :], "adlm") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in predict(docs, fit(docs)).collect())
