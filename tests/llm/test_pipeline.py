import base64
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_mixing import size, targets
from tests.llm.test_pii import base
from tests.llm.test_resemblance import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9_000, None, "en", "src1", 0), (9_001, "12 !!", None, "src1", 5), (9_002, "", "fr", None, 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "byte_bpe" or docs.columns == before.columns
        kept.append([r.asDict() for r in docs.collect()])
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known, single, clean, drawn, coded = kept
    assert {r["doc_id"] for r in known} == set(whole)
    ids = sorted(whole)
    assert {r["doc_id"] for r in single} == {ids[k] for k in kept_by_brute_force([whole[i] for i in ids])}
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert set(texts) == {r["doc_id"] for r in single}
    for i, text in texts.items():
        found = base(whole[i])
        assert not base(text) and (found or text == whole[i])
        assert not any(whole[i][int(a) : int(b)] in text for _, a, b in (f.split(":") for f in found))
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in clean:
        sizes[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    for r in drawn:
        assert r["text"] == texts[r["doc_id"]]
        taken[r["source"]] += size(r["text"])
    for source, want in targets(sizes).items():
        assert abs(taken[source] - want) <= longest[source]
    with open(public_tokenizers.path(corpus_pipeline.RANK_FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in drawn)
    for r in coded:
        assert r["text"] == texts[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "ids", "n_tokens"} <= set(out.columns) and out.count() > 100


CLASHING = ["_row", "_id", "_lang", "_score", "_copies", "_spans", "_source", "_size", "row", "id", "_others", "decoded"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_with_the_names_of_helpers(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, f"text number {i} of the lot, write to a{i % 3}@mail.example", "en" if i % 2 else None, "s", 1, *["mine"] * len(CLASHING)) for i in range(12)]
    rows += [(12, None, None, None, None, *["mine"] * len(CLASHING)), rows[0]]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, columns)
    out = stage(spark, docs, "")
    own = {"byte_bpe": {"ids", "decoded", "n_tokens"}}.get(name, set())
    kept = [c for c in CLASHING if c not in own]
    found = out.collect()
    assert found and all(r[c] == "mine" for r in found for c in kept)
    assert name == "byte_bpe" or out.columns == docs.columns
    assert stage(spark, docs.limit(0), "").count() == 0


def test_no_text_is_lost_without_languages(spark):
    docs = spark.createDataFrame(
        [(1, "good words", None, "s", 10), (2, "more good words", None, "s", 15), (3, "12 !!", None, "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    out = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.lang) for r in out) == [(1, None), (2, None)]
