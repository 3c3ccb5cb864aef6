import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foresight.llm.bpe import SEGMENT, decode, encode, segments

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None,
    "",
    "it's  two   words\n\n and <|endoftext|> 12 größe",
    "word " * 20_000,
    "x" * 70_000,
    "a" + " " * 9_000 + "b c" + "\n" * 5_000,
    " " * 5_000 + "\n" + " " * 4_500 + "'s end",
    ("mixed  text, 'll  do  it! 漢字 " * 3_000) + "\x1c \x85 z",
]


def test_round_trip_and_library_ids(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(docs, FILE, PATTERN).collect()
    assert len(out) == len(rows)
    for row in out:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()


def test_decode_of_single_bytes(spark, library):
    ids = library.encode_ordinary("é漢")
    packed = np.asarray(ids[:1], "<u4").tobytes()
    frame = spark.createDataFrame([(bytearray(packed),), (None,)], "ids binary")
    assert [bytes(r.decoded) for r in decode(frame, FILE, PATTERN).collect()] == [
        library.decode_bytes(ids[:1]),
        b"",
    ]


def test_segments_rejoin_and_are_short():
    text = "one two  three " * 30_000
    parts = list(segments(text))
    assert "".join(parts) == text and max(map(len, parts)) < SEGMENT + 100


def test_empty_table_and_query(spark, library, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode(docs, FILE, PATTERN).count() == 0
    from foresight.llm.queries import QUERIES

    spark.createDataFrame([(3, "some text here")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    (row,) = QUERIES["op4_byte_bpe"](spark, str(tmp_path)).collect()
    ids = library.encode_ordinary("some text here")
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"some text here").hexdigest()
