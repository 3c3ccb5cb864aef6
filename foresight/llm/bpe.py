"""Byte-level BPE: encode texts with a local rank file and decode ids to raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight.llm.arrow import slices

#: Texts are cut near multiples of this many characters.
SEGMENT = 1 << 15
# Python and Rust disagree on a few control characters, so none of them borders a cut.
_SOLID = r"[^\s\x1c-\x1f\x85\u180e\u200b]"
#: Between two solid characters a single space always starts a new match of the pattern.
_CUT = re.compile(rf"{_SOLID}(?= {_SOLID})")
#: The pattern's lookahead needs stack for each character of a run of white space.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut ``text`` where no match of the pattern can reach across; a text without such a place stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class Codec:
    """The tiktoken library over one rank file, safe for texts of any length."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import tiktoken

        table = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        self.own = {"mergeable_ranks": table, "special_tokens": {}}
        self.by_pattern = tiktoken.Encoding("ranks", pat_str=pattern, **self.own)

    @cached_property
    def as_one(self):
        """Takes a whole text as one match; only texts with long runs of white space need it."""
        import tiktoken

        return tiktoken.Encoding("ranks-whole", pat_str=r"[\s\S]+", **self.own)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        start = 0
        for run in _LONG_BLANK.finditer(text):
            # All of a run but its last character is one match; the last may begin the next one.
            end = run.end() if run.end() == len(text) else run.end() - 1
            self._extend(ids, text[start : run.start()])
            ids.extend(self.as_one.encode_ordinary(text[run.start() : end]))
            start = end
        self._extend(ids, text[start:])
        return ids

    def _extend(self, ids: list[int], text: str) -> None:
        for part in segments(text) if len(text) > SEGMENT else (text,):
            ids.extend(self.by_pattern.encode_ordinary(part))

    def decode(self, ids: list[int]) -> bytes:
        return self.by_pattern.decode_bytes(ids)


_codecs: dict[int, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """One codec per Python worker and rank file."""
    key = hash((ranks.value, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def encode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = "decoded",
) -> DataFrame:
    """Add the token ids of every text, packed as little-endian unsigned 32-bit integers.

    ``decoded_col`` also adds the raw bytes that the ids stand for, straight from the ids. The rank
    file (about a megabyte, whatever the corpus) is read by the driver and broadcast. A null or
    empty text has no ids. Equal rows give equal rows; an empty table gives an empty table; other
    columns pass through, and one that has the name of an added column is replaced.
    """
    import numpy as np

    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(rank_file).read_bytes())
    added = [ids_col] + ([decoded_col] if decoded_col else [])
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    schema = kept
    for name in added:
        schema = schema.withColumn(name, F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in slices(batches, text_col):
            packed, raw = [], []
            for text in batch.column(text_col).to_pylist():
                ids = codec.encode(text or "")
                packed.append(np.asarray(ids, dtype="<u4").tobytes())
                if decoded_col:
                    raw.append(codec.decode(ids))
            columns = [pa.array(packed, pa.binary())] + ([pa.array(raw, pa.binary())] if decoded_col else [])
            yield pa.RecordBatch.from_arrays(batch.columns + columns, names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, schema.schema)


def decode(
    frame: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """Add the raw bytes of packed ids; null ids give no bytes. Bytes need not be valid UTF-8."""
    import numpy as np

    ranks = frame.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    kept = frame.select(*[F.col(f"`{c}`") for c in frame.columns if c != decoded_col])
    schema = kept.withColumn(decoded_col, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in slices(batches, ids_col):
            raw = [
                codec.decode(np.frombuffer(x or b"", dtype="<u4").tolist())
                for x in batch.column(ids_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, decoded_col]
            )

    return kept.mapInArrow(run, schema)
