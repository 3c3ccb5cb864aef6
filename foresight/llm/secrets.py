"""Secret scan with corpus-wide ownership frequency.

Candidates are found text by text. Their values are hashed and counted over the whole corpus by
distinct owners and repositories: a value that many owners carry is a copied example, one that a
single owner holds looks live. Free-standing random tokens become findings only when the corpus
says that they are owner-specific.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight.llm.arrow import slices
from foresight.llm.workspace import Workspace

KINDS = ["assign", "access", "hex", "token"]
TOKEN = KINDS.index("token")
#: A value seen with this many owners or more is an example that people copy.
EXAMPLE_OWNERS = 3
#: Least bits a character and least length of a free-standing token.
TOKEN_BITS = 3.0
TOKEN_LENGTH = 20

# Fixed patterns of the three base kinds; those with a counted repeat take the same runs as "+" does.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}")

_FOUND = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])
)
_FOUND_SQL = "array<struct<kind: int, start: bigint, end: bigint, value: bigint>>"


def _digest(value: str) -> int:
    return int.from_bytes(blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _random_looking(value: str) -> bool:
    if value.isalpha() or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= TOKEN_BITS


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, value hash) by start and kind; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((0, m.start(), m.end(), _digest(m[2])))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), _digest(m[0])) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), _digest(m[0])) for m in _HEX.finditer(text)]
    base = sorted((start, end) for _, start, end, _ in found)
    position = 0
    for m in _RUN.finditer(text):
        while position < len(base) and base[position][1] <= m.start():
            position += 1
        apart = position == len(base) or base[position][0] >= m.end()
        if apart and _random_looking(m[0]):
            found.append((TOKEN, m.start(), m.end(), _digest(m[0])))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [
            [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in candidates(text or "")]
            for text in batch.column("text").to_pylist()
        ]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(rows, _FOUND)], names=[*kept, "found"]
        )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source", "lang"),
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans``, sorted by start and kind.

    A span has kind, start, end (code points, end exclusive), value (hash), n_found, n_repositories,
    n_owners and verdict. The verdict is ``example`` for a value with ``example_owners`` owners or
    more, else ``live``. Base kinds stay whatever the verdict; kind ``token`` is kept only where it
    has a single owner. The table needs no owners: a null owner or repository counts as one more.
    Null and empty texts give no spans, repeated rows are scanned each on their own, an empty table
    gives an empty result, and columns not named are ignored.

    Only candidates are shuffled, never texts. Counting folds each map task's rows first; the join
    that brings counts back is a plain equi-join of two shuffles, which AQE splits where one copied
    value holds many rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "secrets")
    picked = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.xxhash64(F.col(owner_col)), F.lit(0)).alias("owner"),
        F.xxhash64(*[F.col(c) for c in repository_cols]).alias("repository"),
        F.col(text_col).cast("string").alias("text"),
    )
    id_type = picked.schema["id"].dataType.simpleString()
    found = space.put(
        picked.mapInArrow(
            _scan, f"id {id_type}, owner bigint, repository bigint, found {_FOUND_SQL}"
        ).withColumn("row", F.monotonically_increasing_id()),
        "found",
    )  # written once, so that row numbers hold for every reader
    single = found.select("row", "owner", "repository", F.explode("found").alias("f")).select(
        "row", "owner", "repository", "f.*"
    )
    counts = (
        single.groupBy("value", "owner", "repository")
        .agg(F.count("*").alias("n"))
        .groupBy("value", "owner")
        .agg(F.sum("n").alias("n"), F.count("*").alias("r"))
        .groupBy("value")
        .agg(
            F.sum("n").alias("n_found"),
            F.sum("r").alias("n_repositories"),
            F.count("*").alias("n_owners"),
        )
    )
    judged = (
        single.join(counts, "value")
        .filter((F.col("kind") != TOKEN) | (F.col("n_owners") == 1))
        .withColumn("verdict", F.when(F.col("n_owners") >= example_owners, "example").otherwise("live"))
    )
    span = F.struct(
        "start", F.col("kind").alias("order"), "end", "value", "n_found", "n_repositories", "n_owners", "verdict"
    )
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.coalesce("spans", F.expr("array()").cast(by_row.schema["spans"].dataType)),
        lambda s: F.struct(
            F.get(names, s["order"]).alias("kind"),
            *[s[c].alias(c) for c in ("start", "end", "value", "n_found", "n_repositories", "n_owners", "verdict")],
        ),
    )
    return (
        found.select("row", "id")
        .join(by_row, "row", "left")
        .select(F.col("id").alias(id_col), spans.alias("spans"))
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )
