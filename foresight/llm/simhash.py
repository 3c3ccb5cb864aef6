"""SimHash near-duplicates: fingerprints, BK-tree links within a radius, connected groups.

A fingerprint's 64 bits are cut into ``radius + 2`` pieces. Two fingerprints within the radius
agree on at least two pieces, so each pair of pieces is a shard key and every link lies in some
shard. A shard's distinct fingerprints become a BK-tree of bounded size; the trees travel with
their shards to the tasks that probe them, since broadcasting all of them would grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight.llm.arrow import slices
from foresight.llm.bktree import BKTree
from foresight.llm.graph import Forest, components
from foresight.llm.guarded import guarded
from foresight.llm.units import UNIT_ROWS, in_units, units
from foresight.llm.workspace import Workspace

SHINGLE = 4
RADIUS = 4
BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 14


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``shingle`` words, in blocks; of all words if there are fewer."""
    words = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    if not words:
        return
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        yield np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)),
            dtype="<u8",
        )


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set where over half of the shingle hashes (XXH64, seed 42) have it; 0 without words."""
    total, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    over = total * 2 > n
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Replace the text column by ``fingerprint`` (its 64 bits as a signed long)."""
    rest = [c for c in docs.columns if c not in (text_col, "fingerprint")]
    kept = docs.select(*[F.col(f"`{c}`") for c in [*rest, text_col]])
    schema = docs.select(*rest, F.lit(0).cast("bigint").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            marks = np.array(
                [fingerprint(t, shingle) for t in batch.column(text_col).to_pylist()], dtype=np.uint64
            ).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(marks)], names=[*rest, "fingerprint"]
            )

    return kept.mapInArrow(run, schema)


def _pieces(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the pieces that a fingerprint is cut into."""
    edges = [round(k * BITS / (radius + 2)) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds in units(batches, "shard"):
            a, b = [], []
            for start, end in bounds.tolist():
                marks = data["fingerprint"][start:end]
                points = marks.view(np.uint64)
                side = data["side"][start:end]
                forest = Forest(end - start)
                if data["lo"][start] == data["hi"][start]:
                    tree, offset, probes = points, 0, np.arange(len(points))
                else:
                    tree, offset, probes = points[side == 0], 0, np.flatnonzero(side == 1)
                if len(tree) and len(probes):
                    for query, node in BKTree(tree).search(points[probes], radius):
                        forest.link(probes[query], node + offset)
                tied = np.flatnonzero(forest.parent != np.arange(len(marks)))
                a.append(marks[tied])
                b.append(marks[forest.parent[tied]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
            )

    return run


def link_fingerprints(
    distinct: DataFrame, space: Workspace, radius: int = RADIUS, unit_rows: int = UNIT_ROWS
) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: enough to connect all that lie within ``radius``.

    A unit hands back at most one edge a row, however many pairs it links.
    """
    cut = _pieces(radius)
    keys = []
    for number, pair in enumerate(combinations(cut, 2)):
        key = F.lit(number).cast("bigint")
        for shift, width in pair:
            piece = F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(piece)
        keys.append(key)
    sharded = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("shard"))
    dealt = in_units(sharded, "shard", "fingerprint", space, unit_rows)
    return dealt.mapInArrow(_links(radius), "a bigint, b bigint")


def _grouped(marked: DataFrame, space: Workspace, radius: int, unit_rows: int) -> DataFrame:
    """(fingerprint, root, component_id) from rows with id and fingerprint."""
    distinct = space.put(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    edges = link_fingerprints(distinct.select("fingerprint"), space, radius, unit_rows)
    roots = components(edges, space)
    placed = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = space.put(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return space.put(placed.join(least, "root").select("fingerprint", "root", "component_id"), "named")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (long) and ``component_id``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; a component is named
    by its smallest id. Null and empty texts, and texts without words, have fingerprint 0 and link
    like any other. Rows without an id get the component of their fingerprint, which is null only
    where no member has an id. Repeated rows come out repeated, an empty table gives an empty
    result, and other columns are ignored.

    Equal fingerprints collapse before any pair is looked at, so groups of copies cost one row.
    """
    space = Workspace(docs.sparkSession, "simhash")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = space.put(fingerprints(picked, "text", shingle), "marked")
    named = _grouped(marked, space, radius, unit_rows)
    return marked.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """The input with one row left of each component: that of the smallest id, rows without id last.

    Of several rows with that id one stays. All columns pass through, whatever their names; texts are
    shuffled once at most. Null texts have no words and are alike; an empty table stays empty.
    """
    return guarded(docs, [id_col, text_col], lambda d: _first_rows(d, id_col, text_col, shingle, radius, unit_rows))


def _first_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, unit_rows: int) -> DataFrame:
    space = Workspace(docs.sparkSession, "simhash")
    stored = space.put(docs.withColumn("_row", F.monotonically_increasing_id()), "stored")
    picked = stored.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), "_row")
    marked = space.put(fingerprints(picked, "text", shingle), "marked")
    named = _grouped(marked, space, radius, unit_rows)
    placed = space.put(marked.join(named, "fingerprint").select("root", "id", "_row"), "placed")
    space.drop("marked", "distinct", "least", "named")
    return keep_first(stored, placed, space)


def keep_first(stored: DataFrame, placed: DataFrame, space: Workspace) -> DataFrame:
    """``stored`` (with ``_row``) without the rows that are not the first of their root in ``placed``."""
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row"))
    first = space.put(placed.groupBy("root").agg(best.alias("first")).select("root", "first._row"), "first")
    gone = placed.select("_row").join(first.select("_row"), "_row", "left_anti")
    removed = space.put(gone, "removed")  # mostly far fewer than are kept: Spark broadcasts what it knows to be small
    space.drop("placed", "first")
    return stored.join(removed, "_row", "left_anti").drop("_row")
