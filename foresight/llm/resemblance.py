"""Near-duplicates by SimHash fingerprints, each link verified on whole shingle sets, and MinHash for the rest.

Operator 1 (``simhash``) groups texts by their fingerprints, and each text is held against the least row
of its group. Its radius misses about half of the near copies, so texts left apart meet once more in
bands of MinHash minima: a pair at ``SIMILARITY`` shares none of the ``BANDS`` bands with a chance of
5e-6, and one above it with less. A text is the set of its shingles' hashes; whether two texts are alike is
always decided on their whole sets.

In the bands a row is first tried against the least rows of the buckets that it shares most with. Rows of
a bucket that this leaves in different groups meet with their sets in units of bounded size, where every pair
across groups is looked at and only the links that join groups come out: fewer than rows, so that no table of
pairs grows with the square of a large group, whether its texts are alike or just below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresight.llm.arrow import slices
from foresight.llm.graph import Forest, components
from foresight.llm.guarded import guarded
from foresight.llm.simhash import keep_first, near_duplicates, shingle_hashes
from foresight.llm.units import UNIT_ROWS, dealt, together, units
from foresight.llm.workspace import Workspace

SHINGLE = 5
SIMILARITY = 0.8
#: Buckets a text goes to, and minima that a bucket's rows agree on.
BANDS, MINIMA = 40, 6
#: Shingle hashes of a unit of rows with their sets: 32 MB.
UNIT_HASHES = 1 << 22
#: Least rows that a row is tried against before the pairs across groups.
FIRST_TRIES = 3
_BLOCK = 1 << 12
_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """One number a band from the minima of the permuted hashes."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _BLOCK):
        mixed = found[at : at + _BLOCK, None] * _FACTORS + _SHIFTS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    rows = least.reshape(BANDS, MINIMA)
    return np.array(
        [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64
    ).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingles(t, shingle) for t in batch.column("text").to_pylist()]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        marks = [bands(s) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("_row"),
                pa.array(digests, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(marks, pa.list_(pa.int64())),
            ],
            names=["id", "_row", "digest", "size", "bands"],
        )


def _spanning(rows: np.ndarray, roots: np.ndarray, side: np.ndarray, within: bool, sets: list, similarity: float) -> list:
    """Alike pairs of a unit's rows that connect what its alike pairs connect: one less than its groups at most."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int64)
    forest = Forest(len(rows))
    _, first, group = np.unique(roots, return_index=True, return_inverse=True)
    forest.parent = first[group]
    found = []
    for k in range(len(rows)):
        apart = forest.parent != forest.parent[k]
        apart &= np.minimum(sizes, sizes[k]) >= similarity * np.maximum(sizes, sizes[k])
        if within:
            apart[: k + 1] = False
        elif side[k] == 0:
            apart &= side == 1
        else:
            continue
        others = np.flatnonzero(apart)
        if not len(others):
            continue
        own = ids[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        ends = np.cumsum(sizes[others])
        begins = ends - sizes[others]
        at = np.arange(ends[-1]) + np.repeat(starts[others] - begins, sizes[others])
        common = np.add.reduceat(mark[ids[at]], begins)
        mark[own] = 0
        others = others[common >= similarity * (sizes[others] + sizes[k] - common)]
        if len(others):
            one = others[np.unique(forest.parent[others], return_index=True)[1]]
            found += [(min(rows[k], rows[i]), max(rows[k], rows[i])) for i in one.tolist()]
            forest.link(np.full(len(one), k), one)
    return found


def _across(similarity: float):
    """Links between a unit's groups, each verified on whole sets: fewer than the unit has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds in units(batches, "least"):
            for start, end in bounds.tolist():
                found = _spanning(
                    data["row"][start:end],
                    data["root"][start:end],
                    data["side"][start:end],
                    data["lo"][start] == data["hi"][start],
                    [np.frombuffer(s, np.uint64) for s in data["set"][start:end]],
                    similarity,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair[i] for pair in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
                )

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(row, set) of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], names=["row", "set"])

    wanted = texts.join(rows, "row", "left_semi").select("row", "text")
    return wanted.mapInArrow(run, "row bigint, set binary")


def _verified(
    pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, space: Workspace, name: str
) -> DataFrame:
    """The pairs (a, b: rows) whose whole shingle sets are alike."""
    pairs = space.put(pairs, f"{name}-pairs")
    rows = space.put(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), f"{name}-rows")
    sets = space.put(_sets(rows, texts, shingle), f"{name}-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    alike = space.put(both.mapInArrow(_alike(similarity), "a bigint, b bigint"), f"{name}-alike")
    space.drop(f"{name}-pairs", f"{name}-rows", f"{name}-sets")
    return alike


def _sizes_allow(one: str, other: str, similarity: float) -> Column:
    """Sets of such sizes can have the similarity."""
    return F.least(one, other) >= F.lit(similarity) * F.greatest(one, other)


def _linked_by_fingerprint(
    sizes: DataFrame, texts: DataFrame, shingle: int, similarity: float, unit_rows: int, space: Workspace
) -> DataFrame:
    """Verified links (a: least of its fingerprint group among the rows of ``sizes``, b: row), one a row at most."""
    groups = near_duplicates(texts, "row", "text", unit_rows=unit_rows).select("row", "component_id")
    placed = sizes.join(groups, "row")
    first = placed.groupBy("component_id").agg(F.min(F.struct("row", "size")).alias("first"))
    pairs = placed.join(first, "component_id").filter(
        (F.col("row") > F.col("first.row")) & _sizes_allow("size", "first.size", similarity)
    )
    pairs = pairs.select(F.col("first.row").alias("a"), F.col("row").alias("b"))
    return _verified(pairs, texts, shingle, similarity, space, "fingerprint")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """The input with one row left of each group of near duplicates: that of the smallest id.

    Texts whose shingle sets have the Jaccard similarity or more are linked, and groups are what
    links connect. Words and case are those of ``simhash.fingerprint``; a text of fewer words than
    a shingle is one shingle, and all texts without words are alike. Rows without id come last, of
    several rows with the smallest id one stays, and all columns pass through, whatever their names.
    Null texts count as texts without words; an empty table stays empty.
    """
    return guarded(docs, [id_col, text_col], lambda d: _first_rows(d, id_col, text_col, shingle, similarity, unit_rows))


def _first_rows(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, unit_rows: int
) -> DataFrame:
    space = Workspace(docs.sparkSession, "resemblance")
    stored = space.put(docs.withColumn("_row", F.monotonically_increasing_id()), "stored")
    picked = stored.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), "_row")
    added = {"digest": "binary", "size": "bigint", "bands": "array<bigint>"}
    schema = picked.select("id", "_row", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema
    marked = space.put(picked.mapInArrow(lambda batches: _signed(batches, shingle), schema), "marked")
    # Equal sets are one row from here on; its number is that of one of them.
    single = marked.groupBy("digest").agg(F.min("_row").alias("row"))
    single = space.put(single, "single")
    lone = marked.join(single.select(F.col("row").alias("_row")), "_row", "left_semi")
    texts = picked.select(F.col("_row").alias("row"), "text")
    links = _linked_by_fingerprint(
        lone.select(F.col("_row").alias("row"), "size"), texts, shingle, similarity, unit_rows, space
    )
    marks = lone.select(F.col("_row").alias("row"), "size", F.explode("bands").alias("bucket"))
    several = marks.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared = space.put(
        marks.join(several, "bucket", "left_semi")
        .join(links.select(F.col("a").alias("root"), F.col("b").alias("row")), "row", "left")
        .select("bucket", "row", "size", F.coalesce("root", "row").alias("root")),
        "shared",
    )
    # A row is first held against the few least rows that it shares most buckets with: nearly always its
    # group's. All other pairs of a bucket are looked at below, unless they are linked by then.
    buckets = (
        shared.groupBy("bucket")
        .agg(F.min(F.struct("row", "size", "root")).alias("least"), F.min("root").alias("p"), F.max("root").alias("q"))
        .filter("p < q")
        .select("bucket", *[F.col(f"least.{c}").alias(f"least_{c}") for c in ("row", "size", "root")])
    )
    buckets = space.put(buckets, "buckets")
    met = (
        shared.join(buckets, "bucket")
        .filter((F.col("root") != F.col("least_root")) & _sizes_allow("size", "least_size", similarity))
        .groupBy("row", F.col("least_row").alias("least"))
        .agg(F.count("*").alias("times"))
    )
    nearest = Window.partitionBy("row").orderBy(F.desc("times"), "least")
    tried = (
        met.withColumn("place", F.row_number().over(nearest))
        .filter(F.col("place") <= FIRST_TRIES)
        .select(F.col("least").alias("a"), F.col("row").alias("b"))
    )
    tried = space.put(tried, "tried")
    edges = links.union(_verified(tried, texts, shingle, similarity, space, "first"))
    roots = space.put(components(edges, space, "first"), "first-roots")
    grouped = space.put(
        shared.drop("root").join(roots, shared["row"] == roots["node"], "left").select(
            "bucket", "row", "size", F.coalesce("root", "row").alias("root")
        ),
        "grouped",
    )
    # Buckets of one least row are one group of candidates, so that a row's set travels once and not by bucket.
    several = (
        grouped.groupBy("bucket")
        .agg(F.min("root").alias("p"), F.max("root").alias("q"), F.min("row").alias("least"))
        .filter("p < q")
        .select("bucket", "least")
    )
    mixed = space.put(grouped.join(several, "bucket").select("least", "row", "size", "root").distinct(), "mixed")
    sets = space.put(_sets(mixed.select("row").distinct(), texts, shingle), "mixed-sets")
    rest = dealt(mixed, "least", "row", space, unit_rows, "size", UNIT_HASHES).join(sets, "row")
    rest = together(rest, "least", "row").select("least", "row", "root", "lo", "hi", "side", "set")
    more = space.put(rest.mapInArrow(_across(similarity), "a bigint, b bigint"), "second-alike")
    roots = space.put(components(edges.union(more), space, "second"), "roots")
    named = single.join(roots, single["row"] == roots["node"], "left").select(
        "digest", F.coalesce("root", "row").alias("root")
    )
    placed = space.put(marked.select("id", "_row", "digest").join(named, "digest").select("root", "id", "_row"), "placed")
    space.drop(
        "marked", "single", "shared", "buckets", "tried", "grouped", "mixed", "mixed-sets", "large-least",
        "fingerprint-alike", "first-alike", "second-alike", "first-roots", "roots",
    )
    return keep_first(stored, placed, space)
