"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by its nearest pivots in order. An inverted list for each pivot holds the
vectors that name it; two vectors of a list are candidates when they share enough pivots, and
candidates are verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight.llm.graph import Forest, components
from foresight.llm.units import in_units, units
from foresight.llm.vectors import matrix, of_main_length, unit_rows, usable
from foresight.llm.workspace import Workspace

COSINE = 0.95
#: Pivots that describe a vector, and how many of them candidates share.
PREFIX = 8
SHARED = 3
#: Pivots are about four times the root of the number of vectors, within these bounds.
PIVOTS = (64, 2048)
#: No pivot is as close as this to another: a group of near copies gets one pivot, not many.
PIVOT_COSINE = 0.8
UNIT_ROWS = 1024
_BLOCK = 256


def choose_pivots(classes: DataFrame, count: int) -> np.ndarray:
    """A bounded sample: the ``2 * count`` vectors of least hash, thinned to ``count`` spread ones."""
    sample = classes.orderBy(F.xxhash64("vector"), "class").limit(2 * count).select("vector").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    rows = unit_rows(matrix(sample.column("vector")))
    close = rows @ rows.T >= PIVOT_COSINE
    kept: list[int] = []
    for i in range(len(rows)):
        if len(kept) < count and not close[i, kept].any():
            kept.append(i)
    return rows[kept]


def _describe(pivots, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        width = min(prefix, len(points))
        for batch in batches:
            near = unit_rows(matrix(batch.column("vector"))) @ points.T
            top = np.argpartition(-near, width - 1, axis=1)[:, :width]
            order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
            ranked = np.take_along_axis(top, order, axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                np.arange(0, ranked.size + 1, width, dtype=np.int32), pa.array(ranked.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "pivots"])

    return run


def _shared(prefixes: np.ndarray) -> np.ndarray:
    """Bit rows over the pivots that at least two rows of the unit name."""
    names, where, counts = np.unique(prefixes, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    where = where.reshape(prefixes.shape)
    bits = np.zeros((len(prefixes), max(1, -(-int((counts > 1).sum()) // 64))), dtype=np.uint64)
    for column in where.T:
        rows = np.flatnonzero(counts[column] > 1)
        spot = place[column[rows]]
        bits[rows, spot // 64] |= np.uint64(1) << (spot % 64).astype(np.uint64)
    return bits


def _verify(cosine: float, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds in units(batches, "pivot"):
            out: list[list[np.ndarray]] = [[], [], []]
            for start, end in bounds.tolist():
                part = {c: x[start:end] for c, x in data.items()}
                size = end - start
                own, prefixes = part["pivot"][0], np.sort(part["pivots"], axis=1)
                vectors = unit_rows(part["vector"].astype(np.float64))
                bits, need = _shared(prefixes), min(shared, prefixes.shape[1])
                within = part["lo"][0] == part["hi"][0]
                forest, links = Forest(size), np.zeros(size, dtype=np.int64)
                for top in range(0, size, _BLOCK):
                    rows = slice(top, min(top + _BLOCK, size))
                    common = np.zeros((rows.stop - top, size), dtype=np.uint8)
                    for word in bits.T:
                        common += np.bitwise_count(word[rows, None] & word[None, :])
                    i, j = np.nonzero(common >= need)
                    i += top
                    keep = i < j if within else (part["side"][i] == 0) & (part["side"][j] == 1)
                    i, j = i[keep], j[keep]
                    near = (vectors[rows] @ vectors.T)[i - top, j] >= cosine
                    i, j = i[near], j[near]
                    # A pair may meet in several lists; the one of its least shared pivot counts it.
                    both = (prefixes[i][:, :, None] == prefixes[j][:, None, :]).any(axis=2)
                    first = prefixes[i, both.argmax(axis=1)] == own
                    i, j = i[first], j[first]
                    np.add.at(links, i, part["n"][j])
                    np.add.at(links, j, part["n"][i])
                    forest.link(i, j)
                hit = np.flatnonzero(links)
                out[0].append(part["class"][hit])
                out[1].append(links[hit])
                out[2].append(part["class"][forest.parent[hit]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in out], names=["class", "links", "root"]
            )

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    prefix: int = PREFIX,
    shared: int = SHARED,
    pivots: tuple[int, int] = PIVOTS,
    unit_size: int = UNIT_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Links join rows with a cosine of ``cosine`` or more that the index retrieves; none lies below.
    Null or zero vectors, and those with null or non-finite components or another length than most,
    link with nothing and are kept. Equal vectors link with each other and stand in the index as one
    class with its count; repeated rows count like any other copies. A component is named by its
    smallest id (null where no member has one) and ``kept`` is true for the row of that id; a row
    without an id is kept only if its component has none. An empty table gives an empty result, other
    columns are ignored.

    The work of a list is dealt in units of bounded size and comes back as one row a member: link
    counts and a root, never pairs. A vector is shipped once for each pivot of its prefix.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "pivots")
    rows = space.put(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "rows")
    good = of_main_length(rows.filter(usable(F.col("vector"))), "vector")
    classes = space.put(
        good.groupBy("vector")
        .agg(F.min("id").alias("least"), F.count("*").alias("n"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    total = classes.count()
    points = choose_pivots(classes, int(min(max(4 * math.sqrt(total), pivots[0]), pivots[1])))
    shipped = spark.sparkContext.broadcast(points)  # at most ``pivots[1]`` vectors
    members = classes.select("class", "n", "vector")
    described = space.put(
        members.mapInArrow(
            _describe(shipped, prefix), members.withColumn("pivots", F.array(F.lit(0))).schema
        ),
        "described",
    )
    lists = described.withColumn("pivot", F.explode("pivots"))
    dealt = in_units(lists, "pivot", "class", space, unit_size)
    found = space.put(
        dealt.mapInArrow(_verify(cosine, shared), "class bigint, links bigint, root bigint"), "found"
    )
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), space)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = (
        classes.join(links, "class", "left")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "vector",
            "least",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "class").alias("root"),
        )
    )
    names = space.put(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = space.put(grouped.join(names, "root").select("vector", "n_links", "component_id"), "named")
    placed = rows.join(named.withColumn("linked", F.lit(True)), "vector", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return placed.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
