"""Exact top-k inner products: candidates by falling length, bounded by rotated partial sums."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresight.llm.workspace import Workspace
from foresight.operators.ranking import with_row_number

#: Candidates of a block (one task holds one block) and queries that meet it together.
BLOCK_ROWS, QUERY_ROWS = 4096, 8192
#: The longest vectors, which every query meets first for its opening threshold: a bounded broadcast.
SEED_ROWS = 1024
#: Entries of the directory of lengths that tells a query where to stop: a bounded broadcast.
DIRECTORY = 4096
#: Leading components that are rotated; further ones stay as they are behind them.
ROTATED = 512
#: Shares of the components after which a partial sum is compared with the threshold.
HEADS = (0.125, 0.375)
#: Pairs, and candidates by queries, that are looked at together; few candidates as long as there is no threshold.
PAIRS, FIRST_CHUNK, CHUNK, BATCH = 1 << 14, 32, 512, 1024
#: Share of surviving pairs from which a whole matrix product is cheaper than the pairs one by one.
DENSE = 0.05
#: What rounding may add to a bound, as a share of the product of lengths.
SLACK = 1e-10
LIMIT = (1 << 63) - 1
#: Components are whole multiples of 2**-BITS and kept as such fractions, so that none overflows.
BITS = 8


def _padded(array: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix in double precision, short ones filled up with zeros."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lengths(z: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, so that huge components do not overflow early."""
    top = np.abs(z).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top, 1.0)
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(np.square(z / scale[:, None]).sum(axis=1)) * top


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without null or non-finite components, these down to multiples of 2**-BITS, and the rows' lengths."""
    for batch in batches:
        vectors = batch.column("x")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        bad |= ~np.isfinite(values)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.bincount(owner[bad], minlength=len(sizes)) == 0
        values = values[keep[owner]]
        # From 2^52 on every double is whole already.
        large = np.abs(values) >= 2.0**52
        whole = np.where(large, values, np.floor(np.where(large, 0.0, values) * 2.0**BITS) / 2.0**BITS)
        offsets = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
        z = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))
        kept = batch.filter(pa.array(keep))
        lengths = _lengths(_padded(z, int(sizes[keep].max(initial=0))))
        yield pa.RecordBatch.from_arrays(
            [kept.column("id"), kept.column("asks"), z, pa.array(lengths)], names=["id", "asks", "z", "length"]
        )


@dataclass
class Rows:
    """Vectors of multiples of 2**-BITS with their rotated form and the lengths of what follows each head."""

    place: np.ndarray
    id: np.ndarray
    missing: np.ndarray
    z: np.ndarray
    rotated: np.ndarray
    length: np.ndarray
    rest: list[np.ndarray]

    @classmethod
    def load(cls, table: pa.Table | pa.RecordBatch, rotation: np.ndarray, width: int) -> Rows:
        z = _padded(table.column("z"), width)
        n = len(rotation)
        with np.errstate(invalid="ignore", over="ignore"):
            rotated = np.concatenate((z[:, :n] @ rotation, z[:, n:]), axis=1)
        ids = table.column("id")
        return cls(
            table.column("place").to_numpy(),
            ids.fill_null(0).to_numpy(),
            ids.is_null().to_numpy(zero_copy_only=False),
            z,
            rotated,
            _lengths(z),
            [_lengths(rotated[:, h:]) for h in heads(width)],
        )


def heads(width: int) -> list[int]:
    return sorted({max(1, math.ceil(width * share)) for share in HEADS}) if width else [0]


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products of the whole numbers, without rounding; kept within a long."""
    if _fits(q, c):
        return (np.einsum("ij,ij->i", q, c) * 4.0**BITS).astype(np.int64)
    sums = [sum(_whole(x) * _whole(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q, c, strict=True)]
    return np.array([max(-LIMIT, min(LIMIT, s)) for s in sums], dtype=np.int64)


def _fits(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether a double holds every sum of products exactly, in whatever order it is taken."""
    with np.errstate(over="ignore"):
        return bool(np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1] < 2.0 ** (53 - 2 * BITS))


def _scored(q: Rows, c: Rows, asked: np.ndarray, part: slice, rows, columns, threshold: np.ndarray):
    """The pairs with their exact products; where doubles hold them, without those below the threshold."""
    fits = _fits(q.z[asked], c.z[part])
    if fits and len(rows) > DENSE * len(asked) * (part.stop - part.start):
        whole = q.z[asked] @ c.z[part].T
        scores = (whole[np.searchsorted(asked, rows), columns - part.start] * 4.0**BITS).astype(np.int64)
    else:
        pieces = [exact(q.z[rows[i : i + PAIRS]], c.z[columns[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS)]
        scores = np.concatenate(pieces) if pieces else np.array([], dtype=np.int64)
    if fits:
        reached = scores >= threshold[rows] * 4.0**BITS
        rows, columns, scores = rows[reached], columns[reached], scores[reached]
    return rows, columns, scores


def _whole(x: float) -> int:
    return int(x) << BITS if abs(x) >= 2.0**52 else int(x * 2.0**BITS)


def _survivors(q: Rows, c: Rows, asked: np.ndarray, part: slice, threshold: np.ndarray):
    """Pairs whose partial sum plus the Cauchy-Schwarz bound of the rest can reach the threshold."""
    marks = heads(q.z.shape[1])
    with np.errstate(invalid="ignore", over="ignore"):
        head = q.rotated[asked, : marks[0]] @ c.rotated[part, : marks[0]].T
        room = q.rest[0][asked, None] * c.rest[0][None, part]
        room += SLACK * q.length[asked, None] * c.length[None, part]
        rows, columns = np.nonzero(~(head + room < threshold[asked, None]))
        sums = head[rows, columns]
        rows, columns = asked[rows], columns + part.start
        for k in range(1, len(marks)):
            keep = np.empty(len(rows), dtype=bool)
            if len(rows) > DENSE * head.size:
                span = slice(marks[k - 1], marks[k])
                more = q.rotated[asked, span] @ c.rotated[part, span].T
                sums += more[np.searchsorted(asked, rows), columns - part.start]
                bound = sums + q.rest[k][rows] * c.rest[k][columns] + SLACK * q.length[rows] * c.length[columns]
                keep = ~(bound < threshold[rows])
                rows, columns, sums = rows[keep], columns[keep], sums[keep]
                continue
            for at in range(0, len(rows), PAIRS):
                i, j, here = rows[at : at + PAIRS], columns[at : at + PAIRS], slice(at, at + PAIRS)
                span = slice(marks[k - 1], marks[k])
                sums[here] += np.einsum("ij,ij->i", q.rotated[i, span], c.rotated[j, span])
                bound = sums[here] + q.rest[k][i] * c.rest[k][j] + SLACK * q.length[i] * c.length[j]
                keep[here] = ~(bound < threshold[i])
            rows, columns, sums = rows[keep], columns[keep], sums[keep]
    return rows, columns


def best(q: Rows, c: Rows, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the ``k`` best of ``c`` (longest first) for each of ``q``.

    ``threshold`` is a product (of the fractions) that ``k`` candidates are known to reach, or minus
    infinity; it rises on the way. What stays strictly below it is left out.
    """
    threshold = threshold.copy()
    found = tuple(np.array([], dtype=np.int64) for _ in range(3))
    stop, size = 0, FIRST_CHUNK
    while stop < len(c.z):
        start, stop, size = stop, min(stop + size, len(c.z)), min(2 * size, CHUNK)
        part = slice(start, stop)
        with np.errstate(invalid="ignore", over="ignore"):
            asked = np.flatnonzero(~(q.length * c.length[start] * (1 + SLACK) < threshold))
        if not len(asked):
            break
        for at in range(0, len(asked), BATCH):
            rows, columns = _survivors(q, c, asked[at : at + BATCH], part, threshold)
            other = q.place[rows] != c.place[columns]
            rows, columns = rows[other], columns[other]
            new = _scored(q, c, asked[at : at + BATCH], part, rows, columns, threshold)
            found = _first(tuple(map(np.concatenate, zip(found, new, strict=True))), c, k)
            last = np.flatnonzero(np.diff(found[0], append=-1))
            full = last[(last >= k - 1) & (found[0][np.maximum(last - k + 1, 0)] == found[0][last])]
            np.maximum.at(threshold, found[0][full], found[2][full] / 4.0**BITS)
    return found


def _first(found: tuple, c: Rows, k: int) -> tuple:
    """The ``k`` best of each query: higher scores, smaller ids, missing ids last."""
    rows, columns, scores = found
    order = np.lexsort((c.place[columns], c.id[columns], c.missing[columns], -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    inside = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
    return rows[inside < k], columns[inside < k], scores[inside < k]


FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint, place bigint"
_FOUND = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score", "place")])


def _meet(rotation: np.ndarray, width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        c = Rows.load(left.combine_chunks().sort_by("place"), rotation, width)
        q = Rows.load(right.combine_chunks(), rotation, width)
        threshold = right.column("threshold").to_numpy()
        rows, columns, scores = best(q, c, threshold, k)
        columns_out = (
            pa.array(q.place[rows]),
            pa.array(q.id[rows]),
            pa.array(c.id[columns], mask=c.missing[columns]),
            pa.array(scores),
            pa.array(c.place[columns]),
        )
        return pa.table(list(columns_out), schema=_FOUND)

    return run


def _opening(seed: Rows, directory: np.ndarray, step: int, rotation: np.ndarray, width: int, k: int):
    """Adds each query's first threshold and the last block that it has to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                q = Rows.load(part, rotation, width)
                threshold = np.full(part.num_rows, -np.inf)
                rows, _, scores = best(q, seed, threshold, k)
                for row in np.flatnonzero(np.bincount(rows, minlength=part.num_rows) == k):
                    threshold[row] = scores[rows == row].min() / 4.0**BITS
                with np.errstate(invalid="ignore", over="ignore"):
                    reached = ~(q.length[:, None] * directory[None, :] * (1 + SLACK) < threshold[:, None])
                until = np.maximum(reached.sum(axis=1), 1) * step - 1
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(threshold), pa.array(until.astype(np.int64))],
                    names=[*part.schema.names, "threshold", "until"],
                )

    return run


def _moments(width: int):
    """Upper triangle of the sum of outer products of a task's unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            sizes = batch.column("z").value_lengths().to_numpy(zero_copy_only=False)
            z = _padded(batch.column("z"), max(width, int(sizes.max(initial=0))))[:, :width]
            top = _lengths(z)
            unit = z[(top > 0) & np.isfinite(top)] / top[(top > 0) & np.isfinite(top), None]
            total += unit.T @ unit
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def rotation_of(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows' directions, strongest first; sums meet in Spark."""
    sums = rows.select("z").mapInArrow(_moments(width), "i bigint, j bigint, v double")
    gram = np.zeros((width, width))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # at most ROTATED ** 2 / 2 cells
        gram[r.i, r.j] = gram[r.j, r.i] = r.v
    return np.linalg.eigh(gram)[1][:, ::-1] if width else gram


def top_products(
    rows: DataFrame,
    asks: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score: the ``k`` largest inner products of each query.

    Components become ``floor(2 ** BITS * x)``; products are exact and kept within a long. Queries are the
    rows where ``asks`` (over the columns of ``rows``) holds, each against every row but itself; ties go
    to smaller ids, missing ids last. Vectors that are null or hold null or non-finite components take
    no part; zero and empty ones do, and a shorter vector counts as filled up with zeros. Repeated rows
    are rows of their own, a repeated query is answered once for each of its rows. No usable row, no
    result; other columns are ignored, whatever their names.

    Rows are numbered by falling length and cut into blocks. Queries meet the longest rows first, which
    gives a threshold, and then only the blocks whose lengths can still reach it, in units of
    ``block_rows`` by ``query_rows``. Inside a unit, partial sums of SVD-rotated vectors plus the
    Cauchy-Schwarz bound of the rest decide which pairs are multiplied out.
    """
    space = Workspace(rows.sparkSession, "products")
    given = rows.filter(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.col(vector_col).cast("array<double>").alias("x"),
    )
    usable = space.put(given.mapInArrow(_usable, "id bigint, asks boolean, z array<double>, length double"), "usable")
    placed = with_row_number(usable, [F.desc("length"), F.asc("id"), F.col("z")], "place")
    sorted_rows = space.put(placed.withColumn("block", F.floor((F.col("place") - 1) / block_rows)), "rows")
    count, width, asked = sorted_rows.agg(F.count("*"), F.max(F.size("z")), F.count_if("asks")).first()
    if not asked:
        return _ranked(sorted_rows.sparkSession.createDataFrame([], FOUND), k, id_col)
    rotation = rotation_of(sorted_rows, min(width, ROTATED))
    first = sorted_rows.filter(F.col("place") <= SEED_ROWS).select("place", "id", "z")
    seed = Rows.load(first.toArrow().combine_chunks().sort_by("place"), rotation, width)
    blocks = math.ceil(count / block_rows)
    step = math.ceil(blocks / DIRECTORY)
    edges = sorted_rows.filter((F.col("place") - 1) % (block_rows * step) == 0).select("place", "length")
    directory = np.array([r.length for r in sorted(edges.collect(), key=lambda r: r.place)])
    queries = sorted_rows.filter("asks").select("place", "id", "z")
    opened = queries.mapInArrow(
        _opening(seed, directory, step, rotation, width, k),
        "place bigint, id bigint, z array<double>, threshold double, until bigint",
    )
    slices = math.ceil(asked / query_rows)
    # Keys of one type on both sides: an int and a bigint hash differently, and their groups would never meet.
    right = opened.withColumn("slice", F.pmod(F.xxhash64("place"), F.lit(slices)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("until", F.lit(blocks - 1).cast("bigint"))))
    )
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    left = sorted_rows.select("place", "id", "z", F.col("block").cast("bigint"), every_slice.alias("slice"))
    found = (
        left.groupBy("block", "slice")
        .cogroup(right.groupBy("block", "slice"))
        .applyInArrow(_meet(rotation, width, k), FOUND)
    )
    return _ranked(found, k, id_col)


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """At most ``k`` rows of a query and block come in."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(id_col), "score")
    )
