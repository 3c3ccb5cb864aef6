"""Removal of byte strings that start anywhere else, by a distributed sample-and-name sort.

The plan is that of difference-cover suffix sorting, cut off at the length that matters. Positions
are sampled, so that equal strings are sampled at equal offsets. Sampled strings get names, equal
names are brought together, and where a name does not decide, the names of finer strings around the
sample do (the recursion). The remaining positions are placed by their offset to the sample and only
meet positions of the same name. The sample is chosen by content (a synchronising set, the data-driven
form of a difference cover): with fixed residues each position of the corpus would be a sorted record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight.llm.blocks import mix, samples
from foresight.llm.workspace import Workspace

#: Bytes of a string that may not repeat, bytes of a sampled string, window starts in a finer block.
LENGTH = 200
GRAM = 64
GRID = 16


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(sizes, pa.array(flat, kind))


def _anchors(length: int, gram: int):
    """One row a text: names, blocks and window ranges of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list, list] = ([], [], [], [])
            for raw in batch.column("text").to_pylist():
                found = [(at, s) for at, s in samples(raw, length, gram)]
                none = [np.zeros(0, np.int64)]
                columns[0].append(np.concatenate(none + [_long(s.name) for _, s in found]))
                columns[1].append(np.concatenate(none + [_long(s.block) for _, s in found]))
                columns[2].append(np.concatenate(none + [s.first + at for at, s in found]))
                columns[3].append(np.concatenate(none + [s.last + at for at, s in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(_lists(c, pa.int64()) for c in columns)],
                names=["key", "name", "block", "first", "last"],
            )

    return run


_FINE = pa.schema(
    [
        ("key", pa.int64()),
        ("edge", pa.bool_()),
        ("start", pa.int64()),
        ("n", pa.int32()),
        ("core", pa.int64()),
        ("whole", pa.int64()),
        ("windows", pa.list_(pa.int64())),
    ]
)


def _fine_blocks(length: int, gram: int, grid: int):
    """The wanted anchors' windows in blocks on a grid around the anchor.

    ``core`` names the bytes that all windows of a grid block share, ``whole`` all that they cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, raw, wanted in zip(
                *(batch.column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True
            ):
                edges = {w["first"]: w["edge"] for w in wanted}
                for at, s in samples(raw, length, gram):
                    hits = [i for i, f in enumerate((s.first + at).tolist()) if f in edges]
                    for number in hits:
                        out += _grid_rows(key, at, s, number, edges[int(s.first[number]) + at], length, grid)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, _FINE)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _FINE)

    return run


def _grid_rows(key, at, s, number, edge, length, grid) -> list[dict]:
    anchor, first, last = int(s.anchor[number]), int(s.first[number]), int(s.last[number])
    keys = _long(mix(s.windows(number) ^ s.name[number])).tolist()
    cells = np.arange((anchor - last) // grid, (anchor - first) // grid + 1)
    core = s.piece.hashes(anchor - cells * grid, anchor - cells * grid - (grid - 1) + length)
    starts = np.maximum(first, anchor - cells * grid - (grid - 1))
    ends = np.minimum(last, anchor - cells * grid)
    whole = s.piece.hashes(starts, ends + length)
    ranges = ((anchor - starts) * 1024 + (anchor - ends)).astype(np.uint64)
    named = s.name[number]
    core = _long(mix(core ^ mix(named + cells.astype(np.uint64))))
    whole = _long(mix(whole ^ mix(named ^ mix(ranges))))
    return [
        {
            "key": key, "edge": edge, "start": at + a, "n": b - a + 1, "core": c, "whole": w,
            "windows": keys[a - first : b - first + 1],
        }
        for a, b, c, w in zip(starts.tolist(), ends.tolist(), core.tolist(), whole.tolist(), strict=True)
    ]


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, kept = [], []
            for raw, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                merged = _merged(spans or [])
                edges = [0, *(x for span in merged for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in merged])
            sizes = [len(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, spans_type),
                    pa.array(kept, pa.binary()),
                ],
                names=[id_name, "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    grid: int = GRID,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``spans`` removed (start, end) and ``kept`` bytes.

    Removed is each UTF-8 byte that a string of ``length`` bytes covers which also starts anywhere
    else, in the same or another text; strings never cross texts and are judged on the input. Null
    and short texts keep all bytes. Repeated rows repeat each other's strings. An empty table gives
    an empty result and other columns are ignored. Strings are compared by hashes: equal at the
    sample's 64 bits and at another 64.

    The steps, each of which only passes on what the last one left open:

    1. Each text is cut into runs of window starts that one sampled string (anchor) serves.
    2. An anchor whose name is unique has no repeated window. One whose whole block occurs twice has
       only repeated ones. The rest has a name in common but lies at the edge of what is repeated.
    3. Edges are split on a grid around the anchor and decided in the same way: by all bytes of a
       grid block, or by those that its windows share.
    4. Single windows decide what is still open, again among those of the same name.

    Each different block is examined once, so copies cost one row; counts fold before their shuffle
    and joins are plain shuffles that AQE splits at common names. Texts are shuffled twice.
    """
    space = Workspace(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(F.col(id_col), text).alias("key")
    )
    lists = "key bigint, name array<bigint>, block array<bigint>, first array<bigint>, last array<bigint>"
    stored = space.put(rows.select("key", "text").mapInArrow(_anchors(length, gram), lists), "anchors")
    anchors = stored.select("key", F.inline(F.arrays_zip("name", "block", "first", "last")))
    shared = space.put(
        anchors.groupBy("name")
        .agg(F.count("*").alias("n"), F.min("block").alias("a"), F.max("block").alias("b"))
        .filter(F.col("n") > 1)
        .select("name", (F.col("a") != F.col("b")).alias("mixed")),
        "shared",
    )
    named = space.put(anchors.join(shared, "name"), "named")
    space.drop("anchors", "shared")
    mixed = named.filter("mixed")
    blocks = space.put(
        mixed.groupBy("name", "block").agg(
            F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("one")
        ),
        "blocks",
    )
    covered = [
        named.filter(~F.col("mixed")).select("key", "first", "last"),
        mixed.join(blocks.filter("n > 1").select("name", "block"), ["name", "block"]).select("key", "first", "last"),
    ]
    wanted = space.put(
        blocks.select("one.key", F.struct("one.first", (F.col("n") == 1).alias("edge")).alias("w"))
        .groupBy("key")
        .agg(F.collect_list("w").alias("wanted")),
        "wanted",
    )
    fine_schema = (
        "key bigint, edge boolean, start bigint, n int, core bigint, whole bigint, windows array<bigint>"
    )
    fine = space.put(
        rows.select("key", "text").join(wanted, "key").mapInArrow(_fine_blocks(length, gram, grid), fine_schema),
        "fine",
    )
    space.drop("wanted")

    def twice(frame: DataFrame, column: str, name: str) -> DataFrame:
        return space.put(
            frame.groupBy(column).agg(F.count("*").alias("_n")).filter("_n > 1").select(column), name
        )

    same_whole = twice(fine, "whole", "wholes")
    covered.append(
        fine.filter("edge")
        .join(same_whole, "whole")
        .select("key", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    )
    near = space.put(fine.join(twice(fine, "core", "cores"), "core").drop("core"), "near")
    single = near.select(F.explode("windows").alias("window"))
    same_window = twice(single, "window", "same")
    open_ = near.filter("edge").join(same_whole, "whole", "left_anti")
    covered.append(
        open_.select("key", "start", F.posexplode("windows").alias("place", "window"))
        .join(same_window, "window")
        .select("key", (F.col("start") + F.col("place")).alias("first"), (F.col("start") + F.col("place")).alias("last"))
    )
    everything = covered[0]
    for part in covered[1:]:
        everything = everything.union(part)
    span = F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    spans = space.put(
        everything.select("key", span.alias("s")).groupBy("key").agg(F.collect_set("s").alias("spans")), "spans"
    )
    space.drop("named", "blocks", "fine", "wholes", "cores", "near", "same")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.join(spans, "key", "left").mapInArrow(
        _cut(id_col),
        f"`{id_col}` {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary",
    )
