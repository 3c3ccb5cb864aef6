"""Merkle manifest of a dataset: leaf places by bitmap ranks, levels by slot arrays, proofs from the top down."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight.llm.running import running_totals
from foresight.llm.workspace import Workspace
from foresight.operators.ranking import with_row_number

#: Ids of one word of a bitmap, and words of one container, as powers of two.
WORD_BITS, CONTAINER_BITS = 6, 10
#: Levels that one slot array reduces: it holds ``2 ** SLOT_BITS`` nodes.
SLOT_BITS = 8
#: What a proof says of a level: the sibling is on the left or right, or there is none.
LEFT, RIGHT, NONE = "L", "R", "N"

NODES = "group bigint, rank bigint, digest string, levels int, id bigint, altered string"
BLOCKS = (
    "group bigint, block bigint, digest string, levels int, spanned int, "
    "ids array<bigint>, digests array<string>, altered array<string>"
)
_BLOCKS = pa.schema(
    [
        ("group", pa.int64()), ("block", pa.int64()), ("digest", pa.string()), ("levels", pa.int32()),
        ("spanned", pa.int32()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("altered", pa.list_(pa.string())),
    ]
)


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def leaf_ranks(leaves: DataFrame, space: Workspace) -> tuple[DataFrame, int]:
    """``leaves`` (key, id, digest, ...) with group (place of its key, from 0), rank in it and levels.

    Ids become bits of 64-bit words, words are gathered in containers of 1,024, and the containers'
    population counts are summed along the keys: a row's rank is its word's offset plus the bits below
    its own. Only words that hold an id twice, and missing ids (first in their key), are numbered by
    order, equal ids by digest. Also returns the number of keys.
    """
    word = F.shiftright("id", WORD_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int"))
    words = leaves.groupBy("key", word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    containers = words.groupBy("key", F.shiftright("word", CONTAINER_BITS).alias("container")).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits", "n"))).alias("words"), F.sum("n").alias("n")
    )  # at most 1,024 words each
    order = [F.asc_nulls_first("key"), F.asc_nulls_first("container")]
    placed = space.put(running_totals(containers, order, {"before": F.col("n")}), "containers")
    keys = with_row_number(
        placed.groupBy("key").agg(F.sum("n").alias("size"), F.min("before").alias("start")), [F.asc_nulls_first("key")], "place"
    )
    keys = space.put(keys, "keys")
    sizes = F.transform("words", lambda w: w["n"])
    offsets = F.transform(
        "words",
        lambda w, i: F.struct(
            w["word"].alias("word"),
            w["bits"].alias("bits"),
            w["n"].alias("n"),
            F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("inner"),
        ),
    )
    directory = placed.join(keys, placed["key"].eqNullSafe(keys["key"])).select(
        placed["key"].alias("word_key"),
        (F.col("place") - 1).alias("group"),
        "size",
        (F.col("before") - F.col("start")).alias("base"),
        F.explode(offsets).alias("w"),
    )
    levels = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    directory = space.put(
        directory.select(
            "word_key", "group", levels.cast("int").alias("levels"), (F.col("base") + F.col("w.inner")).alias("base"),
            F.col("w.word").alias("word"), F.col("w.bits").alias("bits"),
            (F.col("w.bits").isNull() | (F.bit_count("w.bits") < F.col("w.n"))).alias("crowded"),
        ),
        "directory",
    )
    rows = leaves.withColumn("_word", word)
    met = rows.join(
        directory, rows["key"].eqNullSafe(directory["word_key"]) & rows["_word"].eqNullSafe(directory["word"])
    )
    below = F.bitwise_not(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int"))
    )
    given = [*leaves.columns, "group", "levels"]
    single = met.filter(~F.col("crowded")).select(
        *given, (F.col("base") + F.bit_count(F.col("bits").bitwiseAND(below))).alias("rank")
    )
    by_order = [F.col("group"), F.asc_nulls_first("word"), F.asc_nulls_first("id"), F.col("digest")]
    numbered = with_row_number(met.filter("crowded").select(*given, "word", "base"), by_order, "row")
    firsts = numbered.groupBy("group", "word").agg(F.min("row").alias("first"))
    one, many = firsts.alias("f"), numbered.alias("m")
    crowded = many.join(
        one, (F.col("m.group") == F.col("f.group")) & F.col("m.word").eqNullSafe(F.col("f.word"))
    ).select(*[F.col(f"m.{c}") for c in given], (F.col("base") + F.col("row") - F.col("first")).alias("rank"))
    return single.unionByName(crowded), keys.count()


def _reduce(table: pa.Table) -> pa.Table:
    """The slots of one array, reduced by as many levels as it spans."""
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("rank", "digest", "id", "altered")], strict=True), key=lambda r: r[0])
    levels = table.column("levels")[0].as_py()
    own = min(levels, SLOT_BITS)
    nodes = [r[1] for r in rows]
    top = tree(nodes, own)[-1][0]
    return pa.Table.from_arrays(
        [
            pa.array([v], t)
            for v, t in zip(
                (
                    table.column("group")[0].as_py(), rows[0][0] >> SLOT_BITS, top, levels - own, own,
                    [r[2] for r in rows], nodes, [r[3] for r in rows],
                ),
                _BLOCKS.types,
                strict=True,
            )
        ],
        schema=_BLOCKS,
    )


def tree(nodes: list[str], levels: int) -> list[list[str]]:
    """All levels from ``nodes`` up: two neighbours, or a last one alone, become their digest."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], place: int) -> list[str]:
    """What stands beside the node at ``place``, from its level up to below the last one."""
    found = []
    for level in levels[:-1]:
        other = place ^ 1
        found.append(NONE if other >= len(level) else (LEFT if other < place else RIGHT) + level[other])
        place >>= 1
    return found


def fold(node: str, codes: Sequence[str]) -> str:
    for code in codes:
        side, sibling = code[0], code[1:]
        node = digest(sibling, node) if side == LEFT else digest(node, sibling)
    return node


def proof_digest(codes: Sequence[str]) -> str:
    return digest(*[c[1:] for c in codes])


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[list[str]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, tree(row["digests"], row["spanned"])


def _node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Siblings of every node of a block up to the root."""
    for row, levels in _each_block(batches):
        n = len(row["digests"])
        paths = [siblings(levels, i) + row["above"] for i in range(n)]
        first = row["block"] << SLOT_BITS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row["group"]] * n, pa.int64()),
                pa.array(range(first, first + n), pa.int64()),
                pa.array(row["digests"], pa.string()),
                pa.array(paths, pa.list_(pa.string())),
                pa.array([row["subroot"]] * n, pa.string()),
            ],
            names=["group", "rank", "digest", "codes", "subroot"],
        )


def _leaf_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, levels in _each_block(batches):
        out = []
        for i, (key, leaf, other) in enumerate(zip(row["ids"], row["digests"], row["altered"], strict=True)):
            codes = siblings(levels, i) + row["above"]
            out.append((key, leaf, row["subroot"], proof_digest(codes), fold(leaf if other is None else other, codes)))
        types = [pa.int64()] + [pa.string()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
            names=["id", "leaf", "subroot", "proof_sha256", "folded_root"],
        )


def _rounds(nodes: DataFrame, space: Workspace, label: str) -> list[DataFrame]:
    """Blocks of every round, until each group is one block: a round spans ``SLOT_BITS`` levels."""
    rounds = []
    while True:
        block = F.shiftright("rank", SLOT_BITS)
        made = nodes.withColumn("_block", block).groupBy("group", "_block").applyInArrow(_reduce, BLOCKS)
        rounds.append(space.put(made, f"{label}-{len(rounds)}"))
        if not rounds[-1].agg(F.max("block")).first()[0]:
            return rounds
        nodes = rounds[-1].select(
            "group", F.col("block").alias("rank"), "digest", "levels",
            F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("altered"),
        )


def _paths(rounds: list[DataFrame], above: DataFrame, space: Workspace, label: str) -> DataFrame:
    """``above`` (group, rank, codes, subroot) of the last round's blocks, handed down to the first one's."""
    for number, blocks in enumerate(reversed(rounds[1:])):
        nodes = _beneath(blocks, above).mapInArrow(
            _node_paths, "group bigint, rank bigint, digest string, codes array<string>, subroot string"
        )
        above = space.put(nodes.drop("digest"), f"{label}-{number}")
    return above


def _beneath(blocks: DataFrame, above: DataFrame) -> DataFrame:
    upper = above.select("group", F.col("rank").alias("block"), F.col("codes").alias("above"), "subroot")
    return blocks.join(upper, ["group", "block"])


def manifest(
    rows: DataFrame,
    fields: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """``id_col``, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A row's leaf is the digest of its ``fields``; per ``group_col`` (null is a group of its own) leaves
    ascend by id, missing ids first, equal ids by leaf. Two neighbours, or a last one alone, become
    their digest until one is left, the subroot; subroots in order of their groups (null first, bytes
    of the text) give the root likewise. ``altered`` replaces fields where a row is to be folded from
    what it became: an altered row still has the leaf, proof and root of the original, and its folded
    root differs. Repeated rows are leaves of their own. An empty table has no result; columns that
    are not named are ignored.

    Leaves are placed by rank queries on bitmaps (``leaf_ranks``), so that the leaves are never sorted,
    and dealt to slot arrays of ``2 ** SLOT_BITS`` nodes; each round reduces that many levels and leaves
    one node an array. Proofs are handed down the same rounds.
    """
    space = Workspace(rows.sparkSession, "merkle")
    leaf = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([(altered or {}).get(f, F.col(f)) for f in fields])
    leaves = space.put(
        rows.select(
            F.col(group_col).cast("string").alias("key"),
            F.col(id_col).cast("bigint").alias("id"),
            leaf.alias("digest"),
            *([other.alias("altered")] if altered else [F.lit(None).cast("string").alias("altered")]),
        ).withColumn("altered", F.nullif("altered", "digest")),
        "leaves",
    )
    ranked, groups = leaf_ranks(leaves, space)
    leaf_rounds = _rounds(ranked.select("group", "rank", "digest", "levels", "id", "altered"), space, "leaves")
    subroots = leaf_rounds[-1].select(
        F.lit(-1).cast("bigint").alias("group"), F.col("group").alias("rank"), "digest",
        F.lit((max(groups, 1) - 1).bit_length()).alias("levels"),
        F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("altered"),
    )
    root_rounds = _rounds(subroots, space, "roots")
    top = root_rounds[-1].first()
    start = root_rounds[-1].select(
        "group", F.col("block").alias("rank"), F.array().cast("array<string>").alias("codes"), F.lit(None).cast("string").alias("subroot")
    )
    above = _paths(root_rounds, start, space, "roots-above")
    handed = _beneath(root_rounds[0], above).mapInArrow(
        _node_paths, "group bigint, rank bigint, digest string, codes array<string>, subroot string"
    )
    handed = handed.select(F.col("rank").alias("group"), F.lit(0).cast("bigint").alias("rank"), "codes", F.col("digest").alias("subroot"))
    above = _paths(leaf_rounds, space.put(handed, "groups-above"), space, "leaves-above")
    proofs = _beneath(leaf_rounds[0], above).mapInArrow(
        _leaf_proofs, "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    root = F.lit(top["digest"] if top else None).cast("string")
    return proofs.select(
        F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
