"""Prefix trie of conversations: sorted paths, union-find over neighbours' common depth, merged partition forests."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight.llm.running import running_totals
from foresight.llm.workspace import Workspace

#: Parts of a turn's digest that are summed along a conversation: 24 bits each, so that 2^39 turns fit a long.
LIMBS, LIMB_HEX = 5, 6
#: Length of a node's name in a path (hexadecimal digits of 16 bytes).
NAME = 32
#: Unshared turns that one row is unfolded into at a time.
TAIL_ROWS = 4096

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PIECE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, node string, parent string, bytes bigint, ids string, part bigint"
)
_PIECE = pa.schema(
    [
        (c, pa.string() if c in ("ends_sha256", "node", "parent", "ids") else pa.int64())
        for c in [p.split()[0] for p in PIECE.split(", ")]
    ]
)


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, place (from 1), digest and bytes of each turn; rows without a conversation id take no part.

    Turns ascend with missing numbers first, equal numbers by digest. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    narrow = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, NAME).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest")]
    rows = running_totals(narrow, order, {"row": F.lit(1).cast("bigint")})
    firsts = rows.groupBy("conv").agg(F.min("row").alias("first"))
    return rows.join(firsts, "conv").select("conv", (F.col("row") - F.col("first") + 1).alias("place"), "digest", "bytes")


def rebuilt(turns: DataFrame, convs: DataFrame, base: Column, head: Column) -> DataFrame:
    """conv, depth, digest, bytes: the first ``head`` turns of conversation ``base``, then the own ones after as many.

    ``turns`` come from ``numbered_turns``; ``convs`` has one row a conversation: conv, own (its turns).
    """
    plan = convs.select("conv", "own", base.alias("base"), head.cast("bigint").alias("head"))
    lent = convs.select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    plan = plan.join(lent, "base", "left").withColumn("lent", F.least(F.coalesce("lent", F.lit(0)), "head"))
    most = plan.agg(F.max("head")).first()[0] or 0
    heads = turns.filter(F.col("place") <= most).withColumnRenamed("conv", "base")
    borrowed = plan.select("conv", "base", "head").join(heads, "base").filter(F.col("place") <= F.col("head"))
    kept = turns.join(plan.select("conv", "head", "lent"), "conv").filter(F.col("place") > F.col("head"))
    return borrowed.select("conv", F.col("place").alias("depth"), "digest", "bytes").unionByName(
        kept.select("conv", (F.col("place") - F.col("head") + F.col("lent")).alias("depth"), "digest", "bytes")
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, node and bytes: ``node`` names the sequence of turns up to ``depth``.

    A turn and its depth are hashed, and the hashes are summed along the conversation (120 bits), so
    that a conversation of any length needs no task of its own. Equal sums mean equal sequences.
    """
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    at = lambda i: F.conv(F.substring(hashed, 1 + i * LIMB_HEX, LIMB_HEX), 16, 10).cast("bigint")
    limbs = [f"limb{i}" for i in range(LIMBS)]
    given = turns.withColumns({f"own{i}": at(i) for i in range(LIMBS)})
    summed = running_totals(
        given, [F.col("conv"), F.col("depth")], {f"limb{i}": F.col(f"own{i}") for i in range(LIMBS)}, including=True
    )
    starts = summed.filter(F.col("depth") == 1).select(
        "conv", *[(F.col(f"limb{i}") - F.col(f"own{i}")).alias(f"start{i}") for i in range(LIMBS)]
    )
    parts = [(F.col(limb) - F.col(f"start{i}")).cast("string") for i, limb in enumerate(limbs)]
    name = F.md5(F.concat_ws(",", F.col("depth").cast("string"), *parts))
    return summed.join(starts, "conv").select("conv", "depth", name.alias("node"), "bytes")


def common_depth(a: str, b: str) -> int:
    """Nodes that two paths share; names stand for whole prefixes, so halving finds where they part."""
    low, high = 0, min(len(a), len(b)) // NAME
    if a[: high * NAME] == b[: high * NAME]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[(middle - 1) * NAME : middle * NAME] == b[(middle - 1) * NAME : middle * NAME]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """Trie nodes of one run of sorted paths.

    Every row begins as a component at the depth of its path. The edges between neighbours are taken by
    falling common depth; an edge lifts both components to its depth, writing down the nodes passed on
    the way, and joins them there: that is where the trie branches. ``left`` and ``right`` are the common
    depths with the rows beyond the run (-1: none). A node that may go on beyond is written as a piece,
    with what lies closed below it; its counts restart above it, since its piece holds them.
    """

    def __init__(self, convs, paths, tails, sizes, left: int, right: int, part: int) -> None:
        self.convs, self.paths, self.tails, self.sizes = convs, paths, tails, sizes
        self.left, self.right, self.part, n = left, right, part, len(convs)
        self.up = list(range(n))
        self.low, self.high = list(range(n)), list(range(n))
        self.depth = [len(p) // NAME for p in paths]
        self.size, self.least = [1] * n, list(convs)
        self.kids = [int(t) for t in tails]
        self.leaves = [int(t) for t in tails]
        self.saved = [0] * n
        self.ends = [int(not t) for t in tails]
        self.waiting: list[list[int]] = [[] for _ in range(n)]
        self.rows: list[list] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def build(self) -> list[list]:
        n = len(self.convs)
        shared = np.array([common_depth(self.paths[i], self.paths[i + 1]) for i in range(n - 1)], dtype=np.int64)
        for edge in np.argsort(-shared, kind="stable").tolist():
            self.join(self.find(edge), self.find(edge + 1), int(shared[edge]))
        if n:
            self.lift(self.find(0), -1)
        return self.rows

    def join(self, a: int, b: int, depth: int) -> None:
        self.lift(a, depth)
        self.lift(b, depth)
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.least[a] = min(self.least[a], self.least[b])
        for counts in (self.size, self.kids, self.leaves, self.saved, self.ends):
            counts[a] += counts[b]
        more, fewer = self.waiting[a], self.waiting[b]
        if len(more) < len(fewer):
            more, fewer = fewer, more
        more.extend(fewer)
        self.waiting[a], self.waiting[b] = more, []

    def lift(self, r: int, depth: int) -> None:
        for at in range(self.depth[r], depth, -1):
            self.write(r, at)
        self.depth[r] = depth

    def write(self, r: int, at: int) -> None:
        first, n = self.low[r], self.size[r]
        size = self.sizes[first][at - 1] if at else 0
        ended = ",".join(str(self.convs[i]) for i in range(first, first + self.ends[r]))
        reaches = first == 0 and at <= self.left or self.high[r] == len(self.convs) - 1 and at <= self.right
        here, path = len(self.rows), self.paths[first]
        if reaches:
            node, parent = path[(at - 1) * NAME : at * NAME] if at else "", path[max(at - 2, 0) * NAME : max(at - 1, 0) * NAME]
            self.rows.append(
                [self.least[r], at, None, n, self.kids[r], self.leaves[r], self.saved[r], None, node, parent if at else None, size, ended, self.part]
            )
            for child in self.waiting[r]:
                self.rows[child][9] = node
            self.waiting[r], self.kids[r], self.leaves[r], self.saved[r] = [], 0, 0, 0
        else:
            self.leaves[r] += self.kids[r] == 0
            self.saved[r] += (n - 1) * size
            self.rows.append(
                [self.least[r], at, None, n, self.kids[r], self.leaves[r], self.saved[r], _hash(ended), None, None, size, None, self.part]
            )
            for child in self.waiting[r]:
                self.rows[child][2] = self.least[r]
            self.waiting[r], self.kids[r] = [here], 1
        self.ends[r] = 0


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _table(rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 10_000):
        columns = zip(*rows[start : start + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _forests(edges: dict[int, tuple[int, int]]):
    """Common depths with the neighbouring runs by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if table:
            held = pa.Table.from_batches(table)
            part = held.column("part")[0].as_py()
            columns = [held.column(c).to_pylist() for c in ("conv", "path", "tail", "sizes")]
            yield from _table(Forest(*columns, *edges[part], part).build(), _PIECE)

    return run


_OPEN = pa.schema(
    [(c, pa.string() if c in ("node", "parent", "ends_sha256") else pa.int64()) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node")]
)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the nodes that several runs share, from the deepest up."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: -r["depth"])
    by_name = {r["node"]: r for r in rows}
    for r in rows:
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["bytes"]
        over = by_name.get(r["parent"])
        r["parent_conv_id"] = over["conv_id"] if over else None
        if over:
            over["n_children"] += 1
            over["n_leaves"] += r["n_leaves"]
            over["saved_tokens"] += r["saved_tokens"]
    yield from _table([[r[c] for c in _OPEN.names] for r in rows], _OPEN)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose pieces come in order: the hash is fed piece by piece."""
    name, state = None, None
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is None or node != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = node, sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if done:
            yield from _table(done, schema)
    if state is not None:
        yield from _table([(name, state.hexdigest())], schema)


def prefix_trie(sequences: DataFrame, convs: DataFrame, partitions: int | None = None) -> DataFrame:
    """All trie nodes of ``sequences`` (conv, depth from 1 without gaps, digest, bytes), members ``convs`` (conv).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens ((n_convs - 1) times the last turn's bytes, summed over the subtree) and ends_sha256
    (SHA-256 of the comma-joined ids of the members that end at the node, ascending). A conversation
    without turns belongs to the root alone; no conversation, no row.

    Turns that no other conversation shares are a plain chain and never enter a path. The paths of
    shared nodes are sorted in ranges; each range builds its forest, writes its finished nodes and
    contracts to the nodes on its two borders, which meet by name: at most two paths a range.
    """
    space = Workspace(sequences.sparkSession, "trie")
    rows = space.put(prefixes(sequences), "prefixes")
    shared = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("conv").alias("least")).filter(F.col("n") > 1)
    shared = space.put(shared.drop("n"), "shared")
    step = F.when(F.col("least").isNotNull(), F.struct("depth", "node", "bytes", "least"))
    gathered = (
        rows.join(shared, "node", "left")
        .groupBy("conv")
        .agg(F.max("depth").alias("length"), F.array_sort(F.collect_list(step)).alias("steps"))
    )
    every = convs.join(gathered, "conv", "left").select(
        "conv",
        F.coalesce("length", F.lit(0).cast("bigint")).alias("length"),
        F.array_join(F.transform("steps", lambda s: s["node"]), "").alias("path"),
        F.transform("steps", lambda s: s["bytes"]).alias("sizes"),
        F.size("steps").alias("held"),
        F.try_element_at("steps", F.lit(-1))["least"].alias("least"),
    )
    none = F.array().cast("array<bigint>")
    held = F.greatest("held", F.lit(0)).cast("bigint")
    every = every.withColumns(
        {"path": F.coalesce("path", F.lit("")), "sizes": F.coalesce("sizes", none), "held": held, "tail": F.col("length") > held}
    )
    order = [F.col("path"), F.col("tail"), F.col("conv")]
    sized = order if partitions is None else [partitions, *order]
    placed = every.repartitionByRange(*sized).sortWithinPartitions(*order)
    placed = placed.withColumn("part", F.spark_partition_id().cast("bigint")).checkpoint()
    borders = sorted(placed.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high")).collect())
    meet = [-1, *[common_depth(a.high, b.low) for a, b in zip(borders, borders[1:])], -1]
    edges = {b.part: (meet[i], meet[i + 1]) for i, b in enumerate(borders)}
    pieces = space.put(placed.select("conv", "path", "tail", "sizes", "part").mapInArrow(_forests(edges), PIECE), "pieces")

    open_pieces = pieces.filter(F.col("node").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    contracted = open_pieces.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("bytes").alias("bytes"), F.lit(None).cast("bigint").alias("parent_conv_id"), *sums,
    )
    ids = open_pieces.filter(F.length("ids") > 0).select("node", "part", "ids")
    hashes = ids.repartition("node").sortWithinPartitions("node", "part").mapInArrow(_ends, "node string, ends_sha256 string")
    given = contracted.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_hash(""))))
    border_nodes = space.put(given.coalesce(1).mapInArrow(_contracted, NODE + ", node string"), "border")

    names = [c.split()[0] for c in NODE.split(", ")]
    closed = pieces.filter(F.col("node").isNull())
    over = border_nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("_over"))
    hanging = closed.filter(F.col("parent").isNotNull()).join(over, "parent").withColumn("parent_conv_id", F.col("_over"))
    inner = closed.filter(F.col("parent").isNull())
    return (
        inner.select(*names)
        .unionByName(hanging.select(*names))
        .unionByName(border_nodes.select(*names))
        .unionByName(_tails(placed).select(*names))
    )


def _tails(placed: DataFrame) -> DataFrame:
    """Nodes with a single member: the turns after the last shared one."""
    least = placed.agg(F.min("conv").alias("_least"))  # one row
    first, count = F.col("held") + 1, F.col("length") - F.col("held")
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((count - 1) / TAIL_ROWS)))
    until = F.least(F.col("length"), first + (F.col("_block") + 1) * TAIL_ROWS - 1)
    unfolded = (
        placed.filter("tail")
        .crossJoin(F.broadcast(least))
        .withColumn("_block", blocks)
        .withColumn("depth", F.explode(F.sequence(first + F.col("_block") * TAIL_ROWS, until)))
    )
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("bigint")
    return unfolded.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == first, F.coalesce("least", "_least")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"),
        (~last).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame,
    base: Column,
    head: Column,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """The trie of conversations that are rebuilt first (``base`` and ``head`` over the column ``conv``).

    See ``numbered_turns`` for order, ties and nulls, ``rebuilt`` for the turns, ``prefix_trie`` for the
    result. Repeated rows are turns of their own; an empty table has no nodes; further columns are
    ignored, whatever their names.
    """
    space = Workspace(turns.sparkSession, "turns")
    own = space.put(numbered_turns(turns, conv_col, turn_col, role_col, text_col), "own")
    convs = space.put(own.groupBy("conv").agg(F.count("*").alias("own")), "convs")
    return prefix_trie(rebuilt(own, convs, base, head), convs.select("conv"), partitions)
