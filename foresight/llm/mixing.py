"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document of a source should be taken ``target / source size`` times. The whole part is certain.
The rest is a fractional copy whose mass (fraction times size) is rounded in pairs: mass moves from
one document to the other, in a random direction that keeps expectations, until one copy is 0 or 1.
The words of a pair never change, so a source misses its target by less than its last document.
Pairs form within blocks; what is left of each block goes up a reduction tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight.llm.guarded import guarded
from foresight.llm.workspace import Workspace
from foresight.operators.ranking import with_row_number

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents or remainders that one node of the reduction tree folds, about.
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, space: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, n, target) from (source, size, rows), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above. Each round is one aggregate; at least one source stops in each.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("n"))
    placed = with_row_number(sources, [F.col("source").asc_nulls_last()], "place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    weighed = space.put(
        placed.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)).drop("place"),
        "weighed",
    )
    room, share = F.lit(most) * F.col("source_size"), F.lit(0.0)
    stopped = -1
    while True:
        full = share * F.col("weight") > room
        state = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, room).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("int")).alias("stopped"),
        ).first()
        if state["stopped"] == stopped or not state["open"]:
            break
        stopped = state["stopped"]
        share = F.lit((state["all"] - state["held"]) / state["open"])
    target = F.least(share * F.col("weight"), room.cast("double"))
    return space.put(weighed.select("source", "source_size", "n", target.alias("target")), "targets")


def _uniform(*columns) -> Column:
    """Pseudo-random number in [0, 1) that only depends on the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _fold(items: Column, item_type: str, level: int) -> Column:
    """Struct of ``rest``, the last fractional item or null, and ``done``, items with their extra copy.

    An item has key, size, mass (0 < mass < size) and payload columns; the order of items and the
    random numbers come from keys.
    """
    done_type = f"array<struct<item: {item_type}, extra: int>>"
    start = F.struct(
        F.lit(None).cast(item_type).alias("rest"), F.array().cast(done_type).alias("done")
    )

    def with_mass(x: Column, mass: Column) -> Column:
        return x.withField("mass", mass)

    def settled(x: Column, extra: int) -> Column:
        return F.struct(x.alias("item"), F.lit(extra).alias("extra"))

    def step(state: Column, b: Column) -> Column:
        a = state["rest"]
        to_a = F.least(a["size"] - a["mass"], b["mass"])
        to_b = F.least(a["mass"], b["size"] - b["mass"])
        chance = F.coalesce(to_b / F.nullif(to_a + to_b, F.lit(0.0)), F.lit(1.0))
        first = _uniform(a["key"], b["key"], F.lit(level)) < chance
        a_full, a_empty = a["size"] - a["mass"], a["mass"]
        b_empty, b_full = b["mass"], b["size"] - b["mass"]
        none = F.lit(None).cast(item_type)

        def result(rest: Column, *ends: Column) -> Column:
            return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(*ends)).alias("done"))

        return (
            F.when(a.isNull(), F.struct(b.alias("rest"), state["done"].alias("done")))
            .when(first & (a_full < b_empty), result(with_mass(b, b_empty - a_full), settled(a, 1)))
            .when(first & (a_full > b_empty), result(with_mass(a, a["mass"] + b_empty), settled(b, 0)))
            .when(first, result(none, settled(a, 1), settled(b, 0)))
            .when(a_empty < b_full, result(with_mass(b, b["mass"] + a_empty), settled(a, 0)))
            .when(a_empty > b_full, result(with_mass(a, a["mass"] - b_full), settled(b, 1)))
            .otherwise(result(none, settled(a, 0), settled(b, 1)))
        )

    return F.aggregate(items, start, step)


def item_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    fan_in: int = FAN_IN,
    seed: int = 29,
) -> DataFrame:
    """One row per item: id, source, size, rows, source_size, target, copies and taken words.

    Size is the number of words, 0 for null and empty texts, which are taken 0 times. A null source
    is a source like any other and comes last. Rows equal in id, source and size are one item and
    are all taken equally often; a null id is an id like any other. The same rows, weights and
    ``seed`` give the same result however they are partitioned. An empty table gives an empty result;
    other columns are ignored.

    A block is about ``fan_in`` items of one source, so a source with a third of all rows is many
    blocks; the tree is log(n) / log(fan_in) levels deep.
    """
    space = Workspace(docs.sparkSession, "mixing")
    picked = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    items = space.put(picked.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "items")
    targets = source_targets(
        items.select("source", (F.col("size") * F.col("rows")).alias("size"), "rows"), space, weights, most
    )
    wanted = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    spread = (
        items.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(wanted)).otherwise(0).cast("int"))
        .withColumn("part", F.when(F.col("size") > 0, wanted - F.floor(wanted)).otherwise(0.0))
    )
    weight = (F.col("size") * F.col("rows")).cast("double")
    payload = F.struct("id", "size", "rows", "source_size", "target", "whole")
    key = F.xxhash64("id", "source", "size", F.lit(seed))
    items_of = spread.select(
        "source",
        F.ceil(F.col("n") / fan_in).alias("blocks"),
        F.struct(
            key.alias("key"), weight.alias("size"), (weight * F.col("part")).alias("mass"), payload.alias("row")
        ).alias("item"),
    )
    item_type = items_of.schema["item"].dataType.simpleString()
    fractional = (F.col("item.mass") > 0) & (F.col("item.mass") < F.col("item.size"))
    certain = items_of.filter(~fractional).select(
        "source", "item", (F.col("item.mass") > 0).cast("int").alias("extra")
    )
    widest = targets.agg(F.max(F.ceil(F.col("n") / fan_in))).first()[0] or 1
    level_rows = items_of.filter(fractional).select(
        "source", F.pmod(F.xxhash64("item.key", F.lit(seed)), F.col("blocks")).alias("block"), "item"
    )
    decided, level = certain, 0
    while True:
        folded = space.put(
            level_rows.groupBy("source", "block")
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
            .select("source", "block", _fold(F.col("items"), item_type, level).alias("f")),
            f"level-{level}",
        )
        ended = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.item", "d.extra")
        decided = decided.union(ended)
        rest = folded.select("source", "block", F.col("f.rest").alias("item")).filter(F.col("item").isNotNull())
        if widest <= 1:
            break
        widest, level = math.ceil(widest / fan_in), level + 1
        level_rows = rest.withColumn("block", F.floor(F.col("block") / fan_in))
    last = _uniform("item.key", F.lit(seed)) * F.col("item.size") < F.col("item.mass")
    decided = decided.union(rest.select("source", "item", last.cast("int").alias("extra")))
    row = F.col("item.row")
    copies = row["whole"] + F.col("extra")
    return decided.select(
        row["id"].alias(id_col),
        F.col("source").alias(source_col),
        row["size"].alias("size"),
        row["source_size"].alias("source_size"),
        row["target"].alias("target"),
        copies.alias("copies"),
        (copies * row["size"]).cast("bigint").alias("taken"),
        row["rows"].alias("rows"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``item_copies`` with one row per input row; it takes the same options."""
    items = item_copies(docs, id_col, **options)
    return items.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("_row", "rows")


def draw(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: every input row as often as ``item_copies`` takes it, with all its columns.

    Rows with null or empty texts hold no words and are not drawn; a null source is a source, rows of
    one id, source and size are drawn alike, an empty table stays empty. Texts are shuffled once.
    """
    return guarded(docs, [id_col, text_col, source_col], lambda d: _drawn(d, id_col, text_col, source_col, **options))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, **options) -> DataFrame:
    items = item_copies(docs, id_col, text_col, source_col, **options)
    wanted = items.filter(F.col("copies") > 0).select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    )
    match = (
        docs[id_col].eqNullSafe(F.col("_id"))
        & docs[source_col].eqNullSafe(F.col("_source"))
        & (word_count(docs[text_col]) == F.col("_size"))
    )
    drawn = docs.join(wanted, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns])
