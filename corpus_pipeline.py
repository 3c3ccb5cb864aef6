"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and reread as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm import bpe, langid, mixing, pii, resemblance
from foresight.llm.guarded import guarded
from foresight.llm.registry import let_workers_import, table
from foresight.llm.workspace import Workspace

RANK_FILE = "byte_bpe_multi_50k.tiktoken"

#: Rows of an Arrow batch: whole texts are some kilobytes each, and a Python worker holds a few batches.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch: pairs of long texts' shingle sets take some 100 KB a row.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepare(spark: SparkSession) -> None:
    """Workers find this checkout; small Arrow batches bound what they hold."""
    let_workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that operator 3 rejects: null, empty or without a letter; fill missing languages.

    The score sinks for very short and very long texts and where languages mix, so it drops none. Where
    no row has a language there is nothing to learn: texts with a letter stay and keep a null language.
    Repeated rows are told alike, an empty table stays empty, other columns pass through by any name.
    """
    prepare(spark)

    def told(rows: DataFrame) -> DataFrame:
        out = langid.predict(rows, langid.fit(rows), lang_out="_lang", score_out="_score")
        known = F.col("_lang") != langid.UNKNOWN
        return out.filter(known | F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", F.when(known, F.col("_lang"))))

    return guarded(docs, ["doc_id", "text", "lang"], told)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles are alike to 0.8 or more.

    Fingerprint groups of operator 1 give the first links, each verified on whole shingle sets; its radius
    alone would miss half of the near copies, which ``resemblance`` finds among the texts left apart. Texts without words form one group, of which one stays;
    of equal ids one row stays, rows without id come last; other columns pass through by any name.
    """
    prepare(spark)
    return resemblance.deduplicate(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mark or remove personal values and the terms that give them away; no row goes.

    Null texts stay null, ``n_chars`` is that of the cleaned text; other columns pass through by any name.
    """
    prepare(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw every document as often as its source's target asks for.

    Texts without words hold nothing to draw; a null source is a source; of rows with one id, source and
    size each is drawn as often as the others; other columns pass through by any name.
    """
    prepare(spark)
    return mixing.draw(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids and their number; the text is what the ids decode to. Null texts become empty.

    Columns ``ids``, ``decoded`` and ``n_tokens`` are the stage's own and replace any of that name.
    """
    prepare(spark)
    coded = bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return coded.withColumns(
        {"text": F.decode("decoded", "UTF-8"), "n_tokens": F.expr("cast(octet_length(ids) / 4 as bigint)")}
    ).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Fitted models, groups and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = space.put(stage(spark, docs, sf_dir), name)
        if place:
            space.drop(STAGES[place - 1][0])
    return docs
