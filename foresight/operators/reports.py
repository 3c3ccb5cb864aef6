"""Contract checks as tables: a row per rule with how many rows break it, all rules counted in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foresight import contract
from foresight.operators.recourse import apply_candidate, explode_candidates

OK, BROKEN = "ok", "broken"
REPORT = "subject string, rule string, broken_rows bigint, verdict string"


def observed_counts(df: DataFrame, tests: Sequence[Column]) -> tuple[int, list[int]]:
    """Number of rows, and of those that meet each test, observed while the frame is read once."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests)]]
    df.observe(seen, *metrics).write.format("noop").mode("overwrite").save()
    return seen.get["n"], [seen.get[f"t{i}"] for i in range(len(tests))]


def _report(spark: SparkSession, rows: Sequence[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(*r, BROKEN if r[2] else OK) for r in rows], REPORT)


def required_report(df: DataFrame, required: Sequence[str], subject: str) -> DataFrame:
    """Each required column: an absent one is broken in every row (and once in an empty table), a null in its row.

    A last rule asks for rows at all. Other columns do not matter.
    """
    present = [c for c in required if c in df.columns]
    n, nulls = observed_counts(df.select(*present), [F.col(c).isNull() for c in present])
    found = dict(zip(present, nulls, strict=True))
    rows = [(subject, f"{c} given", found[c] if c in found else max(n, 1)) for c in required]
    return _report(df.sparkSession, [*rows, (subject, "has rows", int(n == 0))])


def telemetry_report(df: DataFrame) -> DataFrame:
    return required_report(df, contract.REQUIRED_TELEMETRY, "telemetry")


def prediction_report(df: DataFrame) -> DataFrame:
    return required_report(df, contract.REQUIRED_PREDICTION, "predictions")


def split_report(train: DataFrame, holdout: DataFrame, cutoff_col: str = "cutoff_date") -> DataFrame:
    """Both sides have rows, and no training row is later than the first holdout cutoff (``cutoff_col`` may be absent)."""
    sides = train.select(*[c for c in (cutoff_col,) if c in train.columns], F.lit(True).alias("_train")).unionByName(
        holdout.select(*[c for c in (cutoff_col,) if c in holdout.columns], F.lit(False).alias("_train")), allowMissingColumns=True
    )
    dated = cutoff_col in train.columns and cutoff_col in holdout.columns
    first = holdout.agg(F.min(cutoff_col)).first()[0] if dated else None
    late = F.col("_train") & (F.col(cutoff_col) >= F.lit(first)) if first is not None else F.lit(False)
    n, (trained, early) = observed_counts(sides, [F.col("_train"), late])
    rows = [
        ("split", "train has rows", int(trained == 0)),
        ("split", "holdout has rows", int(n == trained)),
        ("split", "train before holdout", early),
    ]
    return _report(train.sparkSession, rows)


def mutability_report(
    rows: DataFrame,
    features: Sequence[str] = tuple(contract.FEATURES),
    mutable: Sequence[str] = tuple(contract.MUTABLE),
    change=apply_candidate,
) -> DataFrame:
    """(feature, mutable, changed_rows, verdict): how many counterfactual rows change each feature.

    A feature outside ``mutable`` that changes is broken. Null equals null; features that ``rows`` lack
    are left out.
    """
    shared = [f for f in features if f in rows.columns]
    packed = rows.withColumn("_before", F.struct(*shared))
    changed = change(explode_candidates(packed))
    tests = [~F.col(f).eqNullSafe(F.col(f"_before.{f}")) for f in shared]
    _, counts = observed_counts(changed.select("_before", *shared), tests)
    out = [(f, f in mutable, n, BROKEN if n and f not in mutable else OK) for f, n in zip(shared, counts, strict=True)]
    return rows.sparkSession.createDataFrame(
        out, "feature string, mutable boolean, changed_rows bigint, verdict string"
    )
