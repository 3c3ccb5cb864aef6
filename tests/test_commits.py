"""Two-phase commits of prediction runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foresight.sources.commits import CommittedTable

SCHEMA = (
    "customer_id string, churn_probability double, predicted_sales double, sales_lower_bound double, "
    "sales_upper_bound double, prescriptive_action string, prescribed_risk_drop double, subscription_id string"
)


def rows(spark, n, probability=0.5, broken_from=None):
    """Several tasks; from ``broken_from`` on, rows break a rule, so that early tasks have already written."""
    late = F.lit(False) if broken_from is None else F.col("id") >= broken_from
    return spark.range(0, n, 1, 6).select(
        F.concat(F.lit("c"), F.col("id")).alias("customer_id"),
        F.when(late, 1.5).otherwise(probability).alias("churn_probability"),
        F.lit(10.0).alias("predicted_sales"),
        F.lit(9.0).alias("sales_lower_bound"),
        F.lit(11.0).alias("sales_upper_bound"),
        F.lit("none").alias("prescriptive_action"),
        F.lit(probability).alias("prescribed_risk_drop"),
        F.col("id").cast("string").alias("subscription_id"),
    )


def held(table):
    return {(r.run_id, float(r.churn_probability)): r.n for r in
            table.read().groupBy("run_id", "churn_probability").agg(F.count("*").alias("n")).collect()}


def test_a_job_that_dies_leaves_no_row(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    assert table.read().count() == 0 and table.entries().count() == 0
    with pytest.raises(ValueError, match="churn_probability out of range"):
        table.append("r1", rows(spark, 600, broken_from=550))
    assert held(table) == {}
    table.stage("r1", rows(spark, 600))  # killed between the phases
    assert held(table) == {}
    assert table.append("r1", rows(spark, 600))["total_records"] == 600
    assert held(table) == {("r1", 0.5): 600}


def test_retries_are_idempotent_and_runs_are_replaced(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    first = table.append("r1", rows(spark, 1001), token="job-1")
    assert (first["batch_count"], first["version"]) == (3, 1)
    assert table.append("r1", rows(spark, 5), token="job-1") == first  # nothing is written again
    table.append("007", rows(spark, 3, 0.25))
    reader = table.read()  # planned before the next commit
    table.append("r1", rows(spark, 4, 0.75), token="job-2")
    assert reader.count() == 1004
    assert held(table) == {("r1", 0.75): 4, ("007", 0.25): 3}
    assert [r.version for r in table.entries().orderBy("version").collect()] == [1, 2, 3]


def test_writers_alongside_take_different_versions(spark, tmp_path):
    from multiprocessing.pool import ThreadPool

    table = CommittedTable(spark, f"{tmp_path}/t")
    staged = [(f"r{i}", *table.stage(f"r{i}", rows(spark, 10 + i))) for i in range(6)]
    with ThreadPool(6) as pool:
        versions = pool.map(lambda s: table.commit(*s), staged)
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert {run: n for (run, _), n in held(table).items()} == {f"r{i}": 10 + i for i in range(6)}


def test_a_version_that_is_taken_is_never_replaced(spark, tmp_path):
    from multiprocessing.pool import ThreadPool

    table = CommittedTable(spark, f"{tmp_path}/t")
    for turn in range(4):  # all writers find the same next version
        drafts = [table._at(f"{table.manifest}/.draft-{turn}-{i}") for i in range(12)]
        for i, (draft, files) in enumerate(drafts):
            stream = files.create(draft, False)
            stream.write(bytearray(str(i).encode()))
            stream.close()
        final, files = table._at(f"{table.manifest}/v{turn}.json")
        with ThreadPool(12) as pool:
            won = pool.map(lambda d: table._claim(d[0], final, files), drafts)
        assert sum(won) == 1
        assert (tmp_path / f"t/manifest/v{turn}.json").read_text() == str(won.index(True))


def test_vacuum_keeps_what_counts(spark, tmp_path):
    table = CommittedTable(spark, f"{tmp_path}/t")
    for probability in (0.1, 0.2, 0.3):
        table.append("r1", rows(spark, 5, probability))
    table.stage("r2", rows(spark, 5))
    assert table.vacuum(keep=2) == 2  # the oldest commit and the uncommitted stage
    assert held(table) == {("r1", 0.3): 5}
    assert table.vacuum() == 1 and held(table) == {("r1", 0.3): 5}


def test_empty_predictions_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="predictions is empty"):
        CommittedTable(spark, f"{tmp_path}/t").append("r", rows(spark, 0))
