"""Audit of stored telemetry: its figures against those of the stored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresight.functions.flags import ratio
from foresight.operators.skew import join_runs

#: Figures that follow from the predictions, and by how much the stored ones may differ: predictions are
#: stored with four digits (scores) or two (money), and so are the figures.
TOLERANCES = {
    "test_sample_count": 0.0,
    "churn_auc": 1e-3,
    "sales_mape": 1e-3,
    "sales_rmse": 0.02,
    "sales_mae": 0.02,
    "sales_wmape": 1e-3,
    "risk_queue_count": 0.0,
    "risk_queue_recall": 1e-3,
    "risk_queue_precision": 1e-3,
    "risk_queue_lift": 0.02,
}


def auc_by_run(predictions: DataFrame, label: str = "actual_churn", score: str = "churn_probability") -> DataFrame:
    """(run_id, churn_auc) with ties averaged; 0.5 for a run with a single class.

    Rows are folded by run and score first: stored scores have four digits, so a run keeps at most
    10,001 rows for its window.
    """
    known = predictions.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = known.groupBy("run_id", F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    below = Window.partitionBy("run_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    sums = cells.withColumn("won", won).groupBy("run_id").agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return sums.select("run_id", ratio(F.col("won"), F.col("p") * F.col("q"), 0.5).alias("churn_auc"))


def run_metrics(predictions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One row a run of ``telemetry`` that has predictions: the figures of ``TOLERANCES`` from its rows.

    All sums come from one aggregation by run, queue figures with the run's own threshold (null without one).
    """
    runs = telemetry.select("run_id", F.col("risk_threshold").cast("double").alias("_threshold"))
    rows = join_runs(predictions, runs, "inner")
    y, forecast = F.col("actual_sales").cast("double"), F.col("predicted_sales").cast("double")
    error, churned = F.abs(y - forecast), F.col("actual_churn") == 1
    queued = F.col("churn_probability").cast("double") >= F.col("_threshold")
    sums = rows.groupBy("run_id").agg(
        F.count("*").alias("test_sample_count"),
        F.coalesce(F.avg(F.when(y > 0, error / y)), F.lit(0.0)).alias("sales_mape"),
        F.sqrt(F.avg(error * error)).alias("sales_rmse"),
        F.avg(error).alias("sales_mae"),
        ratio(F.sum(error), F.sum(F.abs(y))).alias("sales_wmape"),
        F.count_if(queued).alias("_queued"),
        F.count_if(churned).alias("_churners"),
        F.count_if(queued & churned).alias("_captured"),
        F.first("_threshold").alias("_threshold"),
    )

    def with_threshold(figure: Column) -> Column:
        return F.when(F.col("_threshold").isNotNull(), figure)

    precision = ratio(F.col("_captured"), F.col("_queued"))
    base = ratio(F.col("_churners"), F.col("test_sample_count"))
    return sums.join(auc_by_run(rows), "run_id", "left").select(
        "run_id",
        "test_sample_count",
        F.coalesce("churn_auc", F.lit(0.5)).alias("churn_auc"),
        "sales_mape",
        "sales_rmse",
        "sales_mae",
        "sales_wmape",
        with_threshold(F.col("_queued")).alias("risk_queue_count"),
        with_threshold(ratio(F.col("_captured"), F.col("_churners"))).alias("risk_queue_recall"),
        with_threshold(precision).alias("risk_queue_precision"),
        with_threshold(ratio(precision, base)).alias("risk_queue_lift"),
    )


def reconcile(telemetry: DataFrame, predictions: DataFrame, tolerances: dict[str, float] | None = None) -> DataFrame:
    """(run_id, metric, stored, recomputed): the figures of stored runs that their predictions do not bear out.

    A figure that telemetry does not hold is not compared; a run without predictions fails in every
    figure it holds. Figures in ``tolerances`` alone are compared.
    """
    allowed = TOLERANCES if tolerances is None else tolerances
    names = [m for m in allowed if m in telemetry.columns]
    stored = telemetry.select("run_id", F.struct(*[F.col(m).cast("double").alias(m) for m in names]).alias("s"))
    figures = run_metrics(predictions, telemetry)
    recomputed = figures.select("run_id", F.struct(*[F.col(m).cast("double").alias(m) for m in names]).alias("r"))

    def off(name: str) -> Column:
        s, r = F.col(f"s.{name}"), F.col(f"r.{name}")
        wrong = s.isNotNull() & ~F.coalesce(F.abs(s - r) <= allowed[name] + 1e-9, F.lit(False))
        return F.when(wrong, F.struct(F.lit(name).alias("metric"), s.alias("stored"), r.alias("recomputed")))

    both = stored.join(recomputed, "run_id", "left")
    differences = F.array_compact(F.array(*[off(m) for m in names]))
    return both.select("run_id", F.explode(differences).alias("d")).select("run_id", "d.*")
