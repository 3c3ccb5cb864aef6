"""Model metrics, each family from one aggregation."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight import contract
from foresight.functions.flags import ratio
from foresight.functions.numbers import round_half_even
from foresight.operators.ranking import exact_quantiles


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def hard_label(probability: Column, threshold: float = contract.DECISION_THRESHOLD) -> Column:
    return (probability >= threshold).cast("int")


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Area under the ROC curve with ties averaged; 0.5 when only one class is present.

    The evaluator sorts distinct scores by range over the cluster; ``numBins=0`` keeps it exact.
    """
    pairs = df.select(F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    low, high = pairs.agg(F.min("y"), F.max("y")).first()
    if low is None or low == high:
        return 0.5
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="s", labelCol="y", metricName="areaUnderROC", numBins=0
    )
    return float(evaluator.evaluate(pairs))


def classification_metrics(
    df: DataFrame, label: str, score: str, threshold: float = contract.DECISION_THRESHOLD
) -> DataFrame:
    """One row: confusion counts, precision, recall, F1, Brier score, sample count."""
    y, p = F.col(label).cast("int"), F.col(score)
    called = p >= threshold
    counts = df.agg(
        _count((y == 0) & ~called).alias("tn"),
        _count((y == 0) & called).alias("fp"),
        _count((y == 1) & ~called).alias("fn"),
        _count((y == 1) & called).alias("tp"),
        F.avg(F.pow(p - y, F.lit(2))).alias("brier_score"),
        F.count("*").alias("sample_count"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "brier_score",
        "tn",
        "fp",
        "fn",
        "tp",
        "sample_count",
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: RMSE, MAE, MAPE over positive actuals, WMAPE, sample count."""
    y, error = F.col(actual).cast("double"), F.abs(F.col(actual) - F.col(predicted))
    sums = df.agg(
        F.sqrt(F.avg(error * error)).alias("sales_rmse"),
        F.avg(error).alias("sales_mae"),
        F.coalesce(F.avg(F.when(y > 0, error / y)), F.lit(0.0)).alias("sales_mape"),
        F.sum(error).alias("abs_error"),
        F.sum(F.abs(y)).alias("abs_actual"),
        F.count("*").alias("sample_count"),
    )
    return sums.select(
        "sales_rmse",
        "sales_mae",
        "sales_mape",
        ratio(F.col("abs_error"), F.col("abs_actual")).alias("sales_wmape"),
        "sample_count",
    )


def risk_threshold(
    df: DataFrame, score: str, percentile: float = contract.RISK_PERCENTILE
) -> DataFrame:
    """One row: the interpolated quantile of the training scores that opens the risk queue."""
    scores = df.select(F.lit("score").alias("model"), F.col(score).alias("p"))
    return exact_quantiles(scores, "model", "p", [percentile]).select(
        F.element_at("quantiles", 1).alias("risk_threshold")
    )


def queue_statistics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row: size, captured churners, recall, precision, base rate and lift of the risk queue."""
    churned, queued = F.col(label) == 1, F.col(score) >= threshold
    counts = df.agg(
        _count(queued).alias("risk_queue_count"),
        _count(churned).alias("total_churners"),
        _count(churned & queued).alias("captured_churners"),
        F.count("*").alias("sample_count"),
    )
    captured, size = F.col("captured_churners"), F.col("risk_queue_count")
    return (
        counts.withColumn("risk_queue_recall", ratio(captured, F.col("total_churners")))
        .withColumn("risk_queue_precision", ratio(captured, size))
        .withColumn("base_churn_rate", ratio(F.col("total_churners"), F.col("sample_count")))
        .withColumn(
            "risk_queue_lift", ratio(F.col("risk_queue_precision"), F.col("base_churn_rate"))
        )
    )


def residual_sigma(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: sample standard deviation of the residuals; 0 for one row, 1 for none."""
    n, spread = F.count("*"), F.stddev_samp(F.col(actual) - F.col(predicted))
    sigma = F.when(n == 0, F.lit(1.0)).when(n == 1, F.lit(0.0)).otherwise(spread)
    return df.agg(sigma.alias("sigma"))


def prediction_intervals(
    df: DataFrame,
    predicted: str,
    sigma: float,
    z: float = contract.Z_95,
) -> DataFrame:
    """Adds ``sales_lower_bound`` (never negative) and ``sales_upper_bound``, to the cent."""
    half = z * sigma
    return df.withColumns(
        {
            "sales_lower_bound": round_half_even(F.greatest(F.lit(0.0), F.col(predicted) - half), 2),
            "sales_upper_bound": round_half_even(F.col(predicted) + half, 2),
        }
    )
