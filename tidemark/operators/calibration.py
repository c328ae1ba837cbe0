"""Confidence calibration: reliability bins, calibration errors and fitted calibrators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.calibrators import Calibrator, CalibratorModel, fit_isotonic as isotonic_blocks, fit_logistic, fit_temperature, logistic, points  # noqa: F401
from tidemark.operators.evaluation import TIGHT_M

# Ten equal bins on [0, 1], open on the left and closed on the right.
BIN_EDGES = [i * 0.1 for i in range(10)] + [1.0]
MIN_ROWS_ANALYSE, MIN_ROWS_FIT, WELL_CALIBRATED_ECE = 10, 50, 0.1


def calibration_pairs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, task, confidence, correct)`` for the three tasks of a prediction row."""
    def hit(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)
    tasks = F.array(
        F.struct(F.lit("height").alias("task"), F.col("conf_h").alias("confidence"),
                 hit(F.abs(F.col("h_pred") - F.col("h_true")) <= TIGHT_M).alias("correct")),
        F.struct(F.lit("direction").alias("task"), F.col("conf_d").alias("confidence"),
                 hit(F.col("d_pred") == F.col("d_true")).alias("correct")),
        F.struct(F.lit("breaking").alias("task"), F.col("conf_b").alias("confidence"),
                 hit(F.col("b_pred") == F.col("b_true")).alias("correct")))
    return df.select(*by, F.explode(tasks).alias("_t")).select(*by, "_t.*")


def bin_number(confidence: Column) -> Column:
    """1..10 for ``(lower, upper]`` bins; null at 0 or outside [0, 1] (counted in the total only)."""
    above = sum((F.when(confidence > e, 1).otherwise(0) for e in BIN_EDGES[1:-1]),
                F.when(confidence > BIN_EDGES[0], 1).otherwise(0))
    return F.when((confidence > 0.0) & (confidence <= 1.0), above)


def reliability_bins(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean confidence and accuracy of each occupied bin."""
    return pairs.groupBy(*by, bin_number(F.col("confidence")).cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg("correct").alias("accuracy"))


def calibration_errors(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected, maximum and average calibration error per group, from at most 11 bin rows each."""
    return _errors(reliability_bins(pairs, by), by)


def weighted_errors(counted: DataFrame, by: Sequence[str], confidence: str = "confidence") -> DataFrame:
    """The same of points (by, confidence, n, hits)."""
    n = F.sum("n")
    return _errors(counted.groupBy(*by, bin_number(F.col(confidence)).cast("bigint").alias("bin")).agg(
        n.alias("n"), (F.sum(F.col(confidence) * F.col("n")) / n).alias("mean_confidence"), (F.sum("hits") / n).alias("accuracy")), by)


def _errors(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("mean_confidence") - F.col("accuracy")))
    return bins.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(gap * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / 10.0).alias("ace"))


def calibration_summary(pairs: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Per task: is there enough data to fit, and is it well calibrated (null when below ten rows)."""
    errors = calibration_errors(pairs, by)
    enough = F.col("n") >= MIN_ROWS_ANALYSE
    return errors.select(
        *by, F.col("n").alias("data_points"), (F.col("n") >= MIN_ROWS_FIT).alias("can_fit"),
        F.when(enough, F.col("ece")).alias("ece"), F.when(enough, F.col("mce")).alias("mce"),
        F.when(enough, F.col("ece") < WELL_CALIBRATED_ECE).alias("is_well_calibrated"))


def negative_log_likelihood(logits: Column, target: Column, temperature: float) -> Column:
    """Cross entropy of a class target under temperature-scaled logits (numerically shifted)."""
    z = F.transform(logits, lambda v: v / temperature)
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return top + F.log(total) - F.get(z, target)


def temperature_scaling(df: DataFrame, logits: str, target: str, grid: Sequence[float],
                        by: Sequence[str] = ()) -> DataFrame:
    """Grid search of the temperature: the mean loss of every candidate in one aggregate, then the best."""
    losses = df.groupBy(*by).agg(*[
        F.avg(negative_log_likelihood(F.col(logits), F.col(target).cast("int"), t)).alias(f"_t{i}")
        for i, t in enumerate(grid)])
    table = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_t{i}").alias("nll"))
                      for i, t in enumerate(grid)])
    return losses.select(*by, F.explode(table).alias("_c")).select(*by, "_c.*")


def best_temperature(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The candidate with the smallest loss (ties: the smaller temperature)."""
    return losses.groupBy(*by).agg(
        F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def fit_platt(pairs: DataFrame, n_rows: int | None = None) -> Row:
    """Slope and intercept for one task's confidences with the customary unit penalty; the number of rows is no longer needed."""
    return fit_logistic(pairs, []).first()


def apply_platt(model: Row, df: DataFrame) -> DataFrame:
    """Add ``calibrated`` from a fitted logistic calibration, as an arithmetic column."""
    return df.withColumn("calibrated", logistic(F.col("confidence"), F.lit(model["slope"]), F.lit(model["intercept"])))


def fit_isotonic(pairs: DataFrame) -> DataFrame:
    """Isotonic calibration of one task, as a table of blocks."""
    return isotonic_blocks(pairs, [])


class Calibrators:
    """Fitted calibrations, one per task that has enough rows; other tasks keep their confidences.

    ``method`` is ``platt`` or ``isotonic``.  The task list is given; all its tasks are fitted together.
    """

    def __init__(self, method: str, tasks: Sequence[str] = ("height", "direction", "breaking"),
                 min_rows: int = MIN_ROWS_FIT):
        self.tasks, self.models = list(tasks), {}
        self.estimator = Calibrator(method=method, groupCols=["task"], minRows=min_rows)
        self.model: CalibratorModel | None = None

    def fit(self, pairs: DataFrame) -> Calibrators:
        """Fit each listed task on its ``(task, confidence, correct)`` rows."""
        self.model = self.estimator.fit(pairs.filter(F.col("task").isin(self.tasks)))
        fitted = {r["task"] for r in self.model.table.select("task").distinct().collect()}
        self.models = {task: self.model for task in self.tasks if task in fitted}
        return self

    def transform(self, pairs: DataFrame) -> DataFrame:
        """Add ``calibrated`` to rows of any task."""
        if self.model is None:
            raise ValueError("not fitted yet")
        return self.model.transform(pairs)


def calibrator_report(pairs: DataFrame, method: str, by: Sequence[str] = ("task",),
                      tasks: Sequence[str] = ("height", "direction", "breaking")) -> DataFrame:
    """Calibration errors before and after fitting ``method``, for the tasks with enough rows."""
    fitted = Calibrators(method, tasks).fit(pairs)
    if not fitted.models:
        raise ValueError(f"no task has the {MIN_ROWS_FIT} rows a calibrator needs")
    counted = points(pairs.filter(F.col("task").isin(list(fitted.models))), list(dict.fromkeys([*by, "task"])))
    after = weighted_errors(fitted.transform(counted), by, "calibrated").select(*by, F.col("ece").alias("ece_after"))
    return weighted_errors(counted, by).select(*by, "n", F.col("ece").alias("ece_before")).join(after, list(by))
