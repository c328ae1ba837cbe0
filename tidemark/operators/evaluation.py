"""Scoring a multi-task model's predictions against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_percentiles, null_safe_join

# Fixed values of the scoring rules.
TIGHT_M, LOOSE_M = 0.2, 0.5            # height tolerance in metres
EXTREME_LOW_M, EXTREME_HIGH_M = 0.5, 8.0
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.5, 0.8


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """``part / whole``, or ``default`` where ``whole`` is zero or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(default))


def extreme(height: Column, low: float = EXTREME_LOW_M, high: float = EXTREME_HIGH_M) -> Column:
    """Outside the ordinary height range (the bounds differ between labels and predictions)."""
    return (height < low) | (height > high)


def regression_metrics(df: DataFrame, by: Sequence[str] = (), *, truth: str = "h_true", pred: str = "h_pred",
                       extra: dict[str, Column] | None = None, bounded_keys: bool = False) -> DataFrame:
    """Error statistics of a numeric prediction, one row per group.

    One map-side-combined aggregate, plus exact median and 95th percentile of
    the absolute error from value counts.  ``extra`` adds aggregates of the
    scored rows to the same pass.
    """
    t, p = F.col(truth), F.col(pred)
    scored = df.filter(t.isNotNull() & p.isNotNull()) \
        .withColumns({"_t": t, "_p": p, "abs_error": F.abs(p - t)})
    err = F.col("abs_error")
    is_extreme = extreme(F.col("_t"))
    found = is_extreme & extreme(F.col("_p"))
    main = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(err).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - ratio(F.sum(err * err), F.count("*") * F.var_pop("_t"))).alias("r2"),
        (100 * ratio(F.count_if(err <= TIGHT_M), F.count("*"))).alias("within_02_pct"),
        (100 * ratio(F.count_if(err <= LOOSE_M), F.count("*"))).alias("within_05_pct"),
        F.when(F.count_if(is_extreme) == 0, F.lit(100.0))
         .otherwise(100 * ratio(F.count_if(found), F.count_if(is_extreme))).alias("extreme_detection_pct"),
        *[c.alias(name) for name, c in (extra or {}).items()])
    spread = exact_percentiles(scored.select(*by, "abs_error"), by, "abs_error", {"median_abs_error": 0.5, "p95_abs_error": 0.95},
                               bounded_keys=bounded_keys)
    if not by:
        return main.withColumn("_k", F.lit(1)).join(F.broadcast(spread.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return null_safe_join(main, spread, list(by))


def classification_metrics(df: DataFrame, classes: Sequence[int], *, truth: str, pred: str,
                           by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision, recall, F1 and support over the full class domain, plus accuracy and macro F1.

    All classes are counted in one pass (three conditional counts each), so the
    shuffle carries one row per task and group whatever the number of rows.
    """
    scored = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    counts = [F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("hits")]
    for c in classes:
        counts += [F.count_if((F.col(truth) == c) & (F.col(pred) == c)).alias(f"_tp{c}"),
                   F.count_if(F.col(pred) == c).alias(f"_pp{c}"),
                   F.count_if(F.col(truth) == c).alias(f"_ap{c}")]
    one = scored.groupBy(*by).agg(*counts)

    def f1(c: int) -> Column:
        return ratio(2 * F.col(f"_tp{c}"), F.col(f"_pp{c}") + F.col(f"_ap{c}"))

    per_class = F.array(*[F.struct(
        F.lit(int(c)).cast("bigint").alias("class"),
        ratio(F.col(f"_tp{c}"), F.col(f"_pp{c}")).alias("precision"),
        ratio(F.col(f"_tp{c}"), F.col(f"_ap{c}")).alias("recall"),
        f1(c).alias("f1"), F.col(f"_ap{c}").alias("support")) for c in classes])
    macro = sum((f1(c) for c in classes[1:]), f1(classes[0])) / F.lit(float(len(classes)))
    return one.select(*by, ratio(F.col("hits"), F.col("n")).alias("accuracy"), macro.alias("macro_f1"),
                      F.explode(per_class).alias("_c")).select(*by, "accuracy", "macro_f1", "_c.*")


def confusion_matrix(df: DataFrame, classes: Sequence[int], *, truth: str, pred: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix ``(by, target, predicted, n)`` with the empty cells."""
    cells = [(t, p) for t in classes for p in classes]
    one = df.groupBy(*by).agg(*[
        F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"_c{t}_{p}") for t, p in cells])
    rows = F.array(*[F.struct(F.lit(int(t)).cast("bigint").alias("target"),
                              F.lit(int(p)).cast("bigint").alias("predicted"),
                              F.col(f"_c{t}_{p}").alias("n")) for t, p in cells])
    return one.select(*by, F.explode(rows).alias("_c")).select(*by, "_c.*")


def overall_score(df: DataFrame) -> DataFrame:
    """Both published overall scores from ``within_02_pct``, ``direction_acc`` and ``breaking_acc``.

    ``as_published`` mixes a percentage with two ratios; ``ratio`` uses ratios throughout.
    """
    return df.withColumns({
        "as_published": 0.4 * F.col("within_02_pct") + 0.3 * F.col("direction_acc") + 0.3 * F.col("breaking_acc"),
        "ratio": 0.5 * (F.col("within_02_pct") / 100) + 0.25 * F.col("direction_acc") + 0.25 * F.col("breaking_acc")})


def accuracies() -> dict[str, Column]:
    """Shares of right directions and breaking types, as aggregates."""
    n = F.count("*")
    return {"direction_acc": ratio(F.count_if(F.col("d_pred") == F.col("d_true")), n),
            "breaking_acc": ratio(F.count_if(F.col("b_pred") == F.col("b_true")), n)}


def accuracy_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-pass summary the overall score needs: height tolerance share and both class accuracies."""
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(F.col("h_pred") - F.col("h_true"))).alias("mae"),
        (100 * ratio(F.count_if(F.abs(F.col("h_pred") - F.col("h_true")) <= TIGHT_M), n)).alias("within_02_pct"),
        *[c.alias(name) for name, c in accuracies().items()])


def compare_models(reports: DataFrame) -> DataFrame:
    """Best model per metric and the change from the first to the last report.

    ``reports`` is ``(model, ts, metric, value, higher_is_better)``; ties go to the smaller model name.
    """
    signed = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    return reports.groupBy("metric").agg(
        F.min_by("model", F.struct(signed, F.col("model"))).alias("best_model"),
        F.min_by("value", F.struct(signed, F.col("model"))).alias("best_value"),
        (F.max_by("value", F.struct("ts", "model")) - F.min_by("value", F.struct("ts", "model"))).alias("change"))


def failure_cases(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of low- and high-confidence predictions and the mean confidences."""
    worst = F.least("conf_d", "conf_b")
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"), F.count_if(worst < LOW_CONFIDENCE).alias("failures"),
        ratio(F.count_if((F.col("conf_d") > HIGH_CONFIDENCE) & (F.col("conf_b") > HIGH_CONFIDENCE)), n)
        .alias("high_quality_share"),
        F.avg("conf_d").alias("mean_conf_d"), F.avg("conf_b").alias("mean_conf_b"))


def failure_rows(df: DataFrame, ident: str) -> DataFrame:
    """The failing rows of ``failure_cases`` with the reason: a confidence under the bound, or none at all."""
    worst = F.least("conf_d", "conf_b")
    missing = F.col("conf_d").isNull() | F.col("conf_b").isNull()
    reason = F.when(missing, "analysis_error").when(worst < LOW_CONFIDENCE, "low_confidence")
    quality = F.when(~missing & (worst > HIGH_CONFIDENCE), "high").otherwise("low")
    return df.select(ident, reason.alias("reason"), "conf_d", "conf_b", "h_pred", quality.alias("prediction_quality")).filter("reason is not null")


def brier(df: DataFrame, task_columns: dict[str, tuple[str, str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Brier score per task: mean squared gap between confidence and correctness."""
    def gap(truth: str, pred: str, conf: str) -> Column:
        hit = F.when(F.col(truth) == F.col(pred), 1.0).otherwise(0.0)
        return F.avg((F.col(conf) - hit) * (F.col(conf) - hit))
    return df.groupBy(*by).agg(*[gap(*cols).alias(f"brier_{task}") for task, cols in task_columns.items()])


def ensemble(df: DataFrame, item: str, votes: Sequence[str], means: dict[str, str]) -> DataFrame:
    """Mean of numeric outputs and majority vote of class outputs per item; labels keep their type, ties go to the smallest.

    Votes are counted per ``(item, task, label)`` first, so the item with most
    models is never gathered in one place.
    """
    kinds = {v: df.schema[v].dataType for v in votes}
    task = F.array(*[F.struct(F.lit(i).alias("task"), *[(F.col(w) if w == v else F.lit(None).cast(kinds[w])).alias(f"_v{j}")
                                                        for j, w in enumerate(votes)]) for i, v in enumerate(votes)])
    labels = [f"_v{j}" for j in range(len(votes))]
    counted = df.select(item, F.inline(task)).groupBy(item, "task", *labels).agg(F.count("*").alias("n"))
    won = counted.groupBy(item).agg(*[
        F.min_by(label, F.when(F.col("task") == j, F.struct(-F.col("n"), F.col(label).isNull(), F.col(label)))).alias(v)
        for j, (v, label) in enumerate(zip(votes, labels))])
    averaged = df.groupBy(item).agg(*[F.avg(c).alias(o) for o, c in means.items()],
                                    F.count("*").alias("num_models"))
    return averaged.join(won, item)


def readiness(df: DataFrame) -> DataFrame:
    """Deployment gate on ``r2``, both accuracies and ``latency_ms``; lists what is missing."""
    issues = F.array_compact(F.array(
        F.when(F.col("r2") < 0.7, F.lit("height r2 below 0.7")),
        F.when(F.col("direction_acc") < 0.8, F.lit("direction accuracy below 0.8")),
        F.when(F.col("breaking_acc") < 0.8, F.lit("breaking accuracy below 0.8")),
        F.when(F.col("latency_ms") > 1000, F.lit("latency above 1 s"))))
    return df.withColumn("issues", issues).withColumn("ready", F.size("issues") == 0)


def batch_stats(df: DataFrame, by: Sequence[str], *, ok: Column, millis: str, confidence: str) -> DataFrame:
    """Counts, success rate, time statistics and throughput of processed batches."""
    n, good = F.count("*"), F.count_if(ok)
    t = F.when(ok, F.col(millis))
    return df.groupBy(*by).agg(
        n.alias("n"), good.alias("ok"), (n - good).alias("failed"), ratio(good, n).alias("success_rate"),
        F.avg(t).alias("mean_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"),
        F.stddev_pop(t).alias("std_ms"), F.avg(F.when(ok, F.col(confidence))).alias("mean_confidence"),
        ratio(n * 1000, F.sum(millis)).alias("per_second"))
