"""Scoring aggregates over prediction rows: accuracy, breakdowns, histograms, recalls, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def accuracy_by(rows: DataFrame, field: str, correct: str = "is_correct", error: str = "error") -> DataFrame:
    """(field, n_total, n_correct, accuracy): error rows and rows with a null or empty key left out."""
    kept = rows.where(F.col(error).isNull() & F.col(field).isNotNull() & (F.col(field).cast("string") != ""))
    n, ok = F.count("*"), F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("bigint"))
    return kept.groupBy(field).agg(n.alias("n_total"), ok.alias("n_correct"), _ratio(ok, n).alias("accuracy"))


def accuracy_breakdowns(rows: DataFrame, fields: list[str], correct: str = "is_correct", error: str = "error") -> DataFrame:
    """(field, value, n_total, n_correct, accuracy) of several fields in one aggregation."""
    kept = rows.where(F.col(error).isNull())
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    long = kept.select(correct, F.inline(pairs)).where("value is not null and value != ''")
    n, ok = F.count("*"), F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("bigint"))
    return long.groupBy("field", "value").agg(n.alias("n_total"), ok.alias("n_correct"), _ratio(ok, n).alias("accuracy"))


def overall_accuracy(rows: DataFrame, correct: str = "is_correct", error: str = "error") -> DataFrame:
    """Two denominators: all rows (errors count as wrong), and rows without error (0 if there are none)."""
    ok = F.coalesce(F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("bigint")), F.lit(0))
    answered = F.count(F.when(F.col(error).isNull(), 1))
    return rows.agg(
        F.count("*").alias("n_total"), answered.alias("n_answered"), ok.alias("n_correct"),
        F.coalesce(_ratio(ok, F.count("*")), F.lit(0.0)).alias("accuracy_all"),
        F.coalesce(_ratio(ok, answered), F.lit(0.0)).alias("accuracy_answered"),
    )


def micro_macro(rows: DataFrame, fold: str, correct: str = "is_correct") -> DataFrame:
    """Accuracy over all rows, and the mean of the folds' accuracies."""
    per = rows.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("bigint")).alias("ok"))
    return per.agg(F.count("*").alias("folds"), _ratio(F.sum("ok"), F.sum("n")).alias("micro"), F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("macro"))


def label_histogram(rows: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """(label, n, percent): every given label, zero-filled; others do not count."""
    return rows.agg(*(F.count(F.when(F.col(label) == x, 1)).alias(x) for x in labels)).select(F.inline(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("n"), F.round(F.coalesce(F.try_divide(F.col(x) * 100.0, sum((F.col(y) for y in labels), F.lit(0))), F.lit(0.0)), 6).alias("percent")) for x in labels))))


def class_recall(rows: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """(label, n_gold, recall): null where the class is absent."""
    hits = [F.struct(F.lit(x).alias("label"), F.count(F.when(F.col(gold) == x, 1)).alias("n_gold"), _ratio(F.count(F.when((F.col(gold) == x) & (F.col(pred) == x), 1)), F.count(F.when(F.col(gold) == x, 1))).alias("recall")) for x in labels]
    return rows.agg(F.array(*hits).alias("rows")).select(F.inline("rows"))


def value_counts(rows: DataFrame, field: str, name: str = "n") -> DataFrame:
    """Number of rows of each value, nulls as "unknown"."""
    return rows.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias(field)).agg(F.count("*").alias(name))


def split_reason_counts(rows: DataFrame, reasons: str, sep: str = "|") -> DataFrame:
    """(reason, n) of a column of joined reasons."""
    each = rows.select(F.explode(F.split(F.col(reasons), rf"\{sep}")).alias("reason")).where("reason != ''")
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def compare_predictions(rows: DataFrame, by: str, gold: str, first: str, second: str) -> DataFrame:
    """Both predictions' accuracies side by side, by a field and over all ("all")."""
    a, b = (F.sum(F.coalesce((F.col(p) == F.col(gold)).cast("bigint"), F.lit(0))) for p in (first, second))
    grouped = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("whole"), F.count("*").alias("n"), a.alias("a"), b.alias("b"))
    key = F.when(F.col("whole") == 1, "all").otherwise(F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
    return grouped.select(key.alias(by), "n", _ratio(F.col("a"), F.col("n")).alias("accuracy_first"), _ratio(F.col("b"), F.col("n")).alias("accuracy_second"))


def changed_labels(rows: DataFrame, before: str, after: str, labels: list[str]) -> DataFrame:
    """(label, n_before, n_after) with the number of changed rows."""
    moved = F.count(F.when(~F.col(before).eqNullSafe(F.col(after)), 1))
    return rows.agg(moved.alias("changed"), F.array(*(F.struct(F.lit(x).alias("label"), F.count(F.when(F.col(before) == x, 1)).alias("n_before"), F.count(F.when(F.col(after) == x, 1)).alias("n_after")) for x in labels)).alias("rows")).select("changed", F.inline("rows"))


def run_summary(rows: DataFrame, duration: str, words: str, elapsed: str) -> DataFrame:
    """Sums, the mean of real-time factors (a mean of ratios) and words a minute (a ratio of sums)."""
    d, w = F.sum(duration), F.sum(words)
    return rows.agg(F.count("*").alias("n"), F.round(d, 6).alias("duration_sec"), w.alias("words"), F.round(F.avg(F.try_divide(F.col(elapsed), F.col(duration))), 6).alias("mean_rt_factor"), F.round(F.try_divide(w * 60.0, d), 6).alias("words_per_minute"))


def leaderboard(logs: DataFrame, run: str, step: str, gap: str, loss: str) -> DataFrame:
    """Of each run: steps, last step with its loss, and the step of the smallest absolute gap (first of ties)."""
    return logs.groupBy(run).agg(
        F.count("*").alias("n_logs"), F.max(step).alias("last_step"), F.max_by(loss, step).alias("last_loss"),
        F.min_by(step, F.when(F.col(gap).isNotNull(), F.struct(F.abs(gap), F.col(step)))).alias("best_step"),
    )
