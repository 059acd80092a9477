"""Classification quality, all from sums per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions.scorers import Share
from opinarium.session import materialize


def confusion(scored: DataFrame, by: Sequence[str] = ("model", "split"), truth: str = "polarity", predicted: str = "pred_label") -> DataFrame:
    """Counts of the four outcomes per group; rows lacking either label drop."""
    y, p = F.col(truth), F.col(predicted)
    return (
        scored.filter(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count_if((y == 0) & (p == 0)).alias("tn"),
            F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"),
            F.count_if((y == 1) & (p == 1)).alias("tp"),
        )
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return Share.ratio(top, bottom)


def _f1(hits: Column, wrong: Column) -> Column:
    return _ratio(hits * 2, hits * 2 + wrong)


def class_report(matrix: DataFrame, by: Sequence[str] = ("model", "split"), decimals: int = 4) -> DataFrame:
    """Precision, recall and F1 of both classes, macro-F1, accuracy, hard-label
    AUC and supports; what is undefined is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    wrong = fp + fn

    def shown(value: Column, name: str) -> Column:
        return F.round(value, decimals).alias(name)

    return matrix.select(
        *by,
        shown(_ratio(tn, tn + fn), "precision_negative"),
        shown(_ratio(tn, tn + fp), "recall_negative"),
        shown(_f1(tn, wrong), "f1_negative"),
        (tn + fp).alias("support_negative"),
        shown(_ratio(tp, tp + fp), "precision_positive"),
        shown(_ratio(tp, tp + fn), "recall_positive"),
        shown(_f1(tp, wrong), "f1_positive"),
        (tp + fn).alias("support_positive"),
        shown((_f1(tn, wrong) + _f1(tp, wrong)) / 2, "f1_macro"),
        shown(_ratio(tn + tp, tn + fp + fn + tp), "accuracy"),
        shown(hard_auc(), "auc_hard"),
    )


def hard_auc() -> Column:
    """Area under the curve of hard labels: the mean of both recalls; null when
    a class is absent."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (F.try_divide(tp.cast("double"), tp + fn) + F.try_divide(tn.cast("double"), tn + fp)) / 2


def auc(scored: DataFrame, by: Sequence[str] = ("model", "split"), truth: str = "polarity", score: str = "pred_prob") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a class is
    absent.

    Outcomes are summed per distinct score and laid out in score ranges. How
    many negatives lie below a score is a running sum in two levels: over the
    ranges, then inside one, so no window spans a whole group. The layout is
    written out, which fixes the ranges for both levels.
    """
    keys = list(by)
    y = F.col(truth)
    per_score = (
        scored.filter(y.isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("_score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
        .repartitionByRange(*keys, "_score")
        .withColumn("_range", F.spark_partition_id())
    )
    ranged = materialize(per_score, "scores")
    upto = Window.partitionBy(*keys).orderBy("_range")
    totals = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("neg").alias("_neg"))
        .select(*keys, "_range", (F.sum("_neg").over(upto) - F.col("_neg")).alias("_before"))
    )
    inside = F.sum("neg").over(Window.partitionBy(*keys, "_range").orderBy("_score")) - F.col("neg")
    area = F.col("pos") * (F.col("_before") + F.col("_inside") + F.col("neg") * 0.5)
    sums = (
        ranged.withColumn("_inside", inside)
        .join(totals, [*keys, "_range"])
        .groupBy(*keys)
        .agg(F.sum(area).alias("_area"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    )
    return sums.select(*keys, F.try_divide(F.col("_area"), F.col("_pos") * F.col("_neg").cast("double")).alias("auc"))


def with_overall(counts: DataFrame, split: str = "split", keep: Sequence[str] = ()) -> DataFrame:
    """Per-split counts plus a row of their sums named ``overall``."""
    sums = [c for c in counts.columns if c not in (split, *keep)]
    return (
        counts.rollup(*keep, split)
        .agg(F.grouping(split).alias("_all"), *[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("_level"))
        .filter(F.col("_level") <= 1)
        .withColumn(split, F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(split)))
        .drop("_all", "_level")
    )


def prediction_counts(predictions: DataFrame, split: str = "split") -> DataFrame:
    """Total, successful and failed predictions per split and overall."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    counts = predictions.groupBy(split).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"))
    return with_overall(counts, split).select(
        split,
        "total",
        "ok",
        (F.col("total") - F.col("ok")).alias("failed"),
        F.round(_ratio((F.col("total") - F.col("ok")) * 100, F.col("total")), 1).alias("failed_pct"),
    )


def usage_stats(predictions: DataFrame, split: str = "split") -> DataFrame:
    """Mean tokens and response times of successful predictions, per split and
    overall."""
    ok = predictions.filter(F.coalesce(F.col("error"), F.lit("")) == "")
    names = ("input_tokens", "output_tokens", "response_time_s")
    sums = ok.groupBy(split).agg(
        *[F.sum(n).alias(f"{n}_sum") for n in names], *[F.count(n).alias(f"{n}_n") for n in names]
    )
    whole = with_overall(sums, split)

    def mean(name: str, decimals: int) -> Column:
        return F.round(F.try_divide(F.col(f"{name}_sum").cast("double"), F.col(f"{name}_n")), decimals)

    return whole.select(
        split,
        mean("input_tokens", 2).alias("avg_input_tokens"),
        mean("output_tokens", 2).alias("avg_output_tokens"),
        mean("response_time_s", 4).alias("avg_response_time_s"),
        F.round("response_time_s_sum", 2).alias("total_response_time_s"),
    )


def evaluate_predictions(predictions: DataFrame, truth: str = "true_polarity", predicted: str = "predicted_polarity", split: str = "split") -> DataFrame:
    """Quality, usage and failures per split and overall."""
    ok = predictions.filter(F.coalesce(F.col("error"), F.lit("")) == "")
    matrix = with_overall(confusion(ok, (split,), truth, predicted), split)
    report = class_report(matrix, (split,))
    return prediction_counts(predictions, split).join(report, split, "left").join(usage_stats(predictions, split), split, "left")


def cohens_kappa(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Observed and chance agreement of two annotators and kappa."""
    cells = (
        pairs.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(F.col(first).alias("a"), F.col(second).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    margins = (
        cells.select(F.inline(F.array(
            F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")),
            F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")),
        )))
        .groupBy("label")
        .agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    )
    chance = margins.agg(F.sum(F.col("x").cast("double") * F.col("y"))).scalar()
    return (
        cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
        .select((F.col("same") / F.col("n")).alias("po"), (chance / (F.col("n") * F.col("n"))).alias("pe"))
        .withColumn("kappa", F.try_divide(F.col("po") - F.col("pe"), F.lit(1.0) - F.col("pe")))
    )
