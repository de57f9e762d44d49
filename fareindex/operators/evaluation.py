"""Quality of detector flags against labelled steps."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(steps: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 and false-positive rate; empty denominators give 0."""
    a, p = F.col(actual), F.col(predicted)
    counts = steps.groupBy(*by).agg(
        F.count_if(a & p).alias("true_positive"), F.count_if(~a & ~p).alias("true_negative"),
        F.count_if(~a & p).alias("false_positive"), F.count_if(a & ~p).alias("false_negative"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    rates = counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "false_positive_rate": _ratio(fp, fp + tn)}
    )
    f1 = _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rates.withColumn("f1_score", f1)


def detection_delay(steps: DataFrame, step: str = "step", actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Steps from the first actual event to the first flag at or after it; null when there is none.

    Steps are numbered without gaps.
    """
    by = list(by)
    event = steps.groupBy(*by).agg(F.min(F.when(F.col(actual), F.col(step))).alias("event_step"))
    if by:
        rows = steps.join(event, by)
    else:
        rows = steps.withColumn("event_step", event.select("event_step").scalar())
    hit = F.min(F.when(F.col(predicted) & (F.col(step) >= F.col("event_step")), F.col(step)))
    return rows.groupBy(*by).agg((hit - F.min("event_step")).alias("detection_delay"))


def prediction_stability(first: DataFrame, second: DataFrame, keys: Sequence[str], predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Share of equal flags in two runs over the same steps."""
    again = second.select(*keys, F.col(predicted).alias("_again"))
    return first.join(again, list(keys)).groupBy(*by).agg(F.avg((F.col(predicted) == F.col("_again")).cast("double")).alias("stability"))


def evaluate_detector(
    steps: DataFrame, detector: str, keys: Sequence[str], repeated: DataFrame | None = None, step: str = "step",
    by: Sequence[str] = (), dataset_version: str = "synthetic-v1",
) -> DataFrame:
    """One row per group with all of the above; ``by`` must name at least one column."""
    by = list(by)
    result = classification(steps, by=by).join(detection_delay(steps, step, by=by), by)
    size = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"))
    result = result.join(size, by)
    if repeated is None:
        result = result.withColumn("stability", F.lit(1.0))
    else:
        result = result.join(prediction_stability(steps, repeated, keys, by=by), by)
    return result.withColumns({"detector": F.lit(detector), "dataset_version": F.lit(dataset_version)})
