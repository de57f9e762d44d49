"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from .common import bucket, slices, smallest_hashes, texts_of, written

SIZES = (3, 4, 5)
BITS = 18
SCHEMA = "doc_id long, score double"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    features: int = 1024      # n-grams that a score may use: those whose ratio is surest
    toxic_weight: float = 2.0  # of a toxic row in the loss, a clean one counting 1
    smoothing: float = 1.0    # added to the counts of both classes
    penalty: float = 1e-3     # of the squared weights
    rounds: int = 25
    rows: int = 20_000        # labelled rows of each class that are learned from, about


@dataclass(frozen=True)
class Model:
    """Bias and the weight of each n-gram bucket, the log-count ratio already multiplied in."""

    bias: float
    weights: np.ndarray


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of the whole text in lower case, white space as one kind of character."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), np.uint64(32), codes)
    out, rolled = [], codes
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        if n in SIZES:
            out.append(((rolled + np.uint64(n)) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


def present(text: str | None, chosen: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets that a text has, of the chosen ones."""
    found = grams(text or "")
    return np.unique(found if chosen is None else found[chosen[found]])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label, present(text)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], ["bucket", "clean", "toxic"])


def labelled(docs: DataFrame, labels: DataFrame, use: Column, most: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """`text` and `label` of about `most` rows of each class whose id has a label and is to be used, their numbers and the part of the class
    that they are. Of several labels of an id the largest counts.

    Ids are taken by their hash until about `most` of a class are left; that list, bounded so, is sent to the tasks that read the texts. Where
    ids repeat in `docs` the rows are thinned to the same bound. No text is shuffled.
    """
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(use).groupBy("doc_id").agg(F.max("label").alias("label")))

    def by_label(df: DataFrame) -> dict[int, int]:
        return {r.label: r.n for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def part_of(seen: dict[int, int]) -> dict[int, float]:
        return {label: min(1.0, most / max(1, n)) for label, n in seen.items()}

    ids = part_of(by_label(marks))
    at = lambda parts: F.when(F.col("label") == 1, F.lit(parts.get(1, 1.0))).otherwise(F.lit(parts.get(0, 1.0)))
    wanted = F.when(F.col("label") == 1, smallest_hashes(F.col("doc_id"), ids.get(1, 1.0))).otherwise(smallest_hashes(F.col("doc_id"), ids.get(0, 1.0)))
    known = F.broadcast(written(marks.filter(wanted), "toxicity-ids"))
    rows = part_of(by_label(docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id")))
    taken = written(texts_of(docs).join(known, "doc_id").filter(F.rand(17) < at(rows)).select("text", "label"), "toxicity-labelled")
    return taken, by_label(taken), {label: ids.get(label, 1.0) * rows.get(label, 1.0) for label in (0, 1)}


def _objective(rows: DataFrame, n: float, size: int, theta: np.ndarray, penalty: float, clean_weight: float, toxic_weight: float) -> tuple[float, np.ndarray]:
    """Mean weighted logistic loss with penalty and its gradient, added up over all rows by Spark; `size` + 2 rows come back."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            lists, label = batch.column("at"), batch.column("label").to_numpy(zero_copy_only=False)
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(label)), lengths)
            values = batch.column("ratio").flatten().to_numpy(zero_copy_only=False)
            margin = theta[size] + np.bincount(owner, theta[flat] * values, len(label))
            weight = np.where(label == 1, toxic_weight, clean_weight)
            total[size + 1] += (weight * np.logaddexp(0.0, np.where(label == 1, -margin, margin))).sum()
            error = weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - label)
            total[:size] += np.bincount(flat, error[owner] * values, size)
            total[size] += error.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], ["k", "v"])

    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size + 2)
    for r in got:
        total[r.k] = r.v
    held = np.r_[theta[:size], 0.0]
    return total[size + 1] / n + penalty / 2 * (held @ held), total[: size + 1] / n + penalty * held


def _minimize(evaluate, theta: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; an evaluation is a pass over the rows."""
    value, slope = evaluate(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, held = -slope, []
        for s, y in reversed(past):
            held.append((s @ step) / (s @ y))
            step = step - held[-1] * y
        if past:
            step = step * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        else:
            step = step / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(past, reversed(held)):
            step = step + (a - (y @ step) / (s @ y)) * s
        if slope @ step >= 0 or np.abs(slope).max() < 1e-5:
            break
        size = 1.0
        while size > 1e-4:
            at = theta + size * step
            value_at, slope_at = evaluate(at)
            if value_at <= value + 1e-4 * size * (slope @ step):
                break
            size /= 4
        else:
            break
        if (at - theta) @ (slope_at - slope) > 1e-12:
            past = [*past[-7:], (at - theta, slope_at - slope)]
        gain, theta, value, slope = value - value_at, at, value_at, slope_at
        if gain < 1e-5 * max(value, 1e-3):
            break
    return theta


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, training: Training = Training()) -> Model:
    """The classifier of the labelled rows of `docs` that `use` (a condition on `doc_id`) allows, about `training.rows` of each class at most.

    Where a class is larger, its rows stand for all of it in the loss. Spark counts in how many clean and toxic texts each n-gram bucket occurs (2^18 rows reach the driver at most), the surest ratios are
    chosen, and the loss is minimised by passes over a table of the chosen n-grams of each labelled text. Without rows of both classes the
    model is the smoothed share of toxic rows.
    """
    rows, seen, part = labelled(docs, labels, F.lit(True) if use is None else use, training.rows)
    clean, toxic = (seen.get(k, 0) / part[k] for k in (0, 1))
    bias, weights = float(np.log((toxic + 1) / (clean + 1))), np.zeros(1 << BITS)
    if not clean or not toxic:
        return Model(bias, weights)
    counts = rows.mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    a, b = counts["toxic"].to_numpy() + training.smoothing, counts["clean"].to_numpy() + training.smoothing
    ratio = np.log(a / a.sum()) - np.log(b / b.sum())
    sure = np.abs(ratio) / np.sqrt(1 / a + 1 / b)
    order = np.lexsort((counts["bucket"].to_numpy(), -sure))[: training.features]
    chosen, ratio = counts["bucket"].to_numpy()[order], ratio[order]
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = [place[present(t, place >= 0)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array([ratio[x] for x in at], pa.list_(pa.float64()))],
                                             ["label", "at", "ratio"])

    picked = written(rows.mapInArrow(pick, "label int, at array<int>, ratio array<double>"), "toxicity-features")
    n = clean + training.toxic_weight * toxic
    theta = _minimize(lambda t: _objective(picked, n, len(chosen), t, training.penalty, 1 / part[0], training.toxic_weight / part[1]), np.r_[np.zeros(len(chosen)), bias], training.rounds)
    weights[chosen] = theta[: len(chosen)] * ratio
    return Model(float(theta[len(chosen)]), weights)


def score_text(text: str | None, model: Model, chosen: np.ndarray) -> float:
    margin = model.bias + model.weights[present(text, chosen)].sum()
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id` and the toxicity, 0 to 1, of every whole text; one row for each row of `docs`. A null text scores as an empty one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = model.weights != 0
        for batch in slices(batches):
            scores = [score_text(t, model, chosen) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, that score below the limit."""
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        chosen = model.weights != 0
        return pd.Series([score_text(t, model, chosen) < limit for t in text], dtype=bool)

    return docs.filter(clean(F.col("text").cast("string")))


def not_held_out(folds: int = 3, out: int = 1) -> Column:
    return bucket(F.col("doc_id"), folds) != out
