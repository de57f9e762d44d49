"""How five document filters interact: losses at every step of every order, from a contingency tensor per part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .common import UPPER, slices, texts_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Fixed values of the filters.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
FACTS = "doc_id long, part string, digest binary, failed int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

#: Along an axis of the tensor: documents that pass, that fail, all.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def failures(text: bytes) -> int:
    """Bit k is set when filter k of A to D fails."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    upper = len(text) - len(text.translate(None, UPPER.encode()))
    return (
        (len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def facts(docs: DataFrame) -> DataFrame:
    """Per row its part, a digest of its text and the filters A to D that it fails."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.compute.fill_null(batch.column("lang"), ""), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                 pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "failed"])

    return texts_of(docs, "lang").mapInArrow(run, FACTS)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each part by the set of filters that they fail: `n`, and of these `good` and `toxic` ones.

    Filter E fails where a smaller doc_id has the same text anywhere in the table. Rows are counted by text, part and labels before the
    smallest id of a text is sought, so that a text which holds a third of all rows is a handful of rows by then.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
                          F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marks = marks.filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    kind = ["digest", "part", "failed", "good", "toxic"]
    rows = facts(docs).join(marks, "doc_id", "left").fillna(False, ["good", "toxic"]).groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    same = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"),
                                   F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first").over(Window.partitionBy("digest"))  # a few rows for each part: kinds of one text
    fresh = F.col("unnamed") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    split = same.withColumn("least", least).withColumn("fresh", fresh).select(
        "part", "good", "toxic", F.inline(F.array(F.struct(F.col("failed").alias("cell"), F.col("fresh").alias("n")),
                                                  F.struct((F.col("failed") + 16).alias("cell"), (F.col("n") - F.col("fresh")).alias("n")))))
    count = lambda mark: F.sum(F.when(mark, F.col("n")).otherwise(0)).alias
    return split.groupBy("part", "cell").agg(F.sum("n").alias("n"), count(F.col("good"))("good"), count(F.col("toxic"))("toxic"))


def selectors() -> dict[str, np.ndarray]:
    """By measure, what each step of each order selects along each axis: order and step, axis, (pass, fail)."""
    out: dict[str, list] = {"kept": [], "removed": [], "failed": [], "alone": []}
    for order in ORDERS:
        for step, name in enumerate(order):
            done = order[:step]
            out["kept"].append([PASS if f in done or f == name else ALL for f in FILTERS])
            out["removed"].append([PASS if f in done else FAIL if f == name else ALL for f in FILTERS])
            out["failed"].append([FAIL if f == name else ALL for f in FILTERS])
            out["alone"].append([FAIL if f == name else PASS for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in out.items()}


SELECT = selectors()


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of a 2x2x2x2x2 tensor, one for each row of selections."""
    return np.einsum("abcde,sa,sb,sc,sd,se->s", tensor, *(chosen[:, k] for k in range(5)))


def steps(part: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders of one part from its counts, 32 rows at most."""
    total, good, toxic = np.zeros((3, 32), np.int64)
    at = part["cell"].to_numpy()
    total[at], good[at], toxic[at] = part["n"], part["good"], part["toxic"]
    # Bit k of a cell is filter k; the last axis of a reshaped array is the lowest bit.
    total, good, toxic = (x.reshape((2,) * 5).transpose(4, 3, 2, 1, 0) for x in (total, good, toxic))
    out = pd.DataFrame({"part": part["part"].iloc[0], "filter_order": np.repeat(ORDERS, 5), "step": np.tile(np.arange(1, 6), len(ORDERS))})
    out["kept"], out["removed"] = contract(total, SELECT["kept"]), contract(total, SELECT["removed"])
    out["redundant"] = contract(total, SELECT["failed"]) - out["removed"]
    out["unique_fails"] = contract(total, SELECT["alone"])
    out["good_lost"], out["toxic_lost"] = contract(good, SELECT["removed"]), contract(toxic, SELECT["removed"])
    name = np.array([f for order in ORDERS for f in order])
    out["shapley"] = out.groupby(name)["removed"].transform("sum")
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Losses of the filters A to E at each step of all 120 orders, by part (`lang`; null: the empty string).

    Each row of `docs` is a document: repeated rows count each; of the rows of one text those with the smallest doc_id pass E, also where
    that id repeats, and so do rows without an id. A null text is empty, and empty texts are identical. Several labels of one id count as
    good or toxic if one of them says so; rows without id have no labels. No documents: no rows. Texts stay in the task that reads them;
    ids, digests and bits are shuffled. Other columns are not read, whatever their names.
    """
    return cells(docs, labels).groupBy("part").applyInPandas(steps, RESULT)


def audit_sql(separators: str = r"[^\x20\x09-\x0D]+") -> str:
    """DuckDB SQL for `audit` over the tables `documents` and `labels`."""
    return rf"""WITH flat AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '{separators}') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM flat),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{
  'A': len(w) < {MIN_WORDS}, 'B': 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)}} AS f FROM words LEFT JOIN marks USING (doc_id)),
bits AS (SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS f, count(*) AS n FROM flags GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, k AS step FROM orders, letters),
judged AS (SELECT part, filter_order, step, o[step] AS k, good, toxic, n, f[o[step]] AS fails,
  list_bool_or(list_transform(list_slice(o, 1, step - 1), lambda i: f[i])) AS earlier, len(list_filter(f, lambda x: x)) AS failures FROM bits, steps),
counted AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT fails AND NOT coalesce(earlier, false) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails AND NOT coalesce(earlier, false) THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND coalesce(earlier, false) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT coalesce(earlier, false) AND good THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails AND NOT coalesce(earlier, false) AND toxic THEN n ELSE 0 END) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM counted"""
