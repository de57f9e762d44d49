"""Language-model scoring: the probability of a text over all its segmentations into pieces, beside a word model as base."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from .common import commonest, slices, texts_of, written
from .lattice import by_length
from .sentencepiece_codec import SPACE, Pieces, load_pieces

FLUSH = 300_000
CACHE_ENTRIES = 400_000
LONG = 64  # longer strings advance one by one, the others together with those of their length
LOG10 = np.log(10.0)
SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
          "rest array<struct<word: string, n: long>>")


@dataclass(frozen=True)
class Training:
    rounds: int = 1               # passes of expected counts over the training words
    smoothing: float = 0.5        # added to the expected count of every piece
    head_words: int = 200_000     # the commonest training words, whose counts go to every task; the others are joined


@dataclass(frozen=True)
class LatticeModel:
    """Natural logarithms of the piece probabilities, by id, and of the end of a text."""

    log_p: np.ndarray
    end: float
    key: str


def vocabulary_weights(pieces: Pieces) -> np.ndarray:
    """Log-probabilities from the vocabulary's own scores, which are negative ranks: shares fall with the rank as word frequencies do.

    Pieces of forbidden score and byte pieces stand behind the last rank; special pieces have no share.
    """
    ranks = -pieces.scores[:-1]
    normal = np.array(sorted(i for i, _ in pieces.id_of.values()), np.int64)
    last = ranks[normal][ranks[normal] < 1e8].max(initial=0.0) + 1
    weight = np.zeros(len(ranks))
    weight[normal] = 1 / (np.where(ranks[normal] < 1e8, ranks[normal], last) + 2.7)
    weight[list(pieces.byte_id.values())] = 1 / (last + 2.7)
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def _arcs(pieces: Pieces, log_p: np.ndarray, strings: list[str], codes: np.ndarray, places: np.ndarray):
    """Per start and length: rows that have an arc there, its piece (-1: bytes) and its log-probability; in order of starts."""
    found = pieces.trie.matches(codes)
    size = codes.shape[1]
    for s in range(size):
        for k, at_k in enumerate(found[: size - s], 1):
            piece = at_k[:, s]
            rows = np.flatnonzero(piece >= 0)
            yield s, k, rows, piece[rows], log_p[piece[rows]]
            if k == 1 and len(rows) < len(piece):
                bare = np.flatnonzero(piece < 0)
                value = np.array([log_p[pieces.unmatched(strings[places[r]][s])].sum() for r in bare.tolist()])
                yield s, 1, bare, None, value


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top if len(terms) == 1 or top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


class _LongString:
    """The lattice of one long string, walked in plain Python: a window of as many values as the longest piece has characters."""

    def __init__(self, pieces: Pieces, log_p: list[float], string: str):
        self.pieces, self.log_p, self.string = pieces, log_p, string
        self.bare: dict[str, tuple[list[int], float]] = {}

    def arcs(self, s: int) -> list[tuple[int, list[int], float]]:
        """Length, pieces (several: bytes) and log-probability of every arc that starts at a place."""
        step, log_p = self.pieces.step, self.log_p
        out, single = [], False
        for k in range(1, min(self.pieces.longest, len(self.string) - s) + 1):
            got = step.get(self.string[s : s + k])
            if got is None:
                break
            if got[0] >= 0:
                single |= k == 1
                out.append((k, [got[0]], log_p[got[0]]))
        if not single:
            char = self.string[s]
            if char not in self.bare:
                ids = self.pieces.unmatched(char)
                self.bare[char] = ids, sum(log_p[i] for i in ids)
            out.append((1, *self.bare[char]))
        return out

    def forward(self) -> Iterator[float]:
        """Log of the summed probability of all segmentations of the first 0, 1, 2, ... characters."""
        width = self.pieces.longest + 1
        due: list[list[float]] = [[] for _ in range(width)]
        due[0].append(0.0)
        for s in range(len(self.string) + 1):
            terms = due[s % width]
            alpha = _log_sum(terms)
            terms.clear()
            yield alpha
            if s < len(self.string):
                for k, _, value in self.arcs(s):
                    due[(s + k) % width].append(alpha + value)

    def marginal(self) -> float:
        alpha = 0.0
        for alpha in self.forward():
            pass
        return alpha

    def add_counts(self, out: np.ndarray, times: float) -> None:
        """Expected counts of the pieces; one number for each character is held."""
        alpha = np.fromiter(self.forward(), np.float64, len(self.string) + 1)
        whole = float(alpha[-1])
        width = self.pieces.longest + 1
        beta = [0.0] * width
        counts: Counter = Counter()
        for s in range(len(self.string) - 1, -1, -1):
            here, terms = float(alpha[s]), []
            for k, ids, value in self.arcs(s):
                after = value + beta[(s + k) % width]
                terms.append(after)
                weight = math.exp(here + after - whole)
                for i in ids:
                    counts[i] += weight
            beta[s % width] = _log_sum(terms)
        for i, n in counts.items():
            out[i] += times * n


def _split_long(strings: list[str]) -> tuple[list[int], list[str]]:
    """Places of the long strings, and all strings with these left empty."""
    long = [i for i, s in enumerate(strings) if len(s) > LONG]
    return long, ["" if len(s) > LONG else s for s in strings] if long else strings


def log_marginals(pieces: Pieces, log_p: np.ndarray, strings: list[str]) -> np.ndarray:
    """Log of the summed probability of all segmentations of each string: the forward recursion, for all strings of a length at once,
    long ones each for itself in time that grows with the length."""
    out = np.zeros(len(strings))
    long, short = _split_long(strings)
    plain = log_p.tolist() if long else []
    for i in long:
        out[i] = _LongString(pieces, plain, strings[i]).marginal()
    for places, codes in by_length(short):
        n, size = codes.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        for s, k, rows, _, value in _arcs(pieces, log_p, strings, codes, places):
            alpha[s + k, rows] = np.logaddexp(alpha[s + k, rows], alpha[s, rows] + value)
        out[places] = alpha[size]
    return out


def expected_counts(pieces: Pieces, log_p: np.ndarray, strings: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece occurs in the strings, each so many times, when every segmentation counts by its probability."""
    out = np.zeros(len(log_p))
    long, short = _split_long(strings)
    plain = log_p.tolist() if long else []
    for i in long:
        _LongString(pieces, plain, strings[i]).add_counts(out, float(times[i]))
    for places, codes in by_length(short):
        n, size = codes.shape
        arcs = list(_arcs(pieces, log_p, strings, codes, places))
        alpha, beta = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        alpha[0] = beta[size] = 0.0
        for s, k, rows, _, value in arcs:
            alpha[s + k, rows] = np.logaddexp(alpha[s + k, rows], alpha[s, rows] + value)
        for s, k, rows, _, value in reversed(arcs):
            beta[s, rows] = np.logaddexp(beta[s, rows], beta[s + k, rows] + value)
        for s, k, rows, piece, value in arcs:
            weight = times[places[rows]] * np.exp(alpha[s, rows] + value + beta[s + k, rows] - alpha[size, rows])
            if piece is not None:
                out += np.bincount(piece, weight, len(out))
            else:
                for r, w in zip(rows.tolist(), weight.tolist()):
                    for i in pieces.unmatched(strings[places[r]][s]):
                        out[i] += w
    return out


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                counts.update(text.encode("utf-8", "surrogatepass").lower().split())
        if len(counts) > FLUSH:  # given out early, added up after the shuffle all the same
            yield rows(counts)
            counts = Counter()
    if counts:
        yield rows(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """`word` and how often it occurs in all texts: counted within tasks, added up by a shuffle on the word."""
    return docs.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, end_count: int, model: str, training: Training = Training()) -> LatticeModel:
    """Piece probabilities from the training words: the vocabulary's scores weight all segmentations of every distinct word, and the
    expected counts of the pieces, added up by Spark, give the probabilities. One row a piece reaches the driver."""
    pieces = load_pieces(model)
    log_p = vocabulary_weights(pieces)
    end = float(np.log(0.5))
    for _ in range(training.rounds):
        def run(batches: Iterable[pa.RecordBatch], log_p: np.ndarray = log_p) -> Iterator[pa.RecordBatch]:
            here, total = load_pieces(model), np.zeros(len(log_p))
            for batch in batches:
                strings = [SPACE + w for w in batch.column("word").to_pylist()]
                total += expected_counts(here, log_p, strings, batch.column("n").to_numpy(zero_copy_only=False).astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        got = counts.select("word", "n").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.where(np.isfinite(log_p), training.smoothing, 0.0)
        for r in got:
            total[r.piece] += r.n
        every = total.sum() + end_count + training.smoothing
        with np.errstate(divide="ignore"):
            log_p = np.log(total / every)
        end = float(np.log((end_count + training.smoothing) / every))
    return LatticeModel(log_p, end, uuid.uuid4().hex)


_remembered: dict[str, list[dict[bytes, float]]] = {}


def _marginals(pieces: Pieces, model: LatticeModel, distinct: list[bytes]) -> np.ndarray:
    """Log marginals of distinct words; those met before are remembered, in two generations of bounded size."""
    if model.key not in _remembered:
        _remembered.clear()
        _remembered[model.key] = [{}, {}]
    new, old = _remembered[model.key]
    out = [new.get(w) for w in distinct]
    missing = [i for i, x in enumerate(out) if x is None]
    fresh = []
    for i in missing:
        got = old.get(distinct[i])
        if got is None:
            fresh.append(i)
        else:
            out[i] = new[distinct[i]] = got
    values = log_marginals(pieces, model.log_p, [SPACE + distinct[i].decode("utf-8", "surrogatepass") for i in fresh]).tolist()
    for i, value in zip(fresh, values):
        out[i] = value
        if len(distinct[i]) <= 64:
            new[distinct[i]] = value
    if len(new) > CACHE_ENTRIES:
        _remembered[model.key] = [{}, new]
    return np.array(out, np.float64)


def score(docs: DataFrame, counts: DataFrame, end_count: int, lattice: LatticeModel, model: str, held_out: Column, head_words: int = Training.head_words) -> DataFrame:
    """Base and lattice scores (log10) of every whole text; one row for each row of `docs`, repeated and null ids included.

    A null text is empty and has the end of the text only. The lattice model scores within the task, in time that grows with the length of a
    text, also where it is one word of a megabyte. For the base, the counts of the
    `head_words` commonest words go to every task; each text's other words are joined with the counts and added up again.
    """
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = known.n + end_count, known.v + (end_count > 0)
    below = total + 0.5 * (distinct + 1)
    head = {r.word.encode("utf-8", "surrogatepass"): r.n for r in counts.filter(commonest(counts, "word", "n", head_words)).collect()}
    whole = len(head) == known.v

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model)
        end_base = float(np.log10((end_count + 0.5) / below))
        for batch in slices(batches, chars=3_000_000):
            index: dict[bytes, int] = {}
            place = index.setdefault
            codes, sizes = [], np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    parts = text.encode("utf-8", "surrogatepass").lower().split()
                    sizes[i] = len(parts)
                    codes.append(np.array([place(w, len(index)) for w in parts], np.int64))
            at = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found = list(index)
            count = np.fromiter((head.get(w, 0 if whole else -1) for w in found), np.int64, len(found))
            marginal = _marginals(pieces, lattice, found)
            here = count[at] >= 0
            base = np.log10((np.maximum(count, 0) + 0.5) / below)
            base_sum = np.bincount(owner[here], base[at[here]], len(sizes)) + end_base
            known_sum = np.bincount(owner, count[at] > 0, len(sizes)).astype(np.int64) + (end_count > 0)
            scores = (np.bincount(owner, marginal[at], len(sizes)) + lattice.end) / LOG10
            # The other words of each row, once each with their number.
            key, times = np.unique(owner[~here] * max(len(found), 1) + at[~here], return_counts=True)
            spelled = pa.array([found[i] for i in (key % max(len(found), 1)).tolist()], pa.binary()).cast(pa.string())
            offsets = np.searchsorted(key, np.arange(len(sizes) + 1) * max(len(found), 1))
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([spelled, pa.array(times, pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes + 1), pa.array(known_sum),
                                              pa.array(base_sum), pa.array(scores), rest],
                                             ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    keyed = texts_of(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).withColumn("held_out", held_out).withColumn("row", F.monotonically_increasing_id())
    scored = keyed.mapInArrow(run, SCORED)
    out = ["doc_id", "held_out", "n_tokens", F.col("n_known"), F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"]
    if whole:
        return scored.select(*out)
    scored = written(scored, "lattice-scores")
    others = scored.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    added = (others.join(counts.select("word", "n"), "word", "left").groupBy("row")
             .agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(below))).alias("more_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")))
    return (scored.drop("rest").join(added, "row", "left")
            .withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
            .withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).select(*out))


def fit_and_score(docs: DataFrame, model: str, held_out: Column, training: Training = Training()) -> DataFrame:
    """Learn from the rows that are not held out, score all rows. `held_out` is a condition on `doc_id`."""
    learned = docs.filter(~held_out)
    counts = written(word_counts(learned.select(F.col("text").cast("string").alias("text"))), "word-counts")
    end_count = learned.count()
    lattice = fit_pieces(counts, end_count, model, training)
    return score(docs, counts, end_count, lattice, model, held_out, training.head_words)
