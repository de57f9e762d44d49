"""Mixing documents to target weights: soft membership in domains, rates by projected-gradient least squares. Built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_PATTERN, commonest, smallest_hashes, written

SIGNS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Mixing:
    most_labelled: int = 20_000   # labelled documents that the classifier learns from, about so many, those of the smallest hashes
    most_terms: int = 20_000      # terms that it keeps: those of most documents, so their table has a bounded size
    min_documents: int = 5        # a term occurs in so many at least
    smoothing: float = 20.0       # documents of average terms added to each domain
    sure: float = 5.0             # standard deviations by which a term must depart from its expected number
    budget: float = 1.0           # wanted tokens, as a multiple of those there are
    pull: float = 0.01            # of each rate towards the budget, against the fit to the targets
    rounds: int = 40


@dataclass(frozen=True)
class Rates:
    """The steps of the fit: for each round, what a whole document of each domain is moved by."""

    domains: list[str]
    moves: list[list[float]]
    mixing: Mixing


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _terms(text: Column) -> Column:
    """Distinct terms of a text: runs of letters in lower case (anything in ASCII but a-z separates), and marks of its form."""
    text = F.coalesce(text, F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    upper, signs = F.regexp_count(text, F.lit("[A-Z]")), F.regexp_count(text, F.lit(SIGNS))
    marks = F.array(F.when(upper * 2 > length, F.lit("<upper>")), F.when(signs * 20 > length, F.lit("<signs>")), F.when(length < 200, F.lit("<short>")))
    letters = F.split(F.lower(text), "[\\x00-\\x60\\x7B-\\x7F]+")
    return F.array_distinct(F.concat(letters, F.array_compact(marks)))


def fit_domains(docs: DataFrame, labels: DataFrame, mixing: Mixing = Mixing()) -> tuple[list[str], dict[str, float], DataFrame]:
    """Domains, their log shares and, for each kept term, its log-ratio in each domain (a table of at most `most_terms` rows).

    `labels` has `doc_id` and `domain`; of several domains of an id the smallest name counts. Naive Bayes over the terms that a
    document has, from a documented bounded sample of the labelled documents.
    """
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
             .filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain")))
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(marks, "doc_id").distinct(), "mixing-labelled")
    n = found.count()
    sample = found.filter(smallest_hashes(F.col("doc_id"), mixing.most_labelled / n)) if n > mixing.most_labelled else found
    size = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(size)
    total = sum(size.values())
    learned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _terms(F.col("text").cast("string")).alias("terms")).join(sample, "doc_id")
    each = learned.select("domain", F.explode("terms").alias("term"))
    seen = each.groupBy("term").agg(F.count(F.lit(1)).alias("every"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(names)])
    seen = written(seen.filter((F.col("every") >= mixing.min_documents) & (F.col("term") != "")), "mixing-counts")
    kept = seen.filter(commonest(seen, "term", "every", mixing.most_terms))
    share = F.col("every") / F.lit(float(total))
    ratios = []
    for i, d in enumerate(names):
        expected = F.lit(float(size[d])) * share
        ratio = F.log((F.col(f"n{i}") + mixing.smoothing * share) / ((size[d] + mixing.smoothing) * share))
        # A domain of few documents lacks most terms by chance; only a sure excess or lack counts.
        ratios.append(F.when(F.abs(F.col(f"n{i}") - expected) >= mixing.sure * F.sqrt(expected + 1.0), ratio).otherwise(0.0).alias(f"w{i}"))
    return names, {d: math.log(size[d] / total) for d in names}, written(kept.select("term", *ratios), "mixing-terms")


def posteriors(docs: DataFrame, names: list[str], log_share: dict[str, float], terms: DataFrame) -> DataFrame:
    """`doc_id`, `n_tokens` and, in hundredths, the share `p0`, `p1`, ... of each row in each domain (they sum to 100).

    The terms of each row meet the broadcast term table, of bounded size, and are summed by row before and after one shuffle. What
    rounding down leaves goes to the likeliest domain, of equal ones the first.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _n_words(text).alias("n_tokens"),
                       _terms(text).alias("terms")).select("row", "doc_id", "n_tokens", F.explode_outer("terms").alias("term"))
    summed = (rows.join(F.broadcast(terms), "term", "left").groupBy("row", "doc_id", "n_tokens")
              .agg(*[(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) + F.lit(log_share[d])).alias(f"s{i}") for i, d in enumerate(names)]))
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(names))]) if len(names) > 1 else F.col("s0")
    raised = summed.select("doc_id", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(len(names))])
    every = sum((F.col(f"e{i}") for i in range(len(names))), F.lit(0.0))
    cut = raised.select("doc_id", "n_tokens", *[F.floor(100 * F.col(f"e{i}") / every + 1e-9).cast("int").alias(f"q{i}") for i in range(len(names))],
                        F.array_position(F.array(*[F.col(f"e{i}") >= 1.0 for i in range(len(names))]), F.lit(True)).alias("first"))
    left = F.lit(100) - sum((F.col(f"q{i}") for i in range(len(names))), F.lit(0))
    return cut.select("doc_id", "n_tokens", *[(F.col(f"q{i}") + F.when(F.col("first") == i + 1, left).otherwise(0)).cast("int").alias(f"p{i}") for i in range(len(names))])


def _rate(moves: list[list[float]], mixing: Mixing, n: int) -> Column:
    """The rate of a row after all moves: each round steps against the gradient and is projected to be nonnegative."""
    start = F.lit(float(mixing.budget))
    if not moves:
        return start
    shares = [F.col(f"p{i}") / F.lit(100.0) for i in range(n)]
    step = 1.0 / (1.0 + mixing.pull)
    rounds = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])

    def move(rate: Column, m: Column) -> Column:
        pushed = sum((F.get(m, F.lit(i)) * shares[i] for i in range(n)), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - F.lit(step) * (pushed + F.lit(mixing.pull) * (rate - start)))

    return F.aggregate(rounds, start, move)


def fit_rates(shared: DataFrame, names: list[str], targets: dict[str, float], mixing: Mixing = Mixing()) -> Rates:
    """Rates that bring the expected tokens of each domain to its target share of the budget.

    Minimises over nonnegative rates r: sum_d (A_d(r) - T_d)^2 / B_d + pull * sum_i t_i (r_i - budget)^2, where A_d(r) sums t_i r_i p_id and
    B_d are the tokens expected at rate 1. A rate depends on a row's shares alone, so rows of equal shares are added up once; each round is a
    distributed sum over these, and one number for each domain reaches the driver. Targets of domains that have no tokens are left out
    and the others scaled to sum to 1; a domain without target has target 0.
    """
    ps = [f"p{i}" for i in range(len(names))]
    groups = written(shared.groupBy(*ps).agg(F.sum("n_tokens").alias("tokens")), "mixing-groups")
    first = groups.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *[F.coalesce(F.sum(F.col("tokens") * F.col(p) / 100.0), F.lit(0.0)) for p in ps]).first()
    every, base = float(first[0]), [float(x) for x in first[1:]]
    wanted = {d: targets.get(d, 0.0) if base[i] > 0 else 0.0 for i, d in enumerate(names)}
    total = sum(wanted.values())
    moves: list[list[float]] = []
    if not every or not total:
        return Rates(names, moves, mixing)
    goal = [wanted[d] / total * mixing.budget * every for d in names]
    for _ in range(mixing.rounds):
        rate = _rate(moves, mixing, len(names))
        now = groups.select("tokens", *ps, rate.alias("rate")).agg(*[F.sum(F.col("tokens") * F.col("rate") * F.col(p) / 100.0) for p in ps]).first()
        gap = [(float(a) - g) / b if b > 0 else 0.0 for a, g, b in zip(now, goal, base)]
        moves.append(gap)
        if max(map(abs, gap)) < 1e-6:
            break
    return Rates(names, moves, mixing)


def rated(shared: DataFrame, rates: Rates) -> DataFrame:
    """`doc_id`, `n_tokens`, `domain` (the likeliest), `posterior` (by domain name, in order) and `rate` of each row."""
    n = len(rates.domains)
    shares = F.array(*[(F.col(f"p{i}") / 100.0) for i in range(n)])
    domain = F.element_at(F.array(*[F.lit(d) for d in rates.domains]), F.array_position(shares, F.array_max(shares)).cast("int"))
    return shared.select("doc_id", "n_tokens", domain.alias("domain"), shares.alias("posterior"), _rate(rates.moves, rates.mixing, n).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], mixing: Mixing = Mixing()) -> DataFrame:
    """Rates of all rows of `docs`, as `rated`; rows that repeat an id have a rate each.

    Without labelled documents there is no domain: every row has null domain, an empty posterior and the budget as rate. A null or
    empty text has no tokens and the posterior of what it has: no terms.
    """
    names, log_share, terms = fit_domains(docs, labels, mixing)
    if not names:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _n_words(F.col("text").cast("string")).alias("n_tokens"),
                           F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(float(mixing.budget)).alias("rate"))
    shared = written(posteriors(docs, names, log_share, terms), "mixing-posteriors")
    return rated(shared, fit_rates(shared, names, targets, mixing))


def repeat(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, each as often as its rate says: the whole part, and one more where the id's hash falls below the rest.

    Of several rates of an id the largest counts; rows without id stay once.
    """
    by_id = rates.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("rate").alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = by_id.select(F.col("doc_id").alias("rated_id"), F.floor(F.col("rate") + draw).cast("int").alias("mixing_times"))
    joined = docs.alias("d").join(times.alias("t"), F.col("d.doc_id").cast("long") == F.col("t.rated_id"), "left")
    n = F.coalesce(F.col("t.mixing_times"), F.lit(1))
    copy = "_".join(["copy", *docs.columns])  # a name that no column has
    return joined.filter(n >= 1).select("d.*", F.explode(F.array_repeat(F.lit(0), n)).alias(copy)).drop(copy)
