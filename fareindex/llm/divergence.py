"""Quality rules: base counts of a text, and its Jensen-Shannon distance from references of its language."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .common import SEPARATORS, slices, texts_of, words, written

SYMBOLS = "#*$%&|<>"         # fixed value: characters counted as symbols
TRIMMED = b".,;:!?"          # punctuation that does not belong to a common word
#: Character classes: lower case, upper case, other letters and marks, numbers, punctuation, symbols, the rest.
CLASSES = ("lower", "upper", "letter", "number", "punctuation", "symbol", "rest")
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "class_distance double, word_distance double")
FLUSH = 200_000


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A distance is judged only from its minimum length on; below it, chance moves a histogram too far."""

    min_words: int = 50              # base rule
    max_repeat_percent: int = 50     # base rule
    class_min_chars: int = 200
    class_limit: float = 0.23
    word_min_words: int = 60
    word_limit: float = 0.28
    word_slack: float = 1.2          # divided by the root of the number of words and added to the limit: what chance adds to the distance
    common_words: int = 50
    min_share: float = 0.001         # a language has a reference of its own from this share of the rows on, so there are 1000 at most,
    ample_rows: int = 1000           # or from this number of rows on, if it is among
    most_languages: int = 2000       # so many with most rows
    pooled_limit: float = 0.35       # of the distance from the pooled reference, for texts of the other languages and of none


@dataclass(frozen=True)
class Reference:
    """Histograms of one language: share of each character class, share of each common word and of all others. The pooled one, for texts
    whose language has none, takes all letters as one class, as scripts differ in case, and has no common words."""

    classes: np.ndarray
    common: dict[bytes, int] = field(default_factory=dict)
    shares: np.ndarray = field(default_factory=lambda: np.ones(1))
    pooled: bool = False


POOLED = None  # key of the pooled reference
References = dict[str | None, Reference]


def reference_of(lang: str | None, references: References) -> Reference | None:
    return references.get(lang) or references.get(POOLED)


def one_letter_class(classes: np.ndarray) -> np.ndarray:
    return np.r_[classes[:3].sum(), classes[3:]]


@functools.cache
def class_table() -> np.ndarray:
    of = {"Ll": 0, "Lu": 1, "L": 2, "M": 2, "N": 3, "P": 4, "S": 5}
    kinds = (unicodedata.category(chr(i)) for i in range(0x110000))
    return np.fromiter((of.get(k, of.get(k[0], 6)) for k in kinds), np.uint8, 0x110000)


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[codes], minlength=len(CLASSES))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three found at least twice."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 2_000_000:  # three of them no longer fit one number
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + ids[2:]
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(SEPARATORS):
            seen.add(line)
    return n


def common_form(word: bytes) -> bytes:
    return word.lower().strip(TRIMMED)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2: 0 for equal, 1 for disjoint histograms. `p` counts, `q` shares."""
    p = p / p.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0).sum() + np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, parts / 2)))


@dataclass
class Measured:
    """Base counts of a text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    distinct: dict[bytes, int]
    ids: np.ndarray

    def failed(self, rules: Rules) -> bool:
        return self.n_words < rules.min_words or 100 * self.n_repeat_words > rules.max_repeat_percent * self.n_words


def measure(text: str) -> Measured:
    parts = words(text)
    distinct: dict[bytes, int] = {}
    ids = np.array([distinct.setdefault(w, len(distinct)) for w in parts], np.int64)
    return Measured(len(parts), len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), repeated_lines(text),
                    repeated_words(ids, len(distinct)), distinct, ids)


def distances(text: str, m: Measured, ref: Reference | None, rules: Rules) -> tuple[float | None, float | None]:
    """Distances of character classes and of common words; None where there is no reference or the text is too short."""
    by_class = by_word = None
    if ref is not None and len(text) >= rules.class_min_chars and ref.classes.sum() > 0:
        counts = class_counts(text)
        by_class = distance(one_letter_class(counts) if ref.pooled else counts, ref.classes)
    if ref is not None and m.n_words >= rules.word_min_words and len(ref.common):
        place = np.fromiter((ref.common.get(common_form(w), len(ref.common)) for w in m.distinct), np.int64, len(m.distinct))
        by_word = distance(np.bincount(place[m.ids], minlength=len(ref.common) + 1), ref.shares)
    return by_class, by_word


def judge(n_words: int, by_class: float | None, by_word: float | None, ref: Reference | None, rules: Rules) -> bool:
    limit = rules.pooled_limit if ref is not None and ref.pooled else rules.class_limit
    return not ((by_class or 0.0) > limit or (by_word is not None and by_word > rules.word_limit + rules.word_slack / n_words ** 0.5))


def _statistics(rules: Rules, names: frozenset[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By language, over the texts that pass the base rules: characters of each class, words of each common form, all words. Languages not
    named count as none, and for none the characters only."""
    def rows(lang: str | None, kind: str, counts: Iterable[tuple[str, int]]) -> pa.RecordBatch:
        keys, n = zip(*counts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([kind] * len(n)), pa.array(keys), pa.array(n, pa.int64())],
                                          ["lang", "kind", "key", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        total: Counter = Counter()
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                m = measure(text or "")
                if m.failed(rules):
                    continue
                lang = lang if lang in names else POOLED
                classes[lang] += class_counts(text)
                if lang is POOLED:
                    continue
                total[lang] += m.n_words
                counter = forms[lang]
                for w, n in zip(m.distinct, np.bincount(m.ids, minlength=len(m.distinct)).tolist()):
                    counter[common_form(w)] += n
            if sum(map(len, forms.values())) > FLUSH:  # given out early, added up after the shuffle all the same
                yield from (rows(lang, "word", ((w.decode("utf-8", "replace"), n) for w, n in c.items())) for lang, c in forms.items() if c)
                forms.clear()
        yield from (rows(lang, "word", ((w.decode("utf-8", "replace"), n) for w, n in c.items())) for lang, c in forms.items() if c)
        yield from (rows(lang, "class", zip(CLASSES, c.tolist())) for lang, c in classes.items())
        yield from (rows(lang, "total", [("", n)]) for lang, n in total.items())

    return run


def language_references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """References of the languages with enough rows (`Rules`), from all texts that pass the base rules, and the pooled one of all these
    texts under `POOLED`. No texts, or none that pass, give no references.

    Words are counted within each task, added up by a shuffle on (language, word) and cut to the commonest before they are brought
    together; at most 3000 languages x (`common_words` + 8) rows reach the driver.
    """
    langs = written(docs.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")), "languages")
    total = langs.agg(F.sum("n")).first()[0] or 0
    named = langs.filter("lang IS NOT NULL")
    ample = named.filter(F.col("n") >= rules.ample_rows).orderBy(F.desc("n"), "lang").limit(rules.most_languages)
    names = frozenset(r.lang for r in named.filter(F.col("n") >= rules.min_share * total).unionByName(ample).collect())
    counted = (texts_of(docs, "lang").mapInArrow(_statistics(rules, names), "lang string, kind string, key string, n long")
               .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).filter("kind <> 'word' OR key <> ''"))
    most = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    found: dict[str | None, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for r in counted.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= max(rules.common_words, len(CLASSES))).collect():
        found[r.lang][r.kind].append((r.place, r.key, r.n))
    out: References = {}
    every = np.zeros(len(CLASSES))
    for lang, of in found.items():
        by_class = {key: n for _, key, n in of["class"]}
        classes = np.array([by_class.get(c, 0) for c in CLASSES], float)
        every += classes
        if lang is not POOLED:
            common = sorted(of["word"])[: rules.common_words]
            counts = np.array([n for _, _, n in common] + [of["total"][0][2] - sum(n for _, _, n in common)], float)
            out[lang] = Reference(classes / classes.sum(), {key.encode("utf-8"): i for i, (_, key, _) in enumerate(common)}, counts / counts.sum())
    if every.sum() > 0:
        out[POOLED] = Reference(one_letter_class(every / every.sum()), pooled=True)
    return out


def assess(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """Base counts, distances and verdict of every whole text; one row for each row of `docs`.

    A null text has no words and fails the base rule. A text of a language without reference (null and rare ones) is judged by its distance
    from the pooled reference's character classes and has no word distance; a text below a minimum length has a null distance. Null
    distances are never held against a text. No shuffle.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                m = measure(text or "")
                failed = m.failed(rules)
                ref = reference_of(lang, references)
                by_class, by_word = distances(text or "", m, ref, rules)
                out.append((doc, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed,
                            not failed and judge(m.n_words, by_class, by_word, ref, rules), by_class, by_word))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return texts_of(docs, "lang").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs`, all columns, that `assess` keeps."""
    @F.pandas_udf("boolean")
    def kept(text: pd.Series, lang: pd.Series) -> pd.Series:
        def one(t: str | None, name: str | None) -> bool:
            m, ref = measure(t or ""), reference_of(name, references)
            return not m.failed(rules) and judge(m.n_words, *distances(t or "", m, ref, rules), ref, rules)
        return pd.Series([one(t, name) for t, name in zip(text, lang)], dtype=bool)

    return docs.filter(kept(F.col("text").cast("string"), F.col("lang").cast("string")))
