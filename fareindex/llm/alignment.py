"""Alignment of two tokenizers' tokens by merging their byte ends along merge paths."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import slices, texts_of, written
from .token_counts import PATTERN, byte_characters

WORK = 16_384  # ends that one piece merges
SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<struct<a:int,b:int,n:int>>")
OVERLAPS = "doc_id long, a_index array<int>, b_index array<int>, a array<int>, b array<int>, end array<int>, both_end array<boolean>"


class Side:
    """Token bytes of one tokenizer, by id."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        before = np.cumsum(n) - n
        return self.bytes[np.repeat(self.starts[ids] - before, n) + np.arange(n.sum())]


class ByteLevel(Side):
    """A byte-level BPE file: `space + text`, special strings as plain text."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = byte_characters()
        vocab = model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        # What is no string of byte characters is an added entry, which no text reaches.
        for piece, i in vocab.items():
            tokens[i] = bytes(map(byte.__getitem__, piece)) if set(piece) <= byte.keys() else piece.encode()
        reached = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]} | byte.keys()
        self.encoder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for p, i in vocab.items() if p in reached}, special_tokens={})
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces(Side):
    """A SentencePiece model; it puts the space before the text itself."""

    def __init__(self, path: str):
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.encoder
        super().__init__([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in ((i, m.id_to_piece(i)) for i in range(m.get_piece_size()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.encoder.encode(texts, num_threads=1)]


@functools.cache
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """Where the merge of two sorted arrays stands after every `work` steps: how many of `a` are taken, of equal values those of `a` first.

    A binary search along each diagonal, all diagonals at once: the first i at which a[i] is above b[d - i - 1].
    """
    d = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        live = low < high
        i, j = np.where(live, mid, 0), np.where(live, d - mid - 1, 0)
        before = live & (a[i] <= b[j])
        low, high = np.where(before, mid + 1, low), np.where(live & ~before, mid, high)
    return np.r_[0, low, len(a)], np.r_[0, d - low, len(b)]


def merge_piece(a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps of one piece, which sees its own ends only: places of the A and the B token, where the overlap ends, whether both end there.

    Between two neighbouring ends lies exactly one A token and one B token, the first ones that end there or later.
    """
    ends = np.concatenate((a, b))
    ends.sort(kind="stable")
    ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
    at_a, at_b = np.searchsorted(a, ends), np.searchsorted(b, ends)
    both = np.zeros(len(ends), bool)
    inside = (at_a < len(a)) & (at_b < len(b))
    both[inside] = a[at_a[inside]] == b[at_b[inside]]
    return at_a + a0, at_b + b0, ends, both


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of an A and a B token that share bytes, from pieces of equal work, stitched.

    Where an end of A is the last of one piece and the same end of B the first of the next one, the first piece has the overlap and the
    second repeats its end: the repeat goes and both tokens end there. Every piece could be merged anywhere; nothing else passes between them.
    """
    cut_a, cut_b = diagonals(a, b, work)
    parts = [merge_piece(a[i:k], b[j:m], i, j) for i, k, j, m in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:])]
    out: list[list[np.ndarray]] = []
    last = None
    for part in parts:
        if last is not None and len(part[2]) and part[2][0] == last:
            out[-1][3][-1] = True
            part = tuple(x[1:] for x in part)
        if len(part[2]):
            out.append([*part])
            last = part[2][-1]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)


class Batch:
    """The tokens of a run of texts, one after another; texts whose bytes do not come back have none."""

    def __init__(self, a: Side, b: Side, texts: list[str | None]):
        want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        rows = [i for i, w in enumerate(want) if w]
        found = [side.encode([texts[i] for i in rows]) for side in (a, b)]
        good = np.ones(len(rows), bool)
        for side, ids in zip((a, b), found):
            joined = side.joined(np.concatenate(ids)) if rows else np.zeros(0, np.uint8)
            sizes = np.fromiter((side.lengths[x].sum() for x in ids), np.int64, len(rows))
            ends = np.cumsum(sizes)
            raw = joined.tobytes()
            good &= np.array([raw[e - n : e] == want[i] for i, e, n in zip(rows, ends, sizes)], bool)
        self.sides, kept = (a, b), np.flatnonzero(good)
        self.n, self.ids = [], []
        for ids in found:
            n = np.zeros(len(texts), np.int64)
            n[np.array(rows, np.int64)[kept]] = [len(ids[i]) for i in kept]
            self.n.append(n)
            self.ids.append(np.concatenate([ids[i] for i in kept]) if len(kept) else np.zeros(0, np.int64))
        self.size = len(texts)
        ends_a, ends_b = (np.cumsum(side.lengths[x]) for side, x in zip(self.sides, self.ids))
        self.at_a, self.at_b, self.ends, self.both = overlaps(ends_a, ends_b)
        self.owner = np.repeat(np.arange(self.size), self.n[0])[self.at_a]  # of each overlap
        self.bytes = np.array([len(w) if k else 0 for w, k in zip(want, self.n[0])], np.int64)

    def groups(self) -> np.ndarray:
        return np.bincount(self.owner[self.both], minlength=self.size)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, A id and B id of each link: tokens that end together."""
        return self.owner[self.both], self.ids[0][self.at_a[self.both]], self.ids[1][self.at_b[self.both]]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as decimal ids; '' without tokens."""
        last_a, last_b = self.at_a[self.both], self.at_b[self.both]
        (a, b), (na, nb) = self.ids, map(len, self.ids)
        # An A token stands after all B tokens of earlier groups, a B token after all A tokens up to its own group.
        of_a = np.searchsorted(last_a, np.arange(na))
        of_b = np.searchsorted(last_b, np.arange(nb))
        place_a = np.arange(na) + np.r_[0, last_b + 1][of_a]
        place_b = np.arange(nb) + (last_a + 1)[of_b]
        ids, after = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[place_a[last_a]], after[place_b[last_b]] = ord("|"), ord(";")
        digits = np.floor(np.log10(np.maximum(ids, 1)) + 1e-9).astype(np.int64) + 1
        width = int(digits.max(initial=1))
        chars = np.zeros((len(ids), width + 1), np.uint8)
        rest, scale = ids.copy(), 10 ** np.arange(width)
        for k in range(width):  # written flush right, the separator behind
            chars[:, width - 1 - k] = (rest // scale[k]) % 10 + ord("0")
        chars[:, width] = after
        text = chars[np.arange(width + 1) >= width - digits[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(digits + 1)][np.cumsum(self.n[0] + self.n[1])].tolist()
        out, start = [], 0
        for n, end in zip(self.n[0].tolist(), ends):
            out.append(hashlib.sha256(text[start : end - 1]).hexdigest() if n else "")
            start = end
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked ids of each text with their counts: offsets, A ids, B ids, counts."""
        owner, a, b = self.links()
        wide_a, wide_b = len(self.sides[0].lengths), len(self.sides[1].lengths)
        key, n = np.unique((owner * wide_a + a) * wide_b + b, return_counts=True)
        rest = key // wide_b
        return np.searchsorted(rest // wide_a, np.arange(self.size + 1)), rest % wide_a, key % wide_b, n


def groups(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Per row of `docs` its tokens, groups and links, the digest of its groups and its distinct linked id pairs with their counts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(tokenizer_a, tokenizer_b)
        for part in slices(batches):
            batch = Batch(a, b, part.column("text").to_pylist())
            offsets, ids_a, ids_b, n = batch.pairs()
            pair = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (ids_a, ids_b, n)], ["a", "b", "n"])
            count = pa.array(batch.groups(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(batch.n[0]), pa.array(batch.n[1]), count, count, pa.array(batch.digests(), pa.string()),
                                              pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)], [f.split(" ")[0] for f in SCHEMA.split(", ")])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def overlapping(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Per row of `docs` all overlaps in order: places and ids of both tokens, the byte of `space + text` where the overlap ends, whether both end."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(tokenizer_a, tokenizer_b)
        for part in slices(batches):
            batch = Batch(a, b, part.column("text").to_pylist())
            at = np.searchsorted(batch.owner, np.arange(batch.size + 1))
            first = lambda n: (np.cumsum(n) - n)[batch.owner]
            columns = [batch.at_a - first(batch.n[0]), batch.at_b - first(batch.n[1]), batch.ids[0][batch.at_a], batch.ids[1][batch.at_b], batch.ends - first(batch.bytes)]
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in zip([*columns, batch.both], [pa.int32()] * 5 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], [f.split(" ")[0] for f in OVERLAPS.split(", ")])

    return texts_of(docs).mapInArrow(run, OVERLAPS)


def pair_counts(found: DataFrame) -> DataFrame:
    """`a`, `b`, `pair_count` and whether the count is the highest of its B id, ties included."""
    counts = written(found.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("pair_count")), "alignment-counts")
    best = counts.groupBy("b").agg(F.max("pair_count").alias("_most"))
    return written(counts.join(best, "b").select("a", "b", "pair_count", (F.col("pair_count") == F.col("_most")).alias("is_best")), "alignment-best")


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Alignment of every whole text under two tokenizers, judged by how often the same ids are linked in all texts.

    One row for each row of `docs`, repeated and null ids included; each repeated row counts in the corpus. A text that is null or empty, or
    that either tokenizer does not give back byte by byte, has no tokens. The first pass writes counts and distinct pairs of every row (its
    row number with them), so no text is shuffled; the pairs are added up before a shuffle, and joined by the planner's choice: a pair
    occurs once a row at most, and the table of counts is sent to all tasks only while it is below the session's broadcast limit. Other
    columns of `docs` are not read, whatever their names. Both files must be readable by every executor.
    """
    found = written(groups(docs, tokenizer_a, tokenizer_b).withColumn("_row", F.monotonically_increasing_id()), "alignment")
    counts = pair_counts(found)
    links = found.select("_row", F.explode("pairs").alias("p")).select("_row", "p.a", "p.b", "p.n").join(counts, ["a", "b"])
    sums = links.groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
                                     F.sum(F.col("n") * F.col("pair_count")).cast("long").alias("count_sum"))
    return found.drop("pairs").join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")
