"""Exact BPE token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Fixed value: the pattern with which byte-level BPE splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64  # remembered pre-tokens, and the longest of them
LONG = 512                                # characters from which a pre-token is counted with places listed by rank
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> dict[str, int]:
    """Byte-level BPE writes a byte as its own printable Latin-1 character, the others as characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def every_other(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of occurrences that overlap (a run of one symbol, beginning where `first` holds) every other one, from the left."""
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[place % 2 == 0]


class MergeTable:
    """Byte symbols and ranked merges of a byte-level BPE file, for many sequences at a time."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are read")
        vocab = model["vocab"]
        self.symbol_of_byte = np.zeros(256, np.int64)
        for char, b in byte_characters().items():
            self.symbol_of_byte[b] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        # A pair listed twice keeps its first rank.
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in white space are not read")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour; none across sequences."""
        return np.where(owner[:-1] == owner[1:], self.ranks_of(symbols[:-1], symbols[1:]), NO_RANK)

    def count_long(self, sequence: bytes) -> int:
        """Symbols that survive in one long sequence.

        The rounds are those of `count`, but the places of every pair wait in a list of its rank, and a round touches only the places of the
        lowest rank and their neighbours. So the work grows with the length, whatever the number of rounds.
        """
        n = left = len(sequence)
        symbols = self.symbol_of_byte[np.frombuffer(sequence, np.uint8)]
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        waiting: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def wait(at: np.ndarray) -> None:
            rank = self.ranks_of(symbols[at], symbols[after[at]])
            at, rank = at[rank != NO_RANK], rank[rank != NO_RANK]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(at)] if len(at) else []
            for i, j in zip(edges[:-1], edges[1:]):
                r = int(rank[i])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(due, r)
                waiting[r].append(at[i:j])

        wait(np.arange(n - 1))
        while due:
            rank = heapq.heappop(due)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[(symbols[at] >= 0) & (after[at] < n)]
            at = at[self.ranks_of(symbols[at], symbols[after[at]]) == rank]  # the others were merged meanwhile
            if not len(at):
                continue
            at = every_other(at, np.r_[True, after[at[:-1]] != at[1:]])
            gone = after[at]
            symbols[at] = self.merged[rank]
            symbols[gone] = -1
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left -= len(at)
            wait(np.unique(np.r_[before[at][before[at] >= 0], inner]))
        return left

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence.

        Every round finds the lowest rank of each sequence and merges all its occurrences in all sequences at once. A merge only makes
        pairs of higher rank than its own, so the order is that of merging one pair after another.
        """
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = lengths.copy()
        owner = np.repeat(np.arange(len(sequences)), lengths)
        symbols = self.symbol_of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        while len(symbols):  # the last round, which finds no pair, notes what is left
            rank = self.pair_ranks(symbols, owner)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], first)
            out[owner[first]] = np.diff(np.r_[first, len(symbols)])
            per_symbol = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            hit = (rank == per_symbol[:-1]) & (rank != NO_RANK)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            at = every_other(at, np.r_[True, np.diff(at) != 1])
            symbols[at] = self.merged[rank[at]]
            live = per_symbol != NO_RANK
            live[at + 1] = False
            symbols, owner = symbols[live], owner[live]
        return out

    def remember(self, tokens: set[str]) -> None:
        new = []
        for t in tokens:
            if t not in self.cache:
                if len(t) >= LONG:
                    self.cache[t] = self.count_long(t.encode("utf-8", "surrogatepass"))
                else:
                    new.append(t)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.cache.update(zip(part, self.count([t.encode("utf-8", "surrogatepass") for t in part]).tolist()))

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string counts as its one token."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            split.append([t for part in parts for t in self.pattern.findall(part)] if len(parts) > 1 else self.pattern.findall(text))
        distinct = set().union(*split)
        self.remember(distinct)
        counts = [n + sum(map(self.cache.__getitem__, tokens)) for n, tokens in zip(extra, split)]
        for t in distinct:
            if len(t) > CACHE_CHARS:
                del self.cache[t]
        return counts


@functools.cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text, as the tokenizer's library counts them without begin, end or added special tokens.

    One row for each row of `docs`, repeated and null ids included; a null text counts as empty (0 bytes, 0 tokens). No shuffle: each task
    splits its texts, keeps a bounded memory of short pre-tokens it has counted, and merges the others together. Time and memory grow
    with the length of a text, also where it is one pre-token of a megabyte. `tokenizer` is the path of a
    byte-level BPE file which every executor can read.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merge_table(tokenizer)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = merges.count_texts(texts)
            sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64()),
                                              pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(run, SCHEMA)
