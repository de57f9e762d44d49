"""SentencePiece ids by streaming Viterbi, and back to text."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import slices, texts_of
from .lattice import Trie, by_length

SPACE = "▁"  # fixed value: the visible space of SentencePiece
UNKNOWN_PENALTY = 10.0  # fixed value: an unmatched character scores this much below the lowest piece
SCHEMA = "doc_id long, n_ids long, ids array<int>, score double, round_trip boolean"
CACHE_ENTRIES = 300_000
SHORT = 48  # longer chunks are not remembered
INFINITE = float("inf")


class Pieces:
    """Pieces and scores of a SentencePiece model with identity normalization, dummy prefix and byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        text = [model.id_to_piece(i) for i in ids]
        self.unknown = model.unk_id()
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_id = {int(text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if i not in special and not model.is_byte(i)]
        self.id_of = {text[i]: (i, model.get_score(i)) for i in reversed(normal)}
        #: A piece's id and score; -1 for what only begins a piece.
        self.step = {p[:k]: (-1, 0.0) for p in self.id_of for k in range(1, len(p))} | self.id_of
        self.trie = Trie({p: i for p, (i, _) in self.id_of.items()})
        self.scores = np.array([model.get_score(i) for i in ids] + [0.0])
        self.longest = max(map(len, self.id_of), default=1)
        self.unknown_score = min((s for _, s in self.id_of.values()), default=0.0) - UNKNOWN_PENALTY
        written = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(text)]
        for b, i in self.byte_id.items():
            written[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(written), np.uint8)
        self.byte_lengths = np.fromiter(map(len, written), np.int64, len(written))
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        # Where no piece can reach across, every path meets: before a space that follows something else, and around white space in no piece.
        alphabet = {c for p in self.id_of for c in p}
        self.spaces_lead = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        cut = "".join(c for c in "\t\n\r" if c not in alphabet)
        self.chunk = re.compile(f"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" if cut else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Chunks in use, and those of the generation before, which come back when they are met again.
        self.cache: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}

    def unmatched(self, char: str) -> list[int]:
        found = [self.byte_id.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found


class StreamingViterbi:
    """The best segmentation of a stream of characters.

    A character is settled once the longest piece could start there. Scores and back pointers are held since the last committed boundary
    only. When all surviving paths run through one boundary, the ids up to it are given out and forgotten; that is looked for once the
    window is longer than the longest piece. Of equal scores the path whose last piece starts earliest wins.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.ahead = ""                    # characters from the first that is not settled
        self.at = 0                        # its place in the window, which starts at the committed boundary
        self.reach = 0                     # the furthest place that a path has reached
        self.best = [0.0]                  # by place: score since the committed boundary
        self.start = [0]                   # by place: where the last piece starts
        self.ids: list = [()]              # by place: id of the last piece, or the byte ids of an unmatched character
        self.score = 0.0                   # of what is committed

    def feed(self, text: str) -> list[int]:
        self.ahead += text
        return self._settle(len(self.ahead) - self.pieces.longest + 1)

    def finish(self) -> list[int]:
        return self._settle(len(self.ahead)) + self._commit(self.at)

    def _settle(self, n: int) -> list[int]:
        if n <= 0:
            return []
        p, out, text = self.pieces, [], self.ahead
        step, longest, size = p.step.get, p.longest, len(text)
        at, reach, best, start, ids = self.at, self.reach, self.best, self.start, self.ids
        for i in range(n):
            if len(best) <= at + longest:
                more = n - i + longest
                best += [-INFINITE] * more
                start += [0] * more
                ids += [0] * more
            here, single = best[at], False
            for end in range(i + 1, min(i + longest, size) + 1):
                found = step(text[i:end])
                if found is None:
                    break
                piece, value = found
                if piece >= 0:
                    to, value = at + end - i, here + value
                    if value > best[to]:
                        best[to], start[to], ids[to] = value, at, piece
                        if to > reach:
                            reach = to
                    single |= end == i + 1
            at += 1
            if not single:
                value = here + p.unknown_score
                if value > best[at]:
                    best[at], start[at], ids[at] = value, at - 1, p.unmatched(text[i])
                    if at > reach:
                        reach = at
            if at >= longest and (reach == at or at % longest == 0):
                self.at, self.reach = at, reach
                out += self._commit(at if reach == at else self._meeting())
                at, reach, best, start, ids = self.at, self.reach, self.best, self.start, self.ids
        self.at, self.reach, self.ahead = at, reach, text[n:]
        return out

    def _meeting(self) -> int:
        """The last boundary that all surviving paths have in common."""
        open_ = {t for t in range(self.at, self.reach + 1) if self.best[t] > -INFINITE}
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(self.start[last])
        return open_.pop()

    def _commit(self, boundary: int) -> list[int]:
        if boundary == 0:
            return []
        parts, t = [], boundary
        while t > 0:
            parts.append(self.ids[t])
            t = self.start[t]
        out: list[int] = []
        for x in reversed(parts):
            if isinstance(x, int):
                out.append(x)
            else:
                out += x
        done = self.best[boundary]
        self.score += done
        self.best = [b - done for b in self.best[boundary : self.reach + 1]]
        self.start = [b - boundary for b in self.start[boundary : self.reach + 1]]
        self.ids = self.ids[boundary : self.reach + 1]
        self.at -= boundary
        self.reach -= boundary
        return out


def best_paths(pieces: Pieces, chunks: list[str]) -> list[tuple[bytes, float]]:
    """What the stream gives for each of many short chunks, ids as int32: all windows of one length advance together, a place at a time."""
    out: list = [(b"", 0.0)] * len(chunks)
    for places, codes in by_length(chunks):
        n, size = codes.shape
        found = pieces.trie.matches(codes)
        best, start, ids = np.full((size + 1, n), -INFINITE), np.zeros((size + 1, n), np.int64), np.full((size + 1, n), -1, np.int32)
        best[0] = 0.0
        for s in range(size):
            for k, at_k in enumerate(found[: size - s], 1):
                piece = at_k[:, s]
                rows = np.flatnonzero(piece >= 0) if k > 1 else slice(None)
                piece = piece[rows]
                value = best[s, rows] + (pieces.scores[piece] if k > 1 else np.where(piece >= 0, pieces.scores[piece], pieces.unknown_score))
                better = np.flatnonzero(value > best[s + k, rows])
                to = rows[better] if k > 1 else better
                best[s + k, to], start[s + k, to], ids[s + k, to] = value[better], s, piece[better]
        path, t, rows, used = np.zeros((n, size), np.int32), np.full(n, size), np.arange(n), 0
        unmatched = np.zeros(n, bool)
        count = np.zeros(n, np.int64)
        while len(rows):
            used += 1
            at = t[rows]
            path[rows, size - used] = ids[at, rows]
            unmatched[rows] |= ids[at, rows] < 0
            count[rows] = used
            t[rows] = start[at, rows]
            rows = rows[t[rows] > 0]
        joined, width = path.tobytes(), 4 * size
        for row, (place, k, odd, value) in enumerate(zip(places.tolist(), count.tolist(), unmatched.tolist(), best[size].tolist())):
            if odd:
                chars, back = chunks[place], size
                held: list[int] = []
                while back:
                    number = int(ids[back, row])
                    held += [number] if number >= 0 else reversed(pieces.unmatched(chars[back - 1]))
                    back = int(start[back, row])
                out[place] = (np.array(held[::-1], np.int32).tobytes(), value)
            else:
                end = (row + 1) * width
                out[place] = (joined[end - 4 * k : end], value)
    return out


def lookup(pieces: Pieces, chunks: list[str]) -> list[tuple[bytes, float]]:
    """Ids and score of distinct chunks: short ones remembered, long ones through the stream."""
    out = list(map(pieces.cache.get, chunks))
    missing = [i for i, got in enumerate(out) if got is None]
    short = []
    for i in missing:
        chunk = chunks[i]
        if len(chunk) > SHORT:
            stream = StreamingViterbi(pieces)
            ids = [x for a in range(0, len(chunk), 4096) for x in stream.feed(chunk[a : a + 4096])] + stream.finish()
            out[i] = (np.array(ids, np.int32).tobytes(), stream.score)
        elif (got := pieces.older.get(chunk)) is not None:
            out[i] = pieces.cache[chunk] = got
        else:
            short.append(i)
    new = [chunks[i] for i in short]
    for i, got in zip(short, best_paths(pieces, new)):
        out[i] = pieces.cache[chunks[i]] = got
    if len(pieces.cache) > CACHE_ENTRIES:
        pieces.cache, pieces.older = {}, pieces.cache
    return out


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of `values` that start and end there, one after another."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


def encode_texts(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts one after another, the number of each text and its score."""
    index: dict[str, int] = {}
    place = index.setdefault
    codes, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            written = SPACE + text.replace(" ", SPACE)
            chunks = pieces.chunk.findall(written) if pieces.spaces_lead else [written]
            codes.append(np.array([place(c, len(index)) for c in chunks], np.int64))
            sizes[i] = len(chunks)
    at = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    found = lookup(pieces, list(index))
    flat = np.frombuffer(b"".join([x for x, _ in found]), np.int32)
    lengths = np.fromiter((len(x) // 4 for x, _ in found), np.int64, len(found))
    scores = np.fromiter((x for _, x in found), np.float64, len(found))
    ids = gather(flat, (np.cumsum(lengths) - lengths)[at], lengths[at]) if len(at) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return ids, np.bincount(owner, lengths[at], len(texts)).astype(np.int64), np.bincount(owner, scores[at], len(texts))


def decode_all(pieces: Pieces, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The texts, as UTF-8, of ids that stand one after another; the space before the first word goes."""
    sizes = pieces.byte_lengths[ids]
    joined = gather(pieces.bytes, pieces.byte_starts[ids], sizes).tobytes()
    ends = np.r_[0, np.cumsum(sizes)][np.cumsum(lengths)].tolist()
    out, start = [], 0
    for end in ends:
        text = joined[start:end]
        out.append(text[1:] if text.startswith(b" ") else text)
        start = end
    return out


@functools.cache
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Ids of every whole text under the model's own piece scores, with the score of the path and whether decoding gives the text back.

    One row for each row of `docs`, repeated and null ids included. A null or empty text has no ids, score 0 and decodes to the empty text.
    Characters in no piece are written as bytes. No shuffle; a task holds about a megabyte of text and a bounded memory of chunks.
    `model` is the path of a SentencePiece model which every executor can read.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model)
        for batch in slices(batches, chars=3_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, n, scores = encode_texts(pieces, texts)
            same = [a == t.encode("utf-8", "surrogatepass") for a, t in zip(decode_all(pieces, ids, n), texts)]
            offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                                              pa.array(scores), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "score", "round_trip"])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """`doc_id` and text of ids made by `encode`; null ids give the empty text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model)
        for batch in batches:
            ids = batch.column("ids")
            n = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t.decode("utf-8", "replace") for t in decode_all(pieces, ids.flatten().to_numpy(zero_copy_only=False), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")
