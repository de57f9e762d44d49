"""All pieces that match in many short strings at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Trie:
    """Pieces by their characters. A state and the next character give the next state through one sorted array."""

    def __init__(self, pieces: dict[str, int]):
        state, edges, piece_of = {"": 0}, [], [-1]
        for piece, number in pieces.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in state:
                    state[piece[:k]] = len(piece_of)
                    edges.append((state[piece[: k - 1]] << 21 | ord(piece[k - 1]), len(piece_of)))
                    piece_of.append(-1)
            piece_of[state[piece]] = number
        edges.sort()
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.next = np.array([t for _, t in edges], np.int64)
        self.piece_of = np.array(piece_of, np.int64)
        self.longest = max(map(len, pieces), default=1)

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """For strings of one length, a row of code points each: by piece length k, the piece that starts at each place (-1: none)."""
        n, size = codes.shape
        flat = codes.ravel()
        at, state = np.arange(n * size), np.zeros(n * size, np.int64)
        left = size - at % size
        out = []
        for k in range(1, min(self.longest, size) + 1):
            keep = left[at] >= k
            at, state = at[keep], state[keep]
            key = state << 21 | flat[at + (k - 1)]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            at, state = at[hit], self.next[edge[hit]]
            found = np.full(n * size, -1, np.int64)
            found[at] = self.piece_of[state]
            out.append(found.reshape(n, size))
        return out


def by_length(strings: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of non-empty strings of one length: their places in the list and their code points, a row each."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(sizes[order]) != 0, True]) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:]):
        size = int(sizes[order[a]])
        step = max(1, min(most, 1_000_000 // max(size, 1)))
        for i in range(a, b, step) if size else ():
            places = order[i : min(i + step, b)]
            joined = "".join([strings[j] for j in places]).encode("utf-32-le", "surrogatepass")
            yield places, np.frombuffer(joined, np.uint32).astype(np.int64).reshape(len(places), size)
