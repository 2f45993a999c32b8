"""Short passages found in texts, all lengths in one pass over the bytes, so that what meets is what is held.

The passages are a table that all tasks have: of each length the hashes, in order. A text's bytes give the hash of the run of each of
these lengths at each place, from that of the run a byte shorter; a hash that is in the table is confirmed by the bytes. Rows come out
where the texts are read: no candidates are shuffled, and texts neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multipliers of the hash; the first that keeps the passages apart is taken.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bytes of texts that are hashed at a time, pairs that are compared, and rows of a batch that is returned.
CHUNK, PAIRS, ROWS = 1 << 19, 1 << 16, 1024


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (none is null) and where each begins, with the end of the last."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    own = np.frombuffer(places, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
    return np.frombuffer(data or b"", np.uint8), np.asarray(own, np.int64)


class Passages:
    """``texts``: passages, none of them empty; ``items``: what is returned of each."""

    def __init__(self, texts: pa.Array, items: pa.Array) -> None:
        self.data, places = _buffer(texts)
        size = np.diff(places)
        for base in BASES:
            self.base, hashes = np.uint64(base), np.zeros(len(texts), np.uint64)
            for k in range(int(size.max(initial=0))):
                more = np.flatnonzero(size > k)
                hashes[more] = hashes[more] * self.base + self.data[places[more] + k] + np.uint64(1)
            order = np.lexsort((hashes, size))
            size_at, hash_at, start_at = size[order], hashes[order], places[:-1][order]
            same = np.flatnonzero((size_at[1:] == size_at[:-1]) & (hash_at[1:] == hash_at[:-1])) + 1
            if self._equal(self.data, start_at[same], start_at[same - 1], size_at[same]):
                break
        else:
            raise ValueError("passages that no hash keeps apart")
        # Copies of a passage stand beside each other: of each text the first and how many they are.
        self.first = np.setdiff1d(np.arange(len(order)), same, assume_unique=True)
        self.copies = np.diff(np.append(self.first, len(order)))
        self.items, self.starts, self.hashes = items.take(pa.array(order)), start_at[self.first], hash_at[self.first]
        sizes = size_at[self.first]
        self.of_size = {int(k): (int(np.searchsorted(sizes, k)), int(np.searchsorted(sizes, k, "right"))) for k in np.unique(sizes)}
        bits = min(24, max(12, (16 * len(self.first)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.hashes * MIX) >> self.shift] = True

    def _equal(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
        return all(self._held(data, a[size == k], b[size == k], int(k)).all() for k in np.unique(size))

    def _held(self, data: np.ndarray, at: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """Whether k bytes of ``data`` from each of ``at`` are those of the passages from each of ``starts``."""
        steps, out = np.arange(k), np.zeros(len(at), bool)
        for i in range(0, len(at), PAIRS):
            out[i : i + PAIRS] = (data[at[i : i + PAIRS, None] + steps] == self.data[starts[i : i + PAIRS, None] + steps]).all(axis=1)
        return out

    def held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every passage text that a text holds, each pair once."""
        data, places = _buffer(texts)
        found, end, n_own = [np.empty(0, np.int64)], int(places[-1]), len(self.first)
        for start in range(int(places[0]), end, CHUNK):
            at = np.arange(start, min(start + CHUNK, end))
            row = np.searchsorted(places, at, "right") - 1
            room, hashes = places[row + 1] - at, np.zeros(len(at), np.uint64)
            for k in range(1, max(self.of_size, default=0) + 1):
                n = min(len(at), end - start - k + 1)
                if n <= 0:
                    break
                hashes[:n] = hashes[:n] * self.base + data[start + k - 1 : start + k - 1 + n] + np.uint64(1)
                if k in self.of_size:
                    low, high = self.of_size[k]
                    here = np.flatnonzero(self.table[(hashes[:n] * MIX) >> self.shift] & (room[:n] >= k))
                    own = np.minimum(np.searchsorted(self.hashes[low:high], hashes[here]) + low, high - 1)
                    met = self.hashes[own] == hashes[here]
                    here, own = here[met], own[met]
                    sure = self._held(data, at[here], self.starts[own], k)
                    found.append(np.unique(row[here[sure]] * n_own + own[sure]))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, n_own), pairs % max(1, n_own)

    def rows(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """The ids of texts and the items of the passages that they hold, in batches of bounded size; copies are items each."""
        row, own = self.held(texts)
        until = np.cumsum(self.copies[own])
        for low in range(0, int(until[-1]) if len(until) else 0, ROWS):
            place = np.arange(low, min(low + ROWS, until[-1]))
            pair = np.searchsorted(until, place, "right")
            copy = place - (until[pair] - self.copies[own[pair]])
            yield ids.take(pa.array(row[pair])), self.items.take(pa.array(self.first[own[pair]] + copy))
