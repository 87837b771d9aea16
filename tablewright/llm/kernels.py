"""Word boundaries and 64-bit word hashes of many texts at once, in numpy.

A batch of texts is one byte buffer with a space between texts, so that a word
never crosses two of them. Everything is vectorised over the words of the batch;
batches are cut by bytes (`batches`), never inside a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

BATCH_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Letters, digits and all non-ASCII bytes form tokens; everything else parts them.
PARTED = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_U = np.uint64
# Odd 64-bit constants of the splitmix64 finalizer (fixed values).
_K0, _K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x + _K0
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of a batch: byte bounds in the buffer, text index, and first word of each text."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # len(texts) + 1 positions in the word arrays
    hash: np.ndarray

    def string(self, i: int) -> str:
        return self.buffer[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")


def batches(texts: Sequence[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) of runs of about ``limit`` bytes; null texts are empty."""
    begin, size, run = 0, 0, []
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and size + len(raw) > limit:
            yield begin, run
            begin, size, run = i, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield begin, run


def words(raws: Sequence[bytes], lower: bool = False, breaks: np.ndarray = _SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts, or runs of bytes that ``breaks`` allows; ``lower`` folds A-Z before hashing."""
    buffer = np.frombuffer(b" ".join([b"", *raws, b""]) + b"        ", np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    edge = np.flatnonzero(np.diff(breaks[buffer].view(np.int8))) + 1  # words begin and end alternately
    start, end = edge[0::2], edge[1::2]
    offsets = np.cumsum([1, *[len(r) + 1 for r in raws]])
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(raws)), np.diff(first))
    return Words(buffer, start, end, text, first, _hash(buffer, start, end - start))


def _hash(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Folds each word in 8-byte pieces; the length is part of the hash."""
    pieces = np.ndarray(max(0, len(buffer) - 7), "<u8", buffer=np.ascontiguousarray(buffer).data, strides=(1,))
    out = mix(length.astype(np.uint64))
    live, at, left = np.arange(len(start)), start, length
    while len(live):
        piece = pieces[at] & _MASKS[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ piece)
        keep = left > 8
        live, at, left = live[keep], at[keep] + 8, left[keep] - 8
    return out


def beginnings(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the first ``n`` bytes of every word with more; unlike the hash of the same bytes as a word."""
    longer = np.flatnonzero(w.end - w.start > n)
    return w.text[longer], mix(_hash(w.buffer, w.start[longer], np.full(len(longer), n)) ^ _U(n))


def window_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, in order; empty if there are fewer."""
    if len(w) < n:
        return w[:0]
    acc = mix(w[: len(w) - n + 1])
    for k in range(1, n):
        acc = mix(acc ^ w[k : len(w) - n + 1 + k])
    return acc


def shingle_sets(raws: Sequence[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of each text, A-Z folded.

    A text with fewer words has its whole sequence as its one shingle; a text without words none.
    """
    w = words(raws, lower=True)
    out = []
    for i in range(len(raws)):
        own = w.hash[w.first[i] : w.first[i + 1]]
        out.append(np.unique(window_hashes(own, min(n, max(1, len(own))))))
    return out
