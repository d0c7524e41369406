"""Words and word n-grams of Arrow string columns as 64-bit hashes, by whole-array numpy inside a task.

Texts are taken in chunks of about CHUNK bytes (one longer text alone), so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for stretches of a batch; nulls come as empty texts."""
    column = batch.column(text)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    ends = np.cumsum(np.diff(_offsets(column)))
    at = 0
    while at < len(column):
        begun = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begun + CHUNK, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts in them)."""
    offsets = _offsets(column)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text)."""
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]  # a word ends with its text
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    kept = data[inside]
    if lower:
        kept = _LOWER[kept]
    begin = np.flatnonzero(first[inside])
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    lengths = np.diff(np.append(begin, len(kept)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(lengths.max(), _STEP, np.uint64))
        place = np.arange(len(kept)) - np.repeat(begin, lengths)
        return mix(np.add.reduceat(_TABLE[kept] * powers[place], begin)), counts


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sizes): each text's set of distinct word n-grams, rising within a text; a text of fewer words is one token of all of them."""
    words, counts = word_hashes(column)
    ends = np.repeat(np.cumsum(counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    with np.errstate(over="ignore"):
        grams = np.full(len(words), _STEP, np.uint64)
        for k in range(n):
            there = at + k < ends
            grams = mix(grams * _STEP + np.where(there, words[np.minimum(at + k, len(words) - 1)] if len(words) else words, U(0)) + there.astype(np.uint64))
    short = np.repeat(counts < n, counts)
    head = np.zeros(len(words), bool)
    head[(np.cumsum(counts) - counts)[counts > 0]] = True
    use = np.where(short, head, at + n <= ends)
    grams, text = grams[use], text[use]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=len(counts)).astype(np.int64)


def set_names(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, from its tokens in any order."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    names = []
    with np.errstate(over="ignore"):
        for seed in (1, 2):
            out = np.zeros(len(sizes), np.uint64)
            np.add.at(out, text, mix(tokens * U(2 * seed + 1) + U(seed)))
            names.append(mix(out + sizes.astype(np.uint64)).view(np.int64))
    return names[0], names[1]
