"""Word and shingle hashes of Arrow batches, in numpy without a Python step per word.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage
return.  Words hash to 64 bits by a multilinear sum over their bytes with fixed random factors:
two different words meet with a probability below 2^-56.  Shingles combine the hashes of
neighbouring words and are mixed once more, so that their order is as good as random."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
#: Bytes handled at once: the working arrays take about 40 times as much.
_CHUNK = 1 << 19
#: Words longer than this are hashed one by one.
_LONG = 1024

_random = np.random.Generator(np.random.PCG64(20240229))
_FACTOR = _random.integers(0, 2**64, _LONG, dtype=np.uint64) | _U(1)
_PLACE = _random.integers(0, 2**64, 64, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each text begins and ends; null is empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _hash_chunk(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece of text; words also end at the cuts."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = data[inside]
    if lower:
        letters = _LOWER[letters]
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    long = np.flatnonzero(lengths > _LONG)
    if len(long):
        place %= _LONG
    hashes = np.add.reduceat((letters.astype(np.uint64) + _U(1)) * _FACTOR[place], begin)
    for i in long.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(letters[begin[i] : begin[i] + lengths[i]].tobytes())
    return hashes, starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more at
    the end).  Works through the bytes in chunks cut at white space, so a long text takes memory
    for its word hashes only."""
    lo, end = int(offsets[0]), int(offsets[-1])
    found, places = [], []
    while lo < end:
        hi = min(end, lo + _CHUNK)
        if hi < end:
            space = np.flatnonzero(_SPACE[data[lo:hi]])
            while not len(space) and hi < end:  # one word over a whole chunk
                hi = min(end, hi + _CHUNK)
                space = np.flatnonzero(_SPACE[data[lo:hi]])
            if hi < end:
                hi = lo + int(space[-1]) + 1
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        hashes, starts = _hash_chunk(data[lo:hi], cuts, lower)
        found.append(hashes)
        places.append(starts + lo)
        lo = hi
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words inside one text, in order, and where each text's
    begin.  A text with fewer words, but at least one, has its whole sequence as its one shingle."""
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(n)])
    if len(words) >= size:
        windows = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            windows += words[j : len(words) - size + 1 + j] * _PLACE[j]
    else:
        windows = np.zeros(0, np.uint64)
    full = counts >= size
    pick = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    whole = np.repeat(full, n)
    out = np.zeros(begin[-1], np.uint64)
    out[whole] = windows[pick[whole]]
    for i in np.flatnonzero(~full & (counts > 0)).tolist():
        own = words[first[i] : first[i + 1]]
        out[begin[i]] = np.append(own * _PLACE[: len(own)], _PLACE[32 + len(own)]).sum(dtype=np.uint64)
    return mix(out), begin


def pieces(texts: pa.Array, most: int = 1 << 21):
    """Slices of a string array of about `most` bytes each, with the index of their first text."""
    _, offsets = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def shingle_sets(texts: pa.Array, size: int, lower: bool = False):
    """For each text its sorted distinct shingle hashes."""
    for _, part in pieces(texts):
        words, first = word_hashes(*text_bytes(part), lower)
        hashes, begin = shingle_hashes(words, first, size)
        for i in range(len(part)):
            own = np.sort(hashes[begin[i] : begin[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
