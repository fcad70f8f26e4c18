"""Vectorised hashing over many texts at once: bytes, words and word shingles as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** k and its inverse, for k from 0 to n, mod 2 ** 64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            steps = np.full(2 * n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (of splitmix64's kind)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about `most` bytes together, one text at least."""
    at = 0
    while at < len(texts):
        upto, n = at, 0
        while upto < len(texts) and (upto == at or n + len(texts[upto]) <= most):
            n += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences, times the inverse power at the start, are hashes of substrings."""
    p, inv = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return sums, inv


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of disjoint ascending spans of bytes. Sums are made block by block, so that neither they nor the
    powers grow with a text; what a span has in later blocks is added to it there."""
    h = np.zeros(len(starts), np.uint64)
    for a in range(0, len(raw), block):
        b = min(a + block, len(raw))
        first, upto = np.searchsorted(starts, (a, b))
        sums, inv = prefix_hashes(raw[a:b])
        s, e = starts[first:upto] - a, np.minimum(ends[first:upto], b) - a
        h[first:upto] = (sums[e] - sums[s]) * inv[s]
        if first and ends[first - 1] > a:  # one span at most reaches over from the block before
            k = first - 1
            part = int(sums[min(int(ends[k]), b) - a]) * pow(int(MULTIPLIER), a - int(starts[k]), 1 << 64)
            h[k] = np.uint64((int(h[k]) + part) % (1 << 64))
    return mix(h + (ends - starts).astype(np.uint64))


def word_spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, by a mask of the bytes between them, of which the last is one."""
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.append(0, edge)
    return edge[0::2], edge[1::2]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: For words without punctuation: every ASCII character but letters and digits.
IS_PUNCTUATION = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])


def word_hashes(texts: list[bytes], cut: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered, cut at the bytes of `cut`), and each text's word count."""
    raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    starts, ends = word_spans(cut[raw])
    h = span_hashes(raw, starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    return h, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; the whole sequence where words are fewer."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = len(words)
    roll = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(size)]
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        full += words[k : n - size + 1 + k] * roll[k]
    full = mix(full + np.uint64(size))
    out = []
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        m = end - begin
        if m >= size:
            out.append(np.unique(full[begin : end - size + 1]))
        elif m:
            whole = sum((int(w) * int(r) for w, r in zip(words[begin:end], roll)), m) % (1 << 64)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def whole_groups(batches: Iterator, column: str, most_bytes: int = 8_000_000) -> Iterator:
    """Tables of sorted batches, cut where `column` changes: a group is never split, and a table holds more
    than about most_bytes only where one group does."""
    import pyarrow as pa

    held: list = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most_bytes:
            continue
        t = pa.Table.from_batches(held)
        values = t.column(column).to_numpy()
        others = np.flatnonzero(values != values[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield t.slice(0, cut)
        held, size = t.slice(cut).to_batches(), 0  # the next look comes after as many bytes again
    if held:
        yield pa.Table.from_batches(held)
