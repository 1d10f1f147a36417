"""Word and shingle hashes of Arrow string columns, computed with numpy over whole byte buffers.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``, with A-Z lower-cased. Its hash is a polynomial over
the bytes (prefix sums modulo 2**64), so one pass serves all words of a window. Windows end between words, which bounds
the memory however long a text is; no text is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)
_LOWER += np.uint64(1)
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = [not chr(c).isalnum() for c in range(0x21, 0x7F)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other and the n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(
    texts: pa.Array | pa.ChunkedArray,
    heads: tuple[int, ...] = (),
    found_heads: list[np.ndarray] | None = None,
    trim: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n + 1 offsets of each text's words.

    Up to ``trim`` ASCII signs that are neither letters nor digits are left out at either end of a word that has more.
    For each length in ``heads``, ``found_heads`` gets an array of hashes of the words' first so many bytes (0 for shorter words).
    """
    raw, at = bytes_of(texts)
    found, starts_at = [], []
    parts: list[list[np.ndarray]] = [[] for _ in heads]
    begin = 0
    while begin < len(raw):
        end = min(begin + WINDOW, len(raw))
        while end < len(raw):  # a window ends at a space or where a text begins
            gap = np.flatnonzero(_SPACE[raw[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(raw))
        part = raw[begin:end]
        inside = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        cuts = at[np.searchsorted(at, begin) : np.searchsorted(at, end, "right")] - begin
        edge[cuts] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        starts_at.append(starts + begin)
        for _ in range(trim):
            starts = starts + (_SIGN[part[starts]] & (ends - starts > 1))
            ends = ends - (_SIGN[part[ends - 1]] & (ends - starts > 1))
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER[part] * up[: len(part)], out=sums[1:])
        values = (sums[ends] - sums[starts]) * down[starts]
        found.append(mixed(values + (ends - starts).astype(np.uint64)))
        for n, own in zip(heads, parts):
            stop = np.minimum(starts + n, len(part))
            head = mixed((sums[stop] - sums[starts]) * down[starts] + np.uint64(n << 32))
            head[ends - starts < n] = 0
            own.append(head)
        begin = end
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if found_heads is not None:
        found_heads += [np.concatenate(own) if own else np.zeros(0, np.uint64) for own in parts]
    places = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return words, np.searchsorted(places, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, repeats included, and offsets by text.

    A text of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    counts = np.diff(at)
    rng = np.random.default_rng(k)
    odd = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    runs = max(len(words) - k + 1, 0)
    full = np.zeros(runs, np.uint64)
    for j in range(k):
        full += words[j : j + runs] * odd[j]
    full = mixed(full)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate(([0], np.cumsum(out_counts)))
    out = np.zeros(int(out_at[-1]), np.uint64)
    owner = np.repeat(np.arange(len(counts)), out_counts)
    source = np.arange(len(out)) - out_at[owner] + at[:-1][owner]
    long = counts[owner] >= k
    out[long] = full[source[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[at[i] : at[i + 1]]
        with np.errstate(over="ignore"):
            out[out_at[i]] = mixed(np.array([np.sum(own * odd[: len(own)]) + np.uint64(len(own))], np.uint64))[0]
    return out, out_at


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int):
    """Yields the sorted distinct shingle hashes of each text."""
    values, at = shingle_hashes(*word_hashes(texts), k)
    for i in range(len(at) - 1):
        yield np.unique(values[at[i] : at[i + 1]])
