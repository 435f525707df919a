"""Simple-8b: integers packed into 64-bit words, in blocks that decode by themselves.

A word has a 4-bit selector on top and 60 bits of payload; the selector says how many
values of which width follow, lowest bits first.  Selector 0 is the escape: its payload
is an index into the block's list of raw 64-bit values, for those that need over 60 bits.
A block holds ``BLOCK`` values (the last one fewer), so all blocks of a chunk are packed
and unpacked together by array operations; only the length of the longest chain of words
in a block is a loop.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
# The format's selectors 1 to 15, as (values in a word, bits of each).
SELECTORS = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([1] + [n for n, _ in SELECTORS], dtype=np.int64)
WIDTH = np.array([0] + [b for _, b in SELECTORS], dtype=np.uint64)
_PAD = int(COUNT.max())
_TOP = np.uint64(60)


_SMALL = np.array([x.bit_length() for x in range(1 << 16)], dtype=np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs (0 for 0)."""
    if values.size and values.max() < _SMALL.size:
        return _SMALL[values.astype(np.intp)]
    bits = np.zeros(values.shape, np.uint8)
    rest = values.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1 << step)
        bits[high] += step
        rest[high] >>= np.uint64(step)
    return bits + (rest > 0)


def _plan(bits: np.ndarray) -> np.ndarray:
    """For each position the selector that packs the most values from there."""
    n = bits.shape[1] - _PAD
    doubled, size = {1: bits}, 1
    while size < _PAD // 2:
        x = doubled[size]
        doubled[size * 2] = np.maximum(x[:, : x.shape[1] - size], x[:, size:])
        size *= 2
    fitting = np.zeros((bits.shape[0], n), np.uint8)
    for count, width in SELECTORS:  # a start that fits one fits all later ones, of fewer and wider values
        size = 1 << (count.bit_length() - 1)
        x = doubled[size]
        most = x[:, :n] if size == count else np.maximum(x[:, :n], x[:, count - size : count - size + n])
        fitting += most <= width
    return np.where(fitting > 0, np.uint8(len(SELECTORS) + 1) - fitting, np.uint8(0))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, raw values, and per block the number of words and of raw values."""
    values = np.ascontiguousarray(values)
    if values.dtype not in (np.uint16, np.uint32):
        values = values.astype(np.uint64)
    total, blocks = len(values), -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grid = np.zeros((blocks, BLOCK + _PAD), values.dtype)
    whole = total // BLOCK
    grid[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        grid[whole, : total - whole * BLOCK] = values[whole * BLOCK :]
    best = _plan(bit_lengths(grid))
    limit = np.full(blocks, BLOCK, np.int64)
    limit[-1] = total - (blocks - 1) * BLOCK
    at, lane = np.zeros(blocks, np.int64), np.arange(blocks)
    rows, cols = [], []
    while len(lane):
        rows.append(lane)
        cols.append(at)
        at = at + COUNT[best[lane, at]]
        on = at < limit[lane]
        lane, at = lane[on], at[on]
    # The k-th word of a block is made in step k: that gives its place without sorting.
    steps = np.bincount(np.concatenate(rows), minlength=blocks)
    begins = np.cumsum(steps) - steps
    row, col = np.empty(int(steps.sum()), np.int64), np.empty(int(steps.sum()), np.int64)
    for k, (r, c) in enumerate(zip(rows, cols, strict=True)):
        row[begins[r] + k], col[begins[r] + k] = r, c
    selector = best[row, col]
    words = selector.astype(np.uint64) << _TOP
    flat, width = grid.ravel(), grid.shape[1]
    for s in range(2, len(SELECTORS) + 1):
        mine = np.nonzero(selector == s)[0]
        start = row[mine] * width + col[mine]
        packed = np.zeros(len(mine), np.uint64)
        for k in range(COUNT[s]):
            packed |= flat[start + k].astype(np.uint64) << np.uint64(k * int(WIDTH[s]))
        words[mine] |= packed
    escaped = np.nonzero(selector == 0)[0]
    raw = flat[row[escaped] * width + col[escaped]].astype(np.uint64)
    raw_counts = np.bincount(row[escaped], minlength=blocks).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(raw_counts)])
    words[escaped] |= (np.arange(len(escaped)) - first[row[escaped]]).astype(np.uint64)
    return words, raw, steps.astype(np.int64), raw_counts


def unpack(words: np.ndarray, raw: np.ndarray, word_counts: np.ndarray, raw_counts: np.ndarray, value_counts: np.ndarray) -> np.ndarray:
    """The values of whole blocks, in order."""
    selector = (words >> _TOP).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    block = np.repeat(np.arange(len(word_counts)), word_counts)
    counts = COUNT[selector]
    sums = np.concatenate([[0], np.cumsum(counts)])
    first_word = np.concatenate([[0], np.cumsum(word_counts)])
    value_ends = np.cumsum(value_counts)
    first_value = value_ends - value_counts
    # Where a word's values start; the last word of a block may promise more than it has.
    start = first_value[block] + sums[:-1] - sums[first_word[block]]
    out = np.zeros(int(value_ends[-1]) + _PAD if len(value_ends) else 0, np.uint64)
    for s in range(2, len(SELECTORS) + 1):
        mine = np.nonzero(selector == s)[0]
        if len(mine):
            at, bits, mask, ends = start[mine], payload[mine], np.uint64((1 << int(WIDTH[s])) - 1), value_ends[block[mine]]
            for k in range(COUNT[s]):
                on = at + k < ends
                out[(at + k)[on]] = ((bits >> np.uint64(k * int(WIDTH[s]))) & mask)[on]
    escaped = np.nonzero(selector == 0)[0]
    if len(escaped):
        first_raw = np.concatenate([[0], np.cumsum(raw_counts)])
        out[start[escaped]] = raw[first_raw[block[escaped]] + payload[escaped].astype(np.int64)]
    return out[: int(value_ends[-1])] if len(value_ends) else out
