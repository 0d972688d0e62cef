"""Simple-8b: runs of integers in 64-bit words, four bits of selector and 60 of payload, in numpy.

A selector says how many values of how many bits its word holds. Values of more than 60 bits are an
escape: a word that says so and the value in the word after it. Values are coded in blocks that start
at a word of their own, so that blocks decode in any order and all words of a kind decode at once.
"""

from __future__ import annotations

import numpy as np

#: (values in a word, bits of each), by selector; selector 0 is the escape.
SELECTORS = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 2048


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """How many bits each uint64 value needs; 1 for 0."""
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    if not len(values) or int(values.max()) < 1 << 32:
        return np.maximum(low, 1)
    high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1]
    return np.maximum(np.where(high > 0, high + 32, low), 1)


def _choices(bits: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """For each value, the selector with most values that a word which starts there can have inside its block."""
    longest = max(c for c, _ in SELECTORS)
    padded = np.full(blocks * block, 255, np.uint8)
    padded[: len(bits)] = bits
    grid = np.full((blocks, block + longest), 255, np.uint8)
    grid[:, :block] = padded.reshape(blocks, block)
    choice = np.zeros((blocks, block), np.uint8)
    widest, have = grid.copy(), 1  # widest[i]: the most bits of the values i to i + have
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, width = SELECTORS[selector]
        while have < count:
            step = min(have, count - have)
            widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            have += step
        np.putmask(choice, widest[:, :block] <= width, selector)
    return choice.reshape(-1)[: len(bits)]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first): the words, and where each block of ``block`` values begins in them (one more than blocks)."""
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    choice = _choices(bit_lengths(values).astype(np.uint8), block, blocks)
    counts = np.array([c for c, _ in SELECTORS])
    at = np.arange(blocks) * block
    ends = np.minimum(at + block, n)
    taken, kinds, owners = [], [], []
    live = np.arange(blocks)
    while len(live):  # one word of every block at a time
        kind = choice[at[live]]
        taken.append(at[live].copy())
        kinds.append(kind)
        owners.append(live)
        at[live] += counts[kind]
        live = live[at[live] < ends[live]]
    start, kind, owner = np.concatenate(taken), np.concatenate(kinds), np.concatenate(owners)
    order = np.argsort(start)
    start, kind, owner = start[order], kind[order], owner[order]
    size = np.where(kind == 0, 2, 1)
    place = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(int(place[-1]), np.uint64)
    words[place[:-1]] = kind.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(kind == selector)
        if not len(mine):
            continue
        if not selector:
            words[place[mine] + 1] = values[start[mine]]
            continue
        packed = np.zeros(len(mine), np.uint64)
        for j in range(count):
            packed |= values[start[mine] + j] << np.uint64(width * j)
        words[place[mine]] |= packed
    first = np.concatenate([place[np.searchsorted(owner, np.arange(blocks))], [len(words)]]).astype(np.int64)
    return words, first


def decode(words: np.ndarray, escaped: bool = True) -> np.ndarray:
    """The values of whole blocks. ``escaped``: False if it is known that no word is an escape."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    if escaped and (kind == 0).any():
        raw = np.zeros(len(words), bool)
        for k in np.flatnonzero(kind == 0):  # in order: what follows an escape is no word with a selector
            if not raw[k]:
                raw[k + 1] = True
        kind[raw] = -1
    counts = np.where(kind >= 0, np.array([c for c, _ in SELECTORS])[kind], 0)
    place = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(place[-1]), np.uint64)
    for selector, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(kind == selector)
        if not len(mine):
            continue
        if not selector:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << width) - 1)
        for j in range(count):
            out[place[mine] + j] = (words[mine] >> np.uint64(width * j)) & mask
    return out
