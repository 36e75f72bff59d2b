"""Suffix arrays by induced sorting, with whole arrays instead of single steps.

A suffix is S-type if it is smaller than the next one, else L-type; an S-type place after an L-type one is leftmost-smaller
(LMS). From sorted LMS places one ascending sweep over the buckets of first symbols yields the L-type order and one
descending sweep the S-type order, in linear time. Here a bucket's members, or those that a round within the bucket has
added, induce all their predecessors at once: a stable split by symbol appends them to later buckets.

The LMS places are sorted by a first pair of sweeps over LMS substrings, which are then named; the string of names is
sorted the same way (:func:`suffix_array` again) while its alphabet is small, and by doubling of names when it is not.

Common prefixes come in text order (permuted): a place whose left neighbour extends the match of its predecessor in the
suffix array has that neighbour's length less one, so only the other places are compared.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are swept bucket by bucket.
SMALL_ALPHABET = 1024


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type. The last symbol is a unique smallest one."""
    n = len(text)
    place = np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)
    change = np.minimum.accumulate(place[::-1])[::-1]          # where the run of equal symbols from here ends
    smaller = np.append(text[:-1] < text[1:], True)
    return smaller[change]


def _deal(queues: list[list[np.ndarray]], places: np.ndarray, symbols: np.ndarray) -> None:
    """Append places to the queues of their symbols, keeping their order."""
    if not len(places):
        return
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    cuts = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
    for symbol, part in zip(sorted_[np.concatenate([[0], cuts])], np.split(places[order], cuts), strict=True):
        queues[symbol].append(part)


def _sweep(queues: list[list[np.ndarray]], text: np.ndarray, wanted: np.ndarray, after: list[np.ndarray], symbols: range) -> list[np.ndarray]:
    """One sweep: each bucket's queue is drained in rounds, then ``after`` (its members of the other type) induces too.
    Returns the drained members by bucket. ``wanted`` marks places of the type being induced."""
    done: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queues)
    for c in symbols:
        drained: list[np.ndarray] = []
        while queues[c]:
            current = np.concatenate(queues[c])
            queues[c] = []
            drained.append(current)
            before = current[current > 0] - 1
            before = before[wanted[before]]
            _deal(queues, before, text[before])                # those of the same symbol come back in the next round
        if drained:
            done[c] = np.concatenate(drained)
        if len(after[c]):
            before = after[c][after[c] > 0] - 1
            before = before[wanted[before]]
            _deal(queues, before, text[before])
    return done


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array induced from LMS places in the given order."""
    starts: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(starts, lms, text[lms])
    members = [np.concatenate(q) if q else np.zeros(0, dtype=np.int64) for q in starts]
    larger = _sweep([[] for _ in range(size)], text, ~smaller, members, range(size))
    small = _sweep([[] for _ in range(size)], text, smaller, [x[::-1] for x in larger], range(size - 1, -1, -1))
    small[text[-1]] = np.array([len(text) - 1])                # the end has no successor to induce it
    return np.concatenate([part for c in range(size) for part in (larger[c], small[c][::-1])])


def _named(text: np.ndarray, order: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, bool]:
    """Names of LMS substrings in text order, equal for equal ones; whether all differ. ``order`` sorts the substrings."""
    ends = np.append(places[1:], places[-1])
    length = np.zeros(len(text), dtype=np.int64)
    length[places] = ends - places
    a, b = order[:-1], order[1:]
    differs = length[a] != length[b]
    open_, step = np.flatnonzero(~differs), 0
    while len(open_):                                          # symbol by symbol, while the pair still agrees
        unlike = text[a[open_] + step] != text[b[open_] + step]
        differs[open_[unlike]] = True
        open_ = open_[~unlike & (length[a[open_]] > step)]
        step += 1
    names = np.zeros(len(text), dtype=np.int64)
    names[order] = np.concatenate([[0], np.cumsum(differs)])
    return names[places], bool(differs.all())


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a large alphabet: ranks of 1, 2, 4, ... symbols."""
    n, step = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        pair = rank * (n + 1)                                  # rank and following rank (none: 0) as one number
        pair[:max(0, n - step)] += rank[step:] + 1
        order = np.argsort(pair)
        sorted_ = pair[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. ``text`` holds small non-negative integers and ends in its only 0."""
    if len(text) == 1:
        return np.zeros(1, dtype=np.int64)
    size = int(text.max()) + 1
    if size > SMALL_ALPHABET:
        return _doubled(text)
    smaller = _types(text)
    places = np.flatnonzero(smaller & np.concatenate([[False], ~smaller[:-1]]))
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[places] = True
    induced = _induce(text, smaller, places, size)
    names, distinct = _named(text, induced[is_lms[induced]], places)
    order = np.argsort(names) if distinct else suffix_array(names)     # the end keeps the only name 0
    return _induce(text, smaller, places[order], size)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """For each place the length, ``most`` at most, that it has in common with its predecessor in ``order``.

    ``fresh`` marks places that start anew (a new snippet): they are compared even if their neighbour's match would tell,
    so that a capped length is only ever carried on within one snippet.
    """
    n = len(text)
    previous = np.zeros(n, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    previous[order[0]] = n - 1
    left = np.concatenate([[True], (previous[1:] == 0) | (text[:-1] != text[previous[1:] - 1])])
    compared = np.flatnonzero(left | fresh)
    padded = np.concatenate([text, np.full(8, -1)]).astype(np.int16).astype(np.uint8)
    words = np.zeros(n + 1, dtype=np.uint64)
    for k in range(8):
        words[:n] |= padded[k:n + k].astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(len(compared), dtype=np.int64)
    open_ = np.arange(len(compared))
    while len(open_):                                          # eight symbols at a time
        a, b = np.minimum(compared[open_] + length[open_], n), np.minimum(previous[compared[open_]] + length[open_], n)
        same = (words[a] == words[b]) & (a < n - 8) & (b < n - 8)
        rest = open_[~same]
        a, b = a[~same], b[~same]
        more = np.ones(len(rest), dtype=bool)
        for k in range(8):
            more &= (a + k < n) & (b + k < n) & (text[np.minimum(a + k, n - 1)] == text[np.minimum(b + k, n - 1)])
            length[rest] += more
        length[open_[same]] += 8
        open_ = open_[same]
        open_ = open_[length[open_] < most]
    carried = np.zeros(n, dtype=np.int64)
    carried[compared] = np.arange(len(compared))
    last = np.maximum.accumulate(carried)                      # place 0 is always compared
    return np.minimum(np.maximum(length[last] - (np.arange(n) - compared[last]), 0), most)
