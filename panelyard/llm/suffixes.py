"""Suffix arrays by induced sorting and permuted common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np

#: characters are induced in groups of neighbours, so that large alphabets need no step for each character
GROUPS = 256
GROUP_LEAST = 1024


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (type S); the last character is the only smallest one."""
    step = np.sign(np.diff(s))
    last = len(step)  # of equal neighbours the next different ones decide
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(last), last)[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def _buckets(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each character's suffixes, with the end of the last, and the characters' groups."""
    begin = np.concatenate(([0], np.cumsum(np.bincount(s))))
    groups = max(1, min(GROUPS, len(s) // GROUP_LEAST))
    cuts = np.searchsorted(begin, np.linspace(0, len(s), groups + 1), "right") - 1
    return begin, np.unique(np.append(np.clip(cuts, 0, len(begin) - 1), [0, len(begin) - 1]))


def _by_character(s: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The suffixes ``of``, by character; few characters are counted, not compared."""
    chars = s[of]
    return of[np.argsort(chars.astype(np.uint16) if s.max() < 1 << 16 else chars, kind="stable")]


def _induce(s: np.ndarray, of: np.ndarray, place: np.ndarray, begin: np.ndarray, cuts: np.ndarray, upward: bool) -> None:
    """Give ``place`` to the suffixes ``of`` one type (sorted by character): by character, then by the place of the next suffix.

    Groups of characters go upward for type L (places from the front of each
    bucket) and downward for type S (from its back). The next suffix has its
    place already, unless it is of the same group. In a group of one character,
    such a suffix lies behind (S: before) all that have the next one's place, in
    that one's order. In a group of several, chains are short, and the group is
    put in order again until nothing moves.
    """
    chars = s[of]
    bounds = np.searchsorted(chars, cuts)
    count = np.bincount(chars, minlength=len(begin) - 1)
    first = begin[:-1] if upward else begin[1:] - count
    n = np.int64(len(s))
    groups = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1].tolist(), np.diff(cuts).tolist(), strict=True))
    for a, b, char, width in groups if upward else reversed(groups):
        if a == b:
            continue
        own = of[a:b]
        behind = place[own + 1]
        if width == 1:
            known = behind >= 0
            wave = own[known]
            wave = wave[np.argsort(behind[known])]
            waves, left = [wave], b - a - len(wave)
            while left:  # before place 0 comes, by index -1, the last character, which is no other
                wave = wave[s[wave - 1] == char] - 1
                waves.append(wave)
                left -= len(wave)
            place[np.concatenate(waves if upward else waves[::-1])] = np.arange(first[char], first[char] + b - a)
            continue
        char = chars[a:b]
        # the k-th suffix of a character has the k-th of its places
        slots = first[char] + np.arange(b - a) - np.searchsorted(char, char)
        chained = (behind < 0).any()
        place[own] = slots
        while True:
            order = np.argsort(char * n + place[own + 1])  # all different
            moved = own[order]
            if not chained or (place[moved] == slots).all():
                place[moved] = slots
                break
            place[moved] = slots


def _sorted_by(s: np.ndarray, types: tuple[np.ndarray, np.ndarray], seeds: np.ndarray, begin: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Place of every suffix, induced from the leftmost-smaller ones in the order ``seeds``; ``types`` are all L and all S by character."""
    n = len(s)
    place = np.full(n + 1, -1, np.int32)
    chars = s[seeds]
    order = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=len(begin) - 1)
    chars = chars[order]
    place[seeds[order]] = begin[chars + 1] - count[chars] + np.arange(len(seeds)) - np.searchsorted(chars, chars)
    _induce(s, types[0], place, begin, cuts, True)
    place[types[1]] = -1
    place[n - 1] = 0  # the end, before all others
    _induce(s, types[1], place, begin, cuts, False)
    return place[:n]


def _names(s: np.ndarray, left: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Number of each leftmost-smaller substring, in text order: equal substrings share one."""
    index = np.zeros(len(s), np.int32)
    index[left] = np.arange(len(left))
    ends = np.append(left[1:], len(s) - 1)
    length = (ends - left + 1)[index[ordered]]
    a, b = ordered[:-1], ordered[1:]
    equal = length[:-1] == length[1:]
    open_, k = np.flatnonzero(equal), 0
    while len(open_):
        open_ = open_[k < length[open_]]
        same = s[a[open_] + k] == s[b[open_] + k]
        equal[open_[~same]] = False
        open_, k = open_[same], k + 1
    names = np.zeros(len(left), np.int32)
    names[index[ordered]] = np.concatenate(([0], np.cumsum(~equal)))
    return names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. The last character must be 0 and the only 0.

    Suffixes are classified, the leftmost-smaller substrings sorted by inducing
    and numbered, their order found recursively where numbers repeat, and all
    suffixes induced from it.
    """
    s = s.astype(np.int32)  # a shard is far below 2**31 characters
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    small = classify(s)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    begin, cuts = _buckets(s)
    types = _by_character(s, np.flatnonzero(~small).astype(np.int32)), _by_character(s, np.flatnonzero(small)[:-1].astype(np.int32))
    place = _sorted_by(s, types, left, begin, cuts)
    ordered = left[np.argsort(place[left])]
    names = _names(s, left, ordered)
    if names.max(initial=0) + 1 < len(left):
        ordered = left[suffix_array(names)]
    place = _sorted_by(s, types, ordered, begin, cuts)
    out = np.empty(n, np.int32)
    out[place] = np.arange(n)
    return out


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length that each suffix of the bytes ``data`` shares with the one before it in ``order``, by text place.

    Only at a place whose preceding byte differs from that of its neighbour a
    length is found by comparing, eight bytes at once; after it each place has one less.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prior = np.maximum(before, 0)
    at = np.arange(n)
    whole = (at > 0) & (before > 0)
    anew = ~whole
    anew[whole] = data[at[whole] - 1] != data[prior[whole] - 1]
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(16, np.uint8))), 8)
    places = np.flatnonzero(anew & (before >= 0))
    shared = np.zeros(n, np.int64)
    open_, k = places, 0
    while len(open_):
        room = n - np.maximum(open_, before[open_]) - k  # bytes up to the end of the text
        a, b = open_ + np.minimum(k, n), before[open_] + np.minimum(k, n)
        differ = np.ascontiguousarray(eight[np.minimum(a, n)]) != np.ascontiguousarray(eight[np.minimum(b, n)])
        some = differ.any(axis=1)
        got = np.minimum(np.where(some, differ.argmax(axis=1), 8), room)
        shared[open_] += got
        open_, k = open_[(got == 8) & ~some], k + 8
    last = np.maximum.accumulate(np.where(anew, at, 0))
    return np.maximum(shared[last] - (at - last), 0)
