"""Periodic runs of words by block convolution, and texts in which each run keeps one period."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelyard.llm.common import byte_rows, ship

LEAST = 6
TIMES = 4
#: primes of the number-theoretic transform, with a generator of each; all below 2**31
PRIMES = ((2013265921, 31), (1811939329, 13), (2113929217, 5))
CELLS = 1 << 19
RUNS = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


# --- exact correlation ----------------------------------------------------------


@cache
def _twiddles(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order ``2 * half``."""
    root = pow(generator, (prime - 1) // (2 * half), prime)
    if inverse:
        root = pow(root, -1, prime)
    out = np.ones(1, np.uint64)
    while len(out) < half:  # doubling: the next powers are the ones so far times a power
        out = np.concatenate((out, out * np.uint64(pow(root, len(out), prime)) % np.uint64(prime)))
    return out


def transform(rows: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (length a power of two); forward leaves, inverse takes, bit-reversed order."""
    m, size = rows.shape
    p = np.uint64(prime)
    halves = [1 << k for k in range(size.bit_length() - 1)]
    for half in halves if inverse else reversed(halves):
        pairs = rows.reshape(m, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        w = _twiddles(prime, generator, half, inverse)
        if inverse:
            b = b * w % p
            out[:, :, 0], out[:, :, 1] = (a + b) % p, (a + p - b) % p
        else:
            out[:, :, 0], out[:, :, 1] = (a + b) % p, (a + p - b) * w % p
        rows = out.reshape(m, size)
    return rows * np.uint64(pow(size, -1, prime)) % p if inverse else rows


def mismatches(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Sums of squared differences, modulo ``prime``, of each block with its window at every place.

    ``windows`` may be up to twice as long as ``blocks``: the transform has that
    length, so no place that fits the window wraps round.
    """
    m, block = blocks.shape
    size, p = 2 * block, np.uint64(prime)
    places = windows.shape[1] - block + 1
    turned = np.zeros((m, size), np.uint64)
    turned[:, 0], turned[:, size - block + 1:] = blocks[:, 0], blocks[:, :0:-1]
    long = np.zeros((m, size), np.uint64)
    long[:, :windows.shape[1]] = windows
    product = transform(turned, prime, generator) * transform(long, prime, generator) % p
    cross = transform(product, prime, generator, inverse=True)[:, :places]
    own = (blocks * blocks % p).sum(axis=1)[:, None]
    sums = np.zeros((m, windows.shape[1] + 1), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=sums[:, 1:])
    there = sums[:, block:] - sums[:, :places]
    return (own + there + (p - cross) * np.uint64(2)) % p


def occurrences(symbols: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block ``symbols[start:start + block]`` that comes again ``low`` to ``high`` places later.

    Exact: as many primes are used as the largest possible sum needs, the later
    ones only for blocks that the earlier ones leave. Symbols are at least 1;
    places behind the end hold 0, which nothing equals.
    """
    width = block + high - low
    padded = np.concatenate((symbols, np.zeros(high + block, symbols.dtype))).astype(np.uint64)
    most, bound = block * int(symbols.max(initial=1)) ** 2, 1
    found = [], []
    primes = []
    for prime in PRIMES:
        primes.append(prime)
        bound *= prime[0]
        if bound > most:
            break
    step = max(1, CELLS // (2 * block))
    for k in range(0, len(starts), step):
        at = starts[k:k + step]
        zero = np.ones((len(at), high - low + 1), bool)
        left = np.arange(len(at))
        for prime in primes:
            blocks = padded[at[left, None] + np.arange(block)]
            windows = padded[at[left, None] + np.arange(low, low + width)]
            zero[left] &= mismatches(blocks, windows, *prime) == 0
            left = left[zero[left].any(axis=1)]
            if not len(left):
                break
        rows, places = np.nonzero(zero)
        found[0].append(at[rows])
        found[1].append(places + low)
    return np.concatenate(found[0]), np.concatenate(found[1])


# --- runs -----------------------------------------------------------------------


def _same(symbols: np.ndarray, i: int, distance: int, way: int) -> int:
    """First place from ``i`` on (way 1), or before it (way -1), that differs from the one ``distance`` later."""
    step, n = 32, len(symbols) - distance
    while 0 <= i < n:
        if way > 0:
            a, b = i, min(i + step, n)
        else:
            a, b = max(i - step + 1, 0), i + 1
        differ = np.flatnonzero(symbols[a:b] != symbols[a + distance:b + distance])
        if len(differ):
            return a + int(differ[0 if way > 0 else -1])
        i, step = (b if way > 0 else a - 1), 2 * step
    return i


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(block length, smallest, largest period) of each dyadic scale.

    A run of period q holds an aligned block of b <= (3 q + 1) / 2 words and that
    block again q words later, because it is at least 4 q words long.
    """
    block = 2
    while (low := -(-(2 * block - 1) // 3)) <= n // TIMES:
        yield block, low, min(-(-(4 * block - 1) // 3) - 1, n // TIMES)
        block *= 2


def find_runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; symbols are whole numbers from 1 on.

    A run is a stretch with smallest period q and a length of at least
    ``max(LEAST, TIMES * q)`` that no neighbour extends. A block is compared only if
    each of its words comes again within the largest distance of the scale and if
    no run of shorter period holds it with its whole window: there, it only
    comes again at multiples of that period.
    """
    n = len(symbols)
    if n < LEAST:
        return []
    order = np.argsort(symbols, kind="stable")
    again = np.full(n, n, np.int64)
    equal = np.flatnonzero(symbols[order[1:]] == symbols[order[:-1]])
    again[order[equal]] = order[equal + 1] - order[equal]
    widest, reach = again, np.zeros(n, np.int64)
    runs: dict[tuple[int, int], int] = {}
    for block, low, high in scales(n):
        even = len(widest) // 2 * 2
        widest = np.maximum(widest[0:even:2], widest[1:even:2])
        starts = np.flatnonzero(widest <= high) * block
        starts = starts[reach[starts] < np.minimum(starts + high + block, n)]
        if not len(starts):
            continue
        at, distance = occurrences(symbols, starts, block, low, high)
        new = reach[at] < at + distance + block
        ends: dict[int, int] = {}
        for s, d in zip(at[new].tolist(), distance[new].tolist(), strict=True):
            if s + block <= ends.get(d, 0):
                continue  # inside the stretch that the last block at this distance gave
            first, last = _same(symbols, s - 1, d, -1) + 1, _same(symbols, s + block, d, 1)
            ends[d] = last
            if last + d - first >= max(LEAST, TIMES * d):
                key = (first, last + d)
                runs[key] = min(runs.get(key, d), d)
                reach[first] = max(reach[first], last + d)
        np.maximum.accumulate(reach, out=reach)
    return sorted((a, b - a, q) for (a, b), q in runs.items())


def symbols_of(words: list[bytes]) -> np.ndarray:
    """Numbers from 1 on, equal for equal words."""
    seen: dict[bytes, int] = {}
    numbers = [seen.setdefault(w, len(seen) + 1) for w in words]
    return np.array(numbers, np.uint16 if len(seen) < 65_535 else np.int64)


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed of every row of ``docs``.

    Words are runs of bytes outside 20, 09-0D, compared as they are; ``collapsed``
    joins by one space the words that no run holds after its first period. Null
    and empty texts have no runs and an empty ``collapsed``; null ids stay null;
    repeated rows give equal rows; an empty table gives none. A text is held whole
    by its task, however long: some tens of bytes a word. Other columns are left
    out, so their names cannot clash.
    """
    ship(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for data in byte_rows(batch.column(1)):
                words = data.split()
                found = find_runs(symbols_of(words))
                runs.append([{"start": a, "length": b, "period": q} for a, b, q in found])
                kept.append(b" ".join(without_repeats(words, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, RUN_TYPE), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", text).mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed string")
