"""Sampled segmentations over a piece lattice: forward filtering, backward sampling, lossless decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import blake2b
from math import exp, log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from panelyard.llm.common import mix64, power_tables, ship, texts, tidied

SPACE = "▁"
SMOOTH = 2e-4
#: characters whose segments are sampled together, and length up to which a segment's lattice is held whole
SLAB, WHOLE = 1 << 21, 1024
_BORDER = re.compile("(?<=[^ ]) ")


class Lattice:
    """Pieces of a model, and the lattices of text segments.

    No piece holds the space mark after another character, so a text falls
    into segments, each a run of spaces and what follows it, whose
    segmentations are independent: sampling them one by one samples the text.
    The distinct segments of a slab are filtered together, one position of each
    a step, and so are all their occurrences sampled.
    """

    _made: dict[tuple[str, float], Lattice] = {}

    @classmethod
    def of(cls, path: str, smooth: float) -> Lattice:
        if (path, smooth) not in cls._made:
            cls._made[path, smooth] = cls(path, smooth)
        return cls._made[path, smooth]

    def __init__(self, path: str, smooth: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        kind = [(model.is_control(i) or model.is_unknown(i), model.is_byte(i)) for i in range(size)]
        names = [None if any(kind[i]) else model.id_to_piece(i) for i in range(size)]
        self.weight = {p: (i, smooth * model.get_score(i), len(p)) for i, p in enumerate(names)
                       if p is not None and SPACE not in p.lstrip(SPACE)}
        self.byte = np.zeros(256, np.int32)
        self.raw = [b"" if p is None else p.replace(SPACE, " ").encode() for p in names]
        for i in range(size):
            if kind[i][1]:
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte[value], self.raw[i] = i, bytes([value])
        self.longest = max(map(len, self.weight))
        self.fallback = min(w[1] for w in self.weight.values()) - 1.0
        self.prefixes = {p[:k]: 0 for p in self.weight for k in range(1, len(p) + 1)}
        self._grow()

    def _grow(self) -> None:
        """A trie of the pieces in arrays: steps are sorted numbers of (node, character)."""
        self.prefixes.update((p, k) for k, p in enumerate(sorted(self.prefixes), 1))
        alphabet = sorted({p[-1] for p in self.prefixes})
        self._width = len(alphabet) + 1  # number 0 is any other character
        number = {c: k for k, c in enumerate(alphabet, 1)}
        self._number = np.zeros(0x110000, np.int32)
        self._number[[ord(c) for c in alphabet]] = np.arange(1, self._width)
        self._number[32], self._number[ord(SPACE)] = self._number[ord(SPACE)], 0  # a mark in the text is literal
        kind = np.int32 if self._width * (len(self.prefixes) + 1) < 1 << 31 else np.int64
        steps = sorted((self.prefixes.get(p[:-1], 0) * self._width + number[p[-1]], k) for p, k in self.prefixes.items())
        self._hash(np.array([k for k, _ in steps], kind), np.array([n for _, n in steps], kind))
        self._root = np.zeros(self._width, kind)
        self._root[[number[p] for p in self.prefixes if len(p) == 1]] = [k for p, k in self.prefixes.items() if len(p) == 1]
        self._id, self._value = np.full(len(steps) + 1, -1, np.int32), np.zeros(len(steps) + 1)
        for p, (i, value, _) in self.weight.items():
            self._id[self.prefixes[p]], self._value[self.prefixes[p]] = i, value

    def _hash(self, steps: np.ndarray, nodes: np.ndarray) -> None:
        """A table of the steps, at least three quarters empty: each lies at its hash or at the next free place after it."""
        bits = max(4, (4 * len(steps) - 1).bit_length())
        self._shift = np.uint64(64 - bits)
        table = np.full(1 << bits, -1, np.int64)
        free, left = self._place(steps), np.arange(len(steps))
        while len(left):
            open_ = left[table[free[left]] < 0]
            table[free[open_]] = open_  # of several for one place the last stays
            left = left[table[free[left]] != left]
            free[left] = (free[left] + 1) & (len(table) - 1)
        self._steps = np.append(steps, steps.dtype.type(-1))[table]
        self._next = np.append(nodes, nodes.dtype.type(0))[table]

    def _place(self, steps: np.ndarray) -> np.ndarray:
        return ((steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _follow(self, wanted: np.ndarray) -> np.ndarray:
        """Node that each step leads to, 0 for none."""
        at = self._place(wanted)
        step = self._steps[at]
        node = np.where(step == wanted, self._next[at], 0)
        open_ = np.flatnonzero((step != wanted) & (step >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self._steps) - 1)
            step = self._steps[at[open_]]
            hit = step == wanted[open_]
            node[open_[hit]] = self._next[at[open_[hit]]]
            open_ = open_[~hit & (step >= 0)]
        return node

    def _pieces(self, marked: str, start: int) -> list[tuple[int, float, int]]:
        """(end, weight, code) of what may follow at ``start``; a code from ``size`` on is a character, which goes as bytes."""
        found, weight, prefixes = [], self.weight, self.prefixes
        for end in range(start + 1, min(len(marked), start + self.longest) + 1):
            part = marked[start:end]
            if part not in prefixes:
                break
            piece = weight.get(part)
            if piece is not None:
                found.append((end, piece[1], piece[0]))
        if not found or found[0][0] > start + 1:
            char = " " if marked[start] == SPACE else marked[start]
            found.append((start + 1, len(char.encode()) * self.fallback, self.size + ord(char)))
        return found

    @staticmethod
    def _mass(ways: list[tuple[float, int, int]]) -> tuple[float, list[float]]:
        """Log of the summed weights, and their running shares."""
        if len(ways) == 1:
            return ways[0][0], [1.0]
        top, mass, sums = max(ways)[0], 0.0, []
        for w, _, _ in ways:
            mass += exp(w - top)
            sums.append(mass)
        return top + log(mass), [s / mass for s in sums]

    def _matches(self, raw: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Starts, length, codes and weights of all pieces within segments, by length; ``after`` is where a start's segment ends.

        A character that is no piece of its own goes as its bytes.
        """
        char = self._number[raw]
        node = self._root[char]
        live = np.flatnonzero(node)
        node = node[live]
        for length in range(1, self.longest + 1):
            if length > 1:
                node = self._follow(node * self._steps.dtype.type(self._width) + char[live + length - 1])
                there = np.flatnonzero(node)
                live, node = live[there], node[there]
            ids = self._id[node]
            if length == 1:
                code, value = raw + self.size, (1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)) * self.fallback
                own = ids >= 0
                code[live[own]], value[live[own]] = ids[own], self._value[node[own]]
                yield np.arange(len(raw)), 1, code, value
            else:
                own = ids >= 0
                yield live[own], length, ids[own], self._value[node[own]]
            longer = live + length < after[live]
            live, node = live[longer], node[longer]

    def _filter(self, segments: list[str], size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filtering of segments, the longest first.

        A node is an end position within a segment; nodes lie by position, then
        segment. Returned are the first node of each position; the first way of
        each node; and per way the running share of its node's probability,
        its start position and its code.
        """
        raw = np.frombuffer("".join(segments).encode("utf-32-le"), np.int32)
        rank = np.repeat(np.arange(len(size)), size)
        base = np.cumsum(size) - size
        depth = np.arange(len(raw)) - base[rank]
        level = np.concatenate(([0], np.cumsum(np.bincount(depth))))
        node = level[depth] + rank  # of the end position after each character
        matches = list(self._matches(raw, (base + size)[rank]))
        many = np.zeros(len(raw) + 1, np.int64)
        for live, length, _, _ in matches:  # ends of one length differ
            many[node[live + length - 1] + 1] += 1
        first = np.cumsum(many)
        starts, codes, before = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int64)
        value, free = np.zeros(first[-1]), first[:-1].copy()
        for live, length, code, weight in matches:
            end = node[live + length - 1]
            way = free[end]
            free[end] += 1
            starts[way], codes[way], value[way] = depth[live], code, weight
            before[way] = np.where(depth[live] > 0, node[live - 1], len(raw))
        total = np.zeros(len(raw) + 1)
        for low, high in zip(level, level[1:], strict=False):
            here, at = slice(first[low], first[high]), first[low:high] - first[low]
            ways, n = value[here] + total[before[here]], first[low + 1:high + 1] - first[low:high]
            top = np.maximum.reduceat(ways, at)
            ways = np.exp(ways - np.repeat(top, n))
            k, more = 1, np.flatnonzero(n > 1)
            while len(more):  # sums within a node only, so that they do not depend on its neighbours
                ways[at[more] + k] += ways[at[more] + k - 1]
                k += 1
                more = more[n[more] > k]
            mass = ways[at + n - 1]
            total[low:high] = top + np.log(mass)
            value[here] = ways / np.repeat(mass, n)
        return level, first, value, starts, codes

    def _long(self, segment: str, seed: np.uint64, place: int) -> list[int]:
        """Codes of a long segment: the sums of all positions are kept, the ways only of a block of them at a time."""
        marked, n, longest = segment.replace(" ", SPACE), len(segment), self.longest
        total, coming = array("d", [0.0]), {}
        for start in range(n):
            for end, w, code in self._pieces(marked, start):
                coming.setdefault(end, []).append((total[start] + w, start, code))
            total.append(self._mass(coming.pop(start + 1)[::-1])[0])
        end, codes = n, []
        while end:
            low, high = max(0, end - WHOLE), end
            draws = _draws(np.full(high - low, seed), np.arange(place + low + 1, place + high + 1))
            ways: dict[int, list] = {}
            for start in range(max(0, low + 1 - longest), high):
                for stop, w, code in self._pieces(marked, start):
                    if low < stop <= high:
                        ways.setdefault(stop, []).append((total[start] + w, start, code))
            while end > low:
                here = ways[end][::-1]  # short pieces first, as in _filter
                _, shares = self._mass(here)
                k = min(int(np.searchsorted(shares, draws[end - low - 1], "right")), len(shares) - 1)
                _, end, code = here[k]
                codes.append(code)
        return codes[::-1]

    def sample(self, text: str, row_key: str) -> list[int]:
        """Ids of one segmentation, the same for the same text and key."""
        return self.sample_all([(text, row_key)])[0].tolist()

    def sample_all(self, rows: list[tuple[str, str]]) -> list[np.ndarray]:
        """Ids of one segmentation per (text, key). The draw at a place of a text is a hash of its key and that place."""
        out: list[list[np.ndarray]] = [[] for _ in rows]
        slab: list[tuple[int, np.uint64, int, str]] = []
        held = 0
        for row, (text, key) in enumerate(rows):
            seed = np.frombuffer(blake2b(key.encode(), digest_size=8).digest(), np.uint64)[0]
            at = 0
            while at < len(text):
                border = _BORDER.search(text, at + SLAB)
                end = border.start() if border else len(text)
                slab.append((row, seed, at, text[at:end]))
                held, at = held + end - at, end
                if held >= SLAB:
                    self._sample(slab, out)
                    slab, held = [], 0
        if slab:
            self._sample(slab, out)
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]

    def _sample(self, slab: list[tuple[int, np.uint64, int, str]], out: list[list[np.ndarray]]) -> None:
        """Backward sampling of all segments of some parts of texts, one piece of each a step."""
        whole = "".join([s[3] for s in slab])
        raw = np.frombuffer(whole.encode("utf-32-le"), np.int32)
        upto = np.cumsum([0, *(len(s[3]) for s in slab)])
        start = _starts(raw, upto[:-1])
        size = np.diff(np.append(start, len(raw)))
        bounds = np.searchsorted(start, upto)
        counts = np.diff(bounds)
        place = start + np.repeat([s[2] for s in slab] - upto[:-1], counts)
        seed = np.repeat(np.array([s[1] for s in slab], np.uint64), counts)
        long = {int(k): self._long(whole[start[k]:start[k] + size[k]], seed[k], int(place[k])) for k in np.flatnonzero(size > WHOLE)}
        first, rank = _distinct(raw, start, size)
        distinct = [whole[a:a + n] for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True)]
        many = np.zeros(len(start), np.int64)
        steps = []
        live = np.flatnonzero(size <= WHOLE)
        end = size[live]
        if distinct:
            level, first, share, starts, ids = self._filter(distinct, size[first])
        while len(live):
            node = level[end - 1] + rank[live]
            way, last = first[node], first[node + 1] - 1
            draw = _draws(seed[live], place[live] + end)
            open_ = np.flatnonzero(way < last)
            while len(open_):
                open_ = open_[share[way[open_]] <= draw[open_]]
                way[open_] += 1
                open_ = open_[way[open_] < last[open_]]
            many[live] += 1
            steps.append((live, ids[way]))
            end = starts[way].astype(np.int64)
            live, end = live[end > 0], end[end > 0]
        for k, codes in long.items():
            many[k] = len(codes)
        upto = np.concatenate(([0], np.cumsum(many)))
        codes = np.zeros(upto[-1], np.int32)
        for k, (live, step) in enumerate(steps):  # the first piece drawn is the last of its segment
            codes[upto[live + 1] - 1 - k] = step
        for k, step in long.items():
            codes[upto[k]:upto[k + 1]] = step
        spelt, ends = self._spelt(codes)
        bounds = ends[upto[bounds]]
        for (row, *_), low, high in zip(slab, bounds, bounds[1:], strict=False):
            out[row].append(spelt[low:high])

    def _spelt(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the UTF-8 bytes of characters that go as bytes, and where each code begins (and the last ends)."""
        char = np.maximum(codes - self.size, 0)
        spelt = codes >= self.size
        n = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        ends = np.concatenate(([0], np.cumsum(n)))
        if not spelt.any():
            return codes, ends
        of = np.repeat(np.arange(len(codes)), n)
        size, back = n[of], ends[of + 1] - 1 - np.arange(len(of))
        value = char[of] >> (6 * back)
        lead = back == size - 1
        value = np.where(size == 1, value, np.where(lead, ((0xF00 >> size) & 0xFF) | value, 0x80 | (value & 0x3F)))
        return np.where(spelt[of], self.byte[value & 0xFF], codes[of]).astype(np.int32), ends

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of any of its segmentations."""
        return self.decode_bytes(ids).decode("utf-8")


def _starts(raw: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Where the segments of some parts of texts begin: a mark, or a run of spaces with what follows it up to a space or mark."""
    space, mark = raw == 32, raw == ord(SPACE)
    new = mark.copy()
    new[1:] |= mark[:-1] | (space[1:] & ~space[:-1])
    new[parts[parts < len(raw)]] = True
    return np.flatnonzero(new)


def _distinct(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One segment of each text, the longest first, and the number of its text for every segment of up to ``WHOLE`` characters.

    Segments are put together by a sum of powers and their size, and each is then
    compared with the one that stands for it; those that differ from it go by their characters.
    """
    rank = np.zeros(len(start), np.int64)
    own = np.flatnonzero(size <= WHOLE)
    if not len(own):
        return own, rank
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + 1).astype(np.uint64) * up[:len(raw)], out=sums[1:])
    a, n = start[own], size[own]
    key = mix64((sums[a + n] - sums[a]) * down[a] + n.astype(np.uint64))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    other, ends = start[own[first]][back], np.cumsum(n)
    inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
    equal = raw[np.repeat(a, n) + inside] == raw[np.minimum(np.repeat(other, n) + inside, len(raw) - 1)]
    same = np.logical_and.reduceat(equal, ends - n) & (n == n[first][back])
    rank[own], first = back, own[first]
    more: dict[bytes, int] = {}
    for k in own[~same].tolist():
        text = raw[start[k]:start[k] + size[k]].tobytes()
        if text not in more:
            more[text], first = len(first), np.append(first, k)
        rank[k] = more[text]
    order = np.argsort(-size[first], kind="stable")
    number = np.empty(len(first), np.int64)
    number[order] = np.arange(len(first))
    return first[order], number[rank]


def _draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform numbers below 1, one per seed and place."""
    return (mix64(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0 ** -53


def encode(docs: DataFrame, model: str, smooth: float = SMOOTH, seed: int = 0) -> DataFrame:
    """doc_id, ids, lossless of every row of ``docs`` (doc_id, text), sampled by forward filtering and backward sampling.

    A segmentation has probability proportional to exp(smooth * sum of scores);
    draws come from the seed and the row's doc_id, so runs and partitionings
    agree. Null and empty texts have no ids; rows with a null id share one seed;
    repeated rows get equal ids; characters without a piece go as bytes; an empty
    table gives no rows; other columns are left out. Very long texts are sampled
    in slabs of whole segments, very long segments in blocks of positions.
    ``lossless`` tells that decoding the ids gives the text back.
    """
    ship(docs.sparkSession)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        """Rows of a batch, some at a time: those of about one slab."""
        for batch in batches:
            keys, rows, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                keys.append(doc_id)
                rows.append(text)
                held += len(text)
                if held >= SLAB:
                    yield keys, rows
                    keys, rows, held = [], [], 0
            if keys:
                yield keys, rows

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model, smooth)
        for keys, rows in rows_of(batches):
            found = lattice.sample_all([(t, f"{seed}:{k}") for k, t in zip(keys, rows, strict=True)])
            same = [lattice.decode_bytes(ids.tolist()) == t.encode() for ids, t in zip(found, rows, strict=True)]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(tidied(sample), "doc_id long, ids array<int>, lossless boolean")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give a null text."""
    ship(rows.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model, SMOOTH)
        for batch in batches:
            found = [None if ids is None else lattice.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(join, "doc_id long, text string")
