"""Ids of whole texts by a tokenizer file: texts are cut into words, equal words of a task encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MARKS = ".,;:!?"
#: bytes of words joined in a call of the tokenizer, and characters of words in a call that encodes each by itself
JOINED, ALONE = 1 << 11, 1 << 16
#: bytes of a word, of all words in memory, and words of texts whose ids are laid out at once
LONGEST, MOST_BYTES, BLOCK = 64, 16 << 20, 1 << 16
_SPACE = r"\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: chunks that begin (after a line end before it) or end with white space, or are empty
_ODD = rf"^\n?(?:[{_SPACE}]|$)|[\n{_SPACE}]$"
#: a mark after a letter, of those that are letters in every version of Unicode
_MARKED = (r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}\x{391}-\x{3a1}\x{3a3}-\x{3f5}"
           rf"\x{{400}}-\x{{481}}\x{{48a}}-\x{{523}}\x{{5d0}}-\x{{5ea}}][{MARKS}]$")
_TEXT = pa.large_string()


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _put(first: str, strings: pa.Array) -> pa.Array:
    """``first`` before each string."""
    return pc.binary_join_element_wise(pa.scalar(first, _TEXT), strings, pa.scalar("", _TEXT))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the elements of all spans, span after span."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _groups(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Begin and end of groups of neighbours, each of about ``size`` of what ``bounds`` counts, or of one."""
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], size)), len(bounds) - 1)).tolist()
    return zip(cuts, cuts[1:], strict=False)


def _laid(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays one after the other, with the start and size of each."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum(sizes) - sizes, sizes


class WordEncoder:
    """Ids (unsigned, 32 bits) of texts, as if each were encoded whole.

    A byte-level tokenizer that cuts text into words never lets a token cross the
    place before a single space, or line end, between two other characters, nor the
    place between a letter and one mark after it. So texts are cut at such places,
    and the distinct words between them encoded, many to a call: each follows a line
    end there, whose id tells the words apart. Words are remembered until they take
    more than ``MOST_BYTES``; longer ones than ``LONGEST``, which hardly come again, are not.
    """

    _made: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line, *marks = self._each(["\n", *MARKS])
        self.marks = dict(zip(MARKS, marks, strict=True)) if all(len(m) == 1 for m in marks) else {}
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], _TEXT)
        self.ids, self.starts, self.sizes = _laid([])

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; there are no nulls. Memory is in proportion to the bytes of all texts."""
        lined = _put("\n", pc.replace_substring(texts.cast(_TEXT), "\n", " \n"))  # chunks begin with their line end
        split = pc.split_pattern(lined, " ")
        bounds, chunks = split.offsets.to_numpy(), split.flatten()
        coded = chunks.dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary
        odd = _flags(pc.match_substring_regex(distinct, _ODD))
        ids, starts, sizes = self._words(distinct, odd)
        if odd.any():
            at, bounds, merged = self._merge(chunks, at, bounds, odd)
            more, begin, size = _laid(merged)
            starts, sizes = np.append(starts, begin + len(ids)), np.append(sizes, size)
            ids = np.append(ids, more)
        del lined, split, chunks, coded, distinct
        for block in _groups(bounds, BLOCK):
            code = at[bounds[block[0]]:bounds[block[1]]]
            out = ids[_places(starts[code], sizes[code])]
            ends = np.append(0, np.cumsum(sizes[code]))[bounds[block[0]:block[1] + 1] - bounds[block[0]]].tolist()
            for begin, end in zip(ends, ends[1:], strict=False):
                yield out[begin + len(self.line):end]  # without the line end that was put before the text

    def _merge(self, chunks: pa.Array, at: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Codes and bounds after joining odd chunks with both neighbours, and the ids of what is joined."""
        apart = odd[at]
        begins = np.ones(len(at), bool)
        begins[1:] = ~(apart[1:] | apart[:-1])
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(at))
        codes, heads = at[starts].astype(np.int64), set(bounds[:-1].tolist())
        known: dict[tuple[bool, str], int] = {}
        for k in np.flatnonzero(np.logical_or.reduceat(apart, starts)).tolist():
            a = int(starts[k])
            text = " ".join(chunks.slice(a, int(ends[k]) - a).to_pylist()).replace(" \n", "\n")
            if a in heads:
                text = text[1:]
            elif text[0] != "\n":
                text = " " + text
            codes[k] = len(odd) + known.setdefault((a in heads, text), len(known))
        found = self._each([text for _, text in known])
        merged = [np.append(self.line, f) if head else f for (head, _), f in zip(known, found, strict=True)]
        return codes, np.append(0, np.cumsum(begins))[bounds], merged

    def _words(self, chunks: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, with the start and size of each; odd ones are left out (size 0)."""
        regular = chunks.filter(pa.array(~odd))
        special = np.zeros(len(regular), bool)
        for content in self.special:
            special |= _flags(pc.match_substring(regular, content))
        marked = _flags(pc.match_substring_regex(regular, _MARKED)) & ~special & bool(self.marks)
        words = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(regular, 0, -1), regular)
        coded = pc.if_else(pc.starts_with(words, "\n"), words, _put(" ", words)).dictionary_encode()
        word, alone = coded.indices.to_numpy(), pc.binary_length(coded.dictionary).to_numpy() > LONGEST
        alone[word[special]] = True
        starts, sizes = np.zeros(len(alone), np.int64), np.zeros(len(alone), np.int64)
        ids, starts[~alone], sizes[~alone] = self._remembered(coded.dictionary.filter(pa.array(~alone)))
        more, begin, sizes[alone] = _laid(self._each(coded.dictionary.filter(pa.array(alone)).to_pylist()))
        starts[alone] = begin + len(ids)
        size = sizes[word] + marked
        out = np.concatenate([ids, more, np.zeros(1, "<u4")])[_places(starts[word], size)]  # marked ones with a place to fill
        last = pc.utf8_slice_codeunits(regular.filter(pa.array(marked)), -1).dictionary_encode()
        codes = np.array([self.marks[m][0] for m in last.dictionary.to_pylist()], "<u4")
        out[np.cumsum(size)[marked] - 1] = codes[last.indices.to_numpy()]
        all_starts, all_sizes = np.zeros(len(odd), np.int64), np.zeros(len(odd), np.int64)
        all_starts[~odd], all_sizes[~odd] = np.cumsum(size) - size, size
        return out, all_starts, all_sizes

    def _remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all remembered words, those given among them, and the start and size of each one given."""
        if self.known.nbytes + self.ids.nbytes + self.starts.nbytes + self.sizes.nbytes > MOST_BYTES:
            self.clear()
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        more, begin, size = self._joined(new)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[_flags(at.is_null())] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.starts, self.sizes = np.append(self.starts, begin + len(self.ids)), np.append(self.sizes, size)
        self.ids = np.append(self.ids, more)
        return self.ids, self.starts[place], self.sizes[place]

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words that begin with a space or a line end and hold no other line end, with the start and size of each."""
        if not len(words) or len(self.line) != 1:
            return _laid(self._each(words.to_pylist()))
        spaced = pc.starts_with(words, " ")
        lined = pc.if_else(spaced, _put("\n", words), words)
        skip = _flags(spaced).astype(np.int64)  # the line end before a space is not the word's own
        at, data = np.frombuffer(lined.buffers()[1], np.int64)[:len(words) + 1], memoryview(lined.buffers()[2])
        ids, starts, sizes, made = [], [], [], 0
        for a, b in _groups(at, JOINED):
            coded = self.tokenizer.encode_batch_fast([str(data[at[a]:at[b]], "utf-8")], add_special_tokens=False)
            found = np.array(coded[0].ids, "<u4")
            begin = np.flatnonzero(found == self.line)
            if len(begin) == b - a and begin[0] == 0:
                size = np.diff(begin, append=len(found)) - skip[a:b]
                begin += skip[a:b]
            else:
                found, begin, size = _laid(self._each(words.slice(a, b - a).to_pylist()))
            ids.append(found)
            starts.append(begin + made)
            sizes.append(size)
            made += len(found)
        return np.concatenate(ids), np.concatenate(starts), np.concatenate(sizes)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, encoded by itself."""
        out, held, size = [], [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text) + 16
            if size >= ALONE or k == len(texts) - 1:
                out += [np.array(c.ids, "<u4") for c in self.tokenizer.encode_batch_fast(held, add_special_tokens=False)]
                held, size = [], 0
        return out
