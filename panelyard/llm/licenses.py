"""Licences: SPDX tags, TF-IDF cosine of passages to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import ship, texts
from panelyard.llm.license_texts import TEMPLATES
from panelyard.plans.skew import attach
from panelyard.plans.stage import stage

_TOKEN = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")
_ID = r"(?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.+:-]*(?:[ \t]*\))*"
_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)", re.IGNORECASE)
#: templates of so many words are told apart before sentences are looked at, which several licences may share
LONG = 30
#: paths of files that hold a licence by their name
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)([-._][^/]*)?$"
_SPARE = 1e-12
_PIECE = re.compile(_TOKEN.pattern + r"|\n")


def declared_tag(text: str, names: dict[str, str]) -> str | None:
    """Licence expression of the first SPDX tag; ids of templates by their names, with and without -only, -or-later and +."""
    for found in _TAG.finditer(text):
        parts = [p.rstrip(".:-") for p in re.sub(r"([()])", r" \1 ", found[1]).split()]
        while parts.count(")") > parts.count("(") and parts[-1] == ")":
            parts.pop()
        parts = [names.get(re.sub(r"(-only|-or-later|\+)$", "", p.lower()), p) for p in parts]
        if parts[0] not in ("NONE", "NOASSERTION") and (len(parts) > 1 or not parts[0].islower() or "-" in parts[0]):
            return re.sub(r"\( | (?=\))", lambda m: m[0].strip(), " ".join(parts))
    return None


def tokens(line: str) -> Counter:
    return Counter(_TOKEN.findall(line.lower()))


def _counts(docs: DataFrame, words: frozenset[str]) -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, and the documents: at most one row per template word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(words.intersection(_TOKEN.findall(text.lower())))
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


class _Numbers(dict):
    """Numbers of words, template words first; any other word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class _Words:
    """Word numbers of one text and the squared lengths of its passages' vectors."""

    def __init__(self, text: str, numbers: _Numbers, line: int, rare: int, idf: np.ndarray):
        every = np.fromiter(map(numbers.__getitem__, _PIECE.findall(text.lower())), np.int64)
        word = every != line
        ids = every[word]
        ends = np.cumsum(word)[~word]
        blocks = ends[1:][ends[1:] == ends[:-1]]  # a line without words ends a block
        ends, blocks = (np.unique(np.concatenate(([0], c, [len(ids)]))) for c in (ends, blocks))
        self.ids = ids
        self.known = np.minimum(ids, rare)
        self.idf = idf
        self.squares = idf[self.known] ** 2
        self.upto = np.concatenate(([0.0], np.cumsum(self.squares)))
        self._ends, self._blocks, self._roots, self._windows = ends, blocks, {}, {}

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cuts and squared lengths of the lines, the blocks of lines and the whole, at most 4096 at a time."""
        for cuts in (self._ends, self._blocks, np.array([0, len(self.ids)])):
            for at in range(0, len(cuts) - 1, 4096):
                some = cuts[at:at + 4097]
                yield some, self._lengths(some)

    def _lengths(self, cuts: np.ndarray) -> np.ndarray:
        part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        keys = np.sort(part * (1 << 32) + self.ids[cuts[0]:cuts[-1]])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(first, append=len(keys)).astype(float)
        weight = self.idf[np.minimum(keys[first] & 0xFFFFFFFF, len(self.idf) - 1)]
        return np.bincount(keys[first] >> 32, (weight * n) ** 2, len(cuts) - 1)

    @cached_property
    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.ids, kind="stable")
        return order, self.ids[order] * (2 * len(self.ids)) + order

    def roots(self, size: int) -> np.ndarray:
        """Lengths of all windows if no word came twice: counts squared are at least the counts."""
        if size not in self._roots:
            self._roots[size] = np.sqrt(self.upto[size:] - self.upto[:-size])
        return self._roots[size]

    def windows(self, size: int) -> np.ndarray:
        """Squared length of every window of ``size`` words: a word that enters or leaves counts 2n + 1, n its others in the window."""
        if size not in self._windows:
            order, keys = self._places
            rank = np.arange(len(order))
            before, after = np.empty(len(order)), np.empty(len(order))
            before[order] = rank - np.searchsorted(keys, keys - np.minimum(size - 1, order))
            after[order] = np.searchsorted(keys, keys + np.minimum(size - 1, len(order) - 1 - order), "right") - 1 - rank
            steps = self.squares[size:] * (2 * before[size:] + 1) - self.squares[:-size] * (2 * after[:-size] + 1)
            _, first, n = np.unique(self.ids[:size], return_index=True, return_counts=True)
            start = float((self.squares[first] * n.astype(float) ** 2).sum())
            self._windows[size] = start + np.concatenate(([0.0], np.cumsum(steps)))
        return self._windows[size]


class Matcher:
    """Sparse TF-IDF vectors of the templates, and the best cosine of a passage.

    Passages are the lines, the blocks of lines up to one without words, the whole
    text, and, wherever its lines break, every run of as many words as the
    template has: words before and after a declaration do not lower its cosine.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]], found: dict[str, int], docs: int):
        self.names = {name.lower(): name for name in templates}
        self.idf = {w: log((docs + 1) / (found.get(w, 0) + 1)) + 1 for lines in templates.values() for t in lines for w in tokens(t)}
        self.rare = log(docs + 1) + 1
        self.rank = {w: k for k, w in enumerate(self.idf)}
        self.numbers = self._fresh()
        self.weights = np.array([*self.idf.values(), self.rare])
        self.licences, self.sizes, rows = [], [], []
        for name, lines in sorted(templates.items()):
            for counts in map(tokens, lines):
                row = np.zeros(len(self.weights))
                for w, v in self._unit(counts).items():
                    row[self.rank[w]] = v
                self.licences.append(name)
                self.sizes.append(sum(counts.values()))
                rows.append(row)
        self.vectors = np.array(rows).reshape(-1, len(self.weights))
        self.scaled = self.vectors * self.weights
        self.sizes = np.array(self.sizes, np.int64)
        self.distinct = np.unique(self.sizes, return_inverse=True)

    def _fresh(self) -> _Numbers:
        numbers = _Numbers(self.rank)
        numbers["\n"] = len(numbers)
        return numbers

    def _unit(self, counts: Counter) -> dict[str, float]:
        weights = {w: n * self.idf.get(w, self.rare) for w, n in counts.items()}
        norm = sqrt(sum(v * v for v in weights.values()))
        return {w: v / norm for w, v in weights.items()}

    def _parts(self, words: _Words, held: np.ndarray) -> np.ndarray:
        """Best cosine of a line, block or the whole to each template."""
        best = np.zeros(len(self.sizes))
        scaled = self.scaled[:, held].T
        column = np.full(len(self.weights), -1)
        column[held] = np.arange(len(held))
        for cuts, lengths in words.parts():
            columns = column[words.known[cuts[0]:cuts[-1]]]
            at = np.flatnonzero(columns >= 0)
            part = np.searchsorted(cuts, at + cuts[0], "right") - 1
            rows, part = np.unique(part, return_inverse=True)
            counts = np.bincount(part * len(held) + columns[at], minlength=len(rows) * len(held)).reshape(-1, len(held))
            dots = counts @ scaled
            best = np.maximum(best, (dots / np.sqrt(lengths[rows])[:, None]).max(axis=0, initial=0.0))
        return best

    def _bounds(self, words: _Words, held: np.ndarray) -> np.ndarray:
        """No window has a higher cosine: it holds no template word that the text does not, and none more often."""
        shared = np.sqrt((self.vectors[:, held] ** 2).sum(axis=1))
        n = len(words.ids)
        dots = self.scaled[:, held] @ np.bincount(words.known, minlength=len(self.weights))[held]
        size, back = self.distinct
        least = np.array([(words.upto[k:] - words.upto[:-k]).min() if k < n else np.inf for k in size.tolist()])
        return np.minimum(shared, dots / np.sqrt(least)[back])

    def _cosine(self, words: _Words, k: int, top: float) -> float:
        """Best cosine of a run of words to template ``k``; 0 if all are below ``top``."""
        size = int(self.sizes[k])
        if size >= len(words.ids):
            return 0.0
        dots = np.concatenate(([0.0], np.cumsum(self.scaled[k, words.known])))
        dot = dots[size:] - dots[:-size]
        if (dot / words.roots(size)).max() < top - _SPARE:
            return 0.0
        return float((dot / np.sqrt(words.windows(size))).max())

    def best(self, text: str, least: float) -> tuple[str | None, float]:
        """Licence and cosine of the text's best passage, ties to the first name; none under ``least``."""
        return self.declared(text, least)[:2]

    def declared(self, text: str, least: float) -> tuple[str | None, float, bool]:
        """Licence and cosine of the best passage, and whether its template is as long as half of the text.

        An SPDX tag is a declaration of cosine 1, and a header. Long templates
        that reach ``least`` go before sentences.
        """
        tag = declared_tag(text, self.names)
        if tag is not None:
            return tag, 1.0, False
        if len(self.numbers) > 1 << 18:
            self.numbers = self._fresh()
        rare = len(self.rank)
        words = _Words(text, self.numbers, rare, rare, self.weights)
        held = np.unique(words.known)
        held = held[held < rare]
        if len(held) < 2:
            return None, 0.0, False
        bounds = self._bounds(words, held)
        scores = self._parts(words, held)
        long = self.sizes >= LONG
        high = float(scores.max(initial=0.0))
        for group in (np.flatnonzero(~long), np.flatnonzero(long)):
            # of scores under ``least`` only the best of all counts
            top = max(min(high, least), scores[group].max(initial=0.0))
            for k in group[np.argsort(-bounds[group], kind="stable")]:
                if bounds[k] < top - _SPARE:
                    break
                scores[k] = max(scores[k], self._cosine(words, k, top))
                top = max(top, scores[k])
            high = max(high, top)
        name, top, most = None, 0.0, False
        for k in np.flatnonzero(long) if scores[long].max(initial=0.0) >= least else range(len(scores)):  # by name
            if scores[k] > top + _SPARE:
                name, top, most = self.licences[k], float(scores[k]), bool(2 * self.sizes[k] >= len(words.ids))
        return (name, min(top, 1.0), most) if top >= least else (None, min(top, 1.0), False)


def scan(files: DataFrame, path: Column, least: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, path, own, cosine, licence, inherited_from, licence_file of every row of ``files`` (doc_id, text).

    Every line, every block of lines, the whole text and every run of words as long
    as a template are compared with the templates, after SPDX tags; document
    frequencies are those of all files. A licence file is a file with a licence
    whose template makes up at least half of its words, or that is named like one
    (``FILE_NAMES``); a header or tag within another text holds for its own file
    only. A file without a licence of its own takes that of its directory, or of
    the nearest directory above that has one; a directory has the licence of its
    licence file with the smallest id. Paths use "/"; a null path is the root.
    Null and empty texts declare nothing; rows with a null id declare for
    themselves only; repeated rows agree; very long texts are matched whole; an
    empty table gives no rows; other columns are left out.
    """
    ship(files.sparkSession)
    templates = TEMPLATES if templates is None else templates
    words = frozenset(w for lines in templates.values() for t in lines for w in tokens(t))
    found, docs = _counts(files, words)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, found, docs)
        for batch in batches:
            best = [matcher.declared(t, least) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b[0] for b in best], pa.string()),
                                              pa.array([b[1] for b in best], pa.float64()), pa.array([b[2] for b in best], pa.bool_())],
                                             ["doc_id", "path", "own", "cosine", "most"])

    rows = files.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), "text").mapInArrow(
        match, "doc_id long, path string, own string, cosine double, most boolean")
    rows = rows.withColumn("licence_file", F.col("own").isNotNull() & (F.col("most") | F.col("path").rlike(FILE_NAMES))).drop("most")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = stage(rows.withColumn("folder", folder), "licences")
    declared = rows.where("licence_file AND doc_id IS NOT NULL").groupBy("folder").agg(F.min(F.struct("doc_id", "own")).alias("d"))
    declared = declared.select(F.col("folder").alias("above"), F.col("d.own").alias("licence"))
    # one row per folder and ancestor: at most its depth
    parts = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    folders = rows.select("folder").distinct().withColumn("above", F.explode(F.array_distinct(chain)))
    near = folders.join(declared, "above").groupBy("folder").agg(
        F.max(F.struct(F.length("above").alias("depth"), F.col("above"), F.col("licence"))).alias("n"))
    near = near.select("folder", F.col("n.above").alias("above"), F.col("n.licence").alias("near"))
    rows = attach(rows, near, ["folder"])
    return rows.select("doc_id", "path", "own", "cosine", F.coalesce("own", "near").alias("licence"),
                       F.when(F.col("own").isNull(), F.col("above")).alias("inherited_from"), "licence_file")
