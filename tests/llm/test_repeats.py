"""Suffix arrays, common prefixes and removal of repeated passages against brute force, and on awkward rows."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm import repeats
from panelyard.llm.common import table
from panelyard.llm.queries import QUERIES
from panelyard.llm.suffixes import permuted_prefixes, suffix_array

SF = "/root/testdata/sf0.001"
texts = st.one_of(
    st.lists(st.integers(1, 3), max_size=120), st.lists(st.integers(1, 255), max_size=120),
    st.tuples(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 15)).map(lambda p: p[0] * p[1]))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_suffix_array_and_prefixes(x):
    order = suffix_array(np.array([*x, 0]))
    assert order.tolist() == sorted(range(len(x) + 1), key=lambda i: [*x, 0][i:])
    if x:
        shared = permuted_prefixes(np.array(x, np.uint8), order[1:])
        for a, b in zip(order[1:-1].tolist(), order[2:].tolist(), strict=True):
            n = next((k for k in range(len(x)) if a + k >= len(x) or b + k >= len(x) or x[a + k] != x[b + k]), len(x))
            assert shared[b] == n


def brute(rows, span=100):
    """(n_bytes, removed places) by row; places are (id, first byte)."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - span + 1) if i is not None else ():
            w = data[s:s + span]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = set()
        for s in range(len(data) - span + 1) if i is not None else ():
            if first[data[s:s + span]] < (i, s):
                gone.update(range(s, s + span))
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        kept = bytes(x for k, x in enumerate(data) if k not in gone)
        out.append((i, len(data), len(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(frame):
    rows = [(r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]),
             hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in frame.collect()]
    return sorted(rows, key=str)


def passages():
    """Texts that share passages of all lengths about the limit, in changing surroundings, with copies and runs."""
    rng = np.random.default_rng(7)
    letters = np.frombuffer(b"abcdefghij klmnopqrst uvwxyz", np.uint8)
    new = lambda n: bytes(rng.choice(letters, n)).decode()
    shared = [new(n) for n in (99, 100, 101, 140, 400)]
    rows = [(i, new(rng.integers(0, 90)) + shared[i % 5] + new(rng.integers(0, 90)) + ("-" * 150 if i % 7 == 0 else "")) for i in range(60)]
    copy, twin = new(700), new(300)
    rows += [(100 + i, copy) for i in range(12)] + [(120 + i, copy[:350] + f" {i} " + copy[350:]) for i in range(6)]
    rows += [(130, twin + new(50) + twin), (131, "ab" * 400), (132, "x" * 3000), (133, "é" * 80 + twin), (134, new(5000) + "x" * 130)]
    return rows


@pytest.mark.parametrize("small", [repeats.Settings(), repeats.Settings(crowd=8, most_crowded=10_000, shard_segments=3, shard_bytes=4000, chunk_bytes=1000)])
def test_removal_equals_brute_force(make_docs, small, monkeypatch):
    if small.crowd == 8:  # joins by a shuffle too
        monkeypatch.setattr(repeats, "broadcast_bytes", lambda spark: 0)
    rows = passages()
    docs = make_docs([(i, t, "en", "s") for i, t in rows]).repartition(4)
    assert removed(repeats.remove_repeats(docs, small)) == brute(rows)


def test_removal_of_awkward_rows(make_docs):
    long = "0123456789" * 5 + " and some words that make a hundred bytes and a few more, all in one row without a repeat"
    rows = [(3, long), (1, long), (2, None), (4, ""), (5, " \n"), (1, long), (1, "other text " + long), (None, long), (None, long),
            (6, "word " * 50_000), (7, "short")]
    assert removed(repeats.remove_repeats(make_docs([(*r, "en", None) for r in rows]))) == brute(rows)
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_query_op13_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op13_induced_suffixes"](spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert collections.Counter(r[2] > 0 for r in got)[True] > 5
    assert table(spark, SF, "documents").count() == len(got)
