"""Ranked lexical search and periodic runs against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm import lexical, runs
from panelyard.llm.common import table
from panelyard.llm.queries import ORACLE, QUERIES
from panelyard.plans.stage import stage

SF = "/root/testdata/sf0.001"
ROWS = [(1, "The same words come here", "en", "s"), (2, "The same words come here", "en", "s"),
        (2, "The same words come here", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " \n\t ", "de", None),
        (None, "no id but some words", "en", "t"), (None, None, None, None), (6, "one", "en", "s"),
        (7, "word " * 60_000 + "end", "en", "s"), (8, "naïve ▁ 😀 \x85 text", "fr", "s"), (9, "a b " * 9, "en", "s")]


# --- ranked lexical search -------------------------------------------------------


def brute_search(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def answers(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("set_up", [lexical.Settings(), lexical.Settings(owners=3, growth=3, block_docs=50, item_terms=600)])
def test_search_equals_brute_force(spark, set_up):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()
    got = answers(lexical.search(table(spark, SF, "documents"), table(spark, SF, "benchmark"), 50, set_up))
    assert got == brute_search(docs, items, 50)


def test_search_of_awkward_rows(spark, make_docs):
    items = spark.createDataFrame([(1, "Same WORDS, words come!", 3), (2, None, 3), (3, "", 3), (4, "absent", 3), (None, "naïve 😀", 3),
                                   (5, "word end one", 3)], "item_id long, text string, doc_id int")
    got = answers(lexical.search(make_docs(ROWS), items, 3, lexical.Settings(block_docs=2)))
    rows = [(r[0], r[1]) for r in ROWS]
    assert got == brute_search(rows, [(1, "Same WORDS, words come!"), (5, "word end one"), (None, "naïve 😀")], 3)
    assert [r[2] for r in got if r[0] == 1] == [1, 2, 2]
    assert lexical.search(make_docs([]), items).count() == 0
    assert lexical.search(make_docs(ROWS), items.limit(0)).count() == 0


def test_accumulators_that_cannot_win_are_left_behind(spark, make_docs):
    """Of 400 documents with a frequent term only those near the best carry an accumulator to the end."""
    rows = [(i, "common " + (f"rare{i % 5} " * 3 if i < 40 else f"other{i}"), "en", "s") for i in range(400)]
    items = [lexical.Item(1, frozenset([b"common", b"rare1"]))]
    vocabulary = {b"common": 0, b"rare1": 1}
    found = lexical._occurrences(make_docs(rows), vocabulary)
    plan, postings = lexical._plan(found, items, vocabulary, lexical.Settings())
    assert plan.owner[1] < plan.owner[0]
    bundles, least, sizes = spark.createDataFrame([], lexical.BUNDLES), np.ones(1, np.int64), []
    for level in range(4):
        own = lexical._of_owner(postings, plan, level)
        bundles = stage(bundles.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lexical._add(plan, level, least, 5), lexical.BUNDLES))
        least = lexical._kth_best(bundles, 1, 5)
        sizes.append(sum(len(r["rows"]) // 8 for r in bundles.collect()))
    assert sizes[-1] == 8


def test_query_op11_agrees_with_sql(spark):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert answers(QUERIES["op11_pipelined_terms"](spark, SF)) == sorted(duckdb.sql(ORACLE["op11_pipelined_terms"]).fetchall())


# --- periodic runs ---------------------------------------------------------------


def brute_runs(x):
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


pieces = st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.integers(1, 7)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(pieces, st.integers(1, 3))
def test_runs_equal_brute_force(parts, times):
    x = [s for unit, n in parts for s in unit * n] * times
    assert runs.find_runs(np.array(x, np.int64)) == brute_runs(x)


def test_transform_is_exact_with_large_symbols():
    """Sums far beyond one prime still tell equal blocks from others."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 1 << 20, 4096)
    x[1000:3000] = np.resize(x[1000:1200], 2000)
    at, d = runs.occurrences(x, np.arange(0, 4096, 128), 128, 85, 212)
    want = [(s, k) for s in range(0, 4096, 128) for k in range(85, 213) if s + k + 128 <= 4096 and (x[s:s + 128] == x[s + k:s + k + 128]).all()]
    assert sorted(zip(at.tolist(), d.tolist(), strict=True)) == want and want


def test_long_texts_of_one_word_and_of_many(spark):
    assert runs.find_runs(np.ones(300_000, np.uint16)) == [(0, 300_000, 1)]
    x = np.random.default_rng(1).integers(1, 10**6, 200_000)
    x[50_000:] = np.resize(x[50_000:80_000], 150_000)
    assert runs.find_runs(x) == [(50_000, 150_000, 30_000)]


def test_runs_of_awkward_rows(make_docs):
    got = collections.defaultdict(list)
    for r in runs.periodic_runs(make_docs(ROWS)).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    assert [tuple(r) for r in got[7][0]["runs"]] == [(0, 60_000, 1)] and got[7][0]["collapsed"] == "word end"
    assert [tuple(r) for r in got[9][0]["runs"]] == [(0, 18, 2)] and got[9][0]["collapsed"] == "a b"
    assert got[8][0]["collapsed"] == "naïve ▁ 😀 \x85 text" and got[3][0]["collapsed"] == "" == got[5][0]["collapsed"]
    assert got[2][0] == got[2][1] and got[6][0]["runs"] == []
    assert runs.periodic_runs(make_docs([])).count() == 0


def test_query_op12_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op12_block_convolution"](spark, SF).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(rows) == len(texts)
    for i, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 1500:
            continue
        found = brute_runs(w)
        drop = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        want = (len(found), *best, 1000 * best[1] // best[2] if found else None,
                hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
                hashlib.sha256(" ".join(w[k] for k in range(n) if k not in drop).encode()).hexdigest())
        r = rows[i]
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == want
