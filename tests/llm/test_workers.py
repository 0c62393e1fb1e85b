"""What a Python worker holds while it works, and after."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa

from panelyard.llm import lm, packing, pieces, repeats
from panelyard.llm.common import tidied


class Caught:
    """Stands in for a frame and keeps the work given to ``mapInArrow``."""

    work: Callable

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):  # noqa: N802
        self.work = work
        return self


def test_scoring_keeps_no_counts_of_the_longest_order():
    texts = ["the cat sat on the mat", "the dog sat on the log"]
    keys, n = np.unique(lm._positions([lm.normal(t.encode()) for t in texts])[0], return_counts=True)
    sums = np.bincount(keys & 0xFF, n, 256).astype(np.int64)
    low = [(np.flatnonzero(sums), sums[np.flatnonzero(sums)])]
    shared = type("Shared", (), {"value": {0: (keys, lm._narrow(n), 0, 256)}})()
    asked = ["the cat sat on the log", "a zebra", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(asked), pa.array([True] * 3)], ["doc_id", "text", "held_out"])
    out = next(lm._scored(Caught(), shared, low, 10, 5, False).work(iter([batch])))
    trie = lm.build(keys, n, low)
    for text, score in zip(asked, out.column(6).to_pylist(), strict=True):
        want = lm.log_probability(trie, lm._positions([lm.normal((text or "").encode())])[0]).sum()
        assert abs(score - want) < 1e-9
    (_, held, _), = lm.BUILT.values()
    assert held.seen[lm.ORDER][0].size == 0
    assert shared.value[0][1].itemsize == 4


def test_counts_of_more_than_32_bits_stay_whole():
    big = np.array([1, 1 << 33])
    assert lm._narrow(big).tolist() == big.tolist()


def test_scoring_windows_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 40_000] * 8)], ["text"])  # 1.6 MB
    sizes = [sum(map(len, held)) for _, held in lm._windows(batch, 0)]
    assert sum(sizes) == 8 * 200_000
    assert max(sizes) < (1 << 19) + 200_000


def test_documents_are_packed_by_one_worker_a_task(spark, make_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = make_docs([(1, "one two three", "en", "s"), (2, None, "en", "s"), (None, "x " * 3000, "en", "s")])
    calls, old = [], type(docs).mapInArrow
    type(docs).mapInArrow = lambda self, *a: calls.append(self) or old(self, *a)
    try:
        got = packing.pack_documents(docs, path, length=64).toPandas()
    finally:
        type(docs).mapInArrow = old
    assert calls[0].columns == ["doc_id", "text"]
    assert all("pieces" in c.columns for c in calls[1:])  # later calls read bins that are written
    plain = packing.pack_lengths(packing.token_pieces(docs, path, 2, 64), 64).toPandas()
    assert got.sequence_id.nunique() == plain.sequence_id.nunique()
    assert sorted(zip(got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(
        zip(plain.piece, plain.start, plain.length, plain.crc, strict=True))


def test_segment_bytes_and_kept_texts_are_given_out_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GIVEN_ROWS", 3)
    monkeypatch.setattr(repeats, "GIVEN_BYTES", 200)
    given = []
    monkeypatch.setattr(repeats, "tidied", lambda work: given.append(work) or tidied(work))
    text = "".join(chr(97 + (i * i + 7 * i) % 26) for i in range(300))
    docs = spark.createDataFrame([(k, text + str(k)) for k in range(6)], "doc_id long, text string")
    repeats.remove_repeats(docs)
    empty = pa.array([None] * 6, pa.list_(pa.struct([("tag", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([text] * 6), empty], ["doc_id", "text", "stretches"])
    out = list(given[-1](iter([batch])))
    assert [b.num_rows for b in out] == [1] * 6
    assert [b.column(0).to_pylist()[0] for b in out] == list(range(6))


def test_segments_with_equal_sums_stay_apart():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # 1024 characters: their sums of powers agree modulo 2**64 whatever the odd base
    raw = np.frombuffer("▁".join([a, b, a, b, "c c"]).encode("utf-32-le"), np.int32)
    start = pieces._starts(raw, np.array([0]))
    size = np.diff(np.append(start, len(raw)))
    first, rank = pieces._distinct(raw, start, size)
    texts = [raw[s:s + n].tobytes() for s, n in zip(start, size, strict=True)]
    assert [texts[k] for k in first[rank]] == texts
    assert len(first) == len(set(texts))
    assert (np.diff(size[first]) <= 0).all()


def test_steps_of_the_trie_are_found_by_hash():
    lattice = pieces.Lattice.of(public_tokenizers.path("piece_bpe_32k.model"), pieces.SMOOTH)
    steps, nodes = np.arange(0, 9000, 3), np.arange(1, 3001)
    kept = lattice._steps, lattice._next, lattice._shift
    try:
        lattice._hash(steps, nodes)
        assert lattice._follow(np.arange(9000)).tolist() == [k // 3 + 1 if k % 3 == 0 else 0 for k in range(9000)]
    finally:
        lattice._steps, lattice._next, lattice._shift = kept
