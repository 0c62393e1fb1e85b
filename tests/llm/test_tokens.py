"""Ids of whole texts, and what finding them costs."""

from __future__ import annotations

import random
import shutil
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelyard.llm import packing, tokens
from panelyard.llm.common import small_batches

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["foo", "it's", "X", "é", "ñandú,", "日本", "字。", "a1", "--", "...", "bar.", "THE!!", "<|endoftext|>", "́", "😀", "á,", "२,", "w" * 90]
SPACES = [" "] * 5 + ["\n", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\xa0", "\x85", "\x1c", " ", "　", "", "\n  ", "<|endoftext|> "]


def coded(texts: list[str | None], ids: bool = True, path: str = BPE) -> dict[int, bytes]:
    """Ids of each text from the pieces that packing makes of it."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 7, len(texts)))), pa.array(texts[k:k + 7], pa.string())], ["doc_id", "text"])
               for k in range(0, len(texts), 7)]
    out: dict[int, bytes] = dict.fromkeys(range(len(texts)), b"")
    for batch in packing._encoder(path, 2, 64, ids)(iter(batches)):
        for row in batch.to_pylist():
            span = row["ids"]
            assert row["start"] == len(out[row["doc_id"]]) // 4 and row["length"] == len(span) // 4 and row["crc"] == zlib.crc32(span)
            out[row["doc_id"]] += span
    return out


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " ", "\n", "\n\n", " \n ", "foo", " foo", "\nfoo,", "foo \n", "a.\nb", "x" * 5000]
    for _ in range(n):
        usual = SPACES[:7] if rng.random() < 0.5 else SPACES
        parts = [rng.choice(WORDS) + rng.choice(usual) for _ in range(rng.choice([1, 2, 5, 30]))]
        texts.append(rng.choice(SPACES) * (rng.random() < 0.3) + "".join(parts))
    return texts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize(("window", "most"), [(1 << 21, 16 << 20), (500, 2000)])
def test_ids_are_those_of_whole_texts(monkeypatch, name, window, most):
    monkeypatch.setattr(packing, "WINDOW_BYTES", window)
    monkeypatch.setattr(tokens, "MOST_BYTES", most, raising=False)
    path, texts = public_tokenizers.path(name), odd_texts(300)
    plain = Tokenizer.from_file(path)
    got = coded(texts, path=path)
    for k, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(got[k], "<u4").tolist() == want, t


def test_new_words_cost_no_call_of_python_each():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(20_000)]
    text = " ".join(w + "," * (k % 3 == 0) + "\nThen" * (k % 20 == 0) for k, w in enumerate(words))
    coded(["start"])  # the tokenizer is read
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    sys.setprofile(count)
    try:
        made = list(packing._encoder(BPE, 2, 1024)(iter([batch])))
    finally:
        sys.setprofile(None)
    assert sum(sum(b.column(3).to_pylist()) for b in made) > len(words)
    assert calls < len(words)


def test_white_space_leaves_words_encoded_once(monkeypatch, tmp_path):
    path = shutil.copy(BPE, tmp_path / "copy.json")  # read anew, by the class below
    given = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        @classmethod
        def from_file(cls, name):
            return cls(Tokenizer.from_file(name))

        def get_added_tokens_decoder(self):
            return self.inner.get_added_tokens_decoder()

        def encode(self, text, **how):
            given.append(len(text))
            return self.inner.encode(text, **how)

        def encode_batch_fast(self, held, **how):
            given.append(sum(map(len, held)))
            return self.inner.encode_batch_fast(held, **how)

    monkeypatch.setattr(tokens, "Tokenizer", Counted)
    texts = ["  one two, three\n\n" + "four five six seven eight " * 40 + f"\n\tend{k}" for k in range(50)]
    got = coded(texts, path=str(path))
    plain = Tokenizer.from_file(BPE)
    assert [np.frombuffer(got[k], "<u4").tolist() for k in got] == [[*plain.encode(t).ids, 2] for t in texts]
    assert sum(given) < sum(map(len, texts)) / 10


def test_texts_come_in_small_batches_while_they_are_packed(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(50).repartition(1).mapInArrow(sizes, "n long")
    with small_batches(spark, 20):
        assert sorted(r.n for r in rows.collect()) == [10, 20, 20]
    assert spark.conf.get(name) == usual
    seen, old = [], packing.stage
    monkeypatch.setattr(packing, "stage", lambda *a: seen.append(int(spark.conf.get(name))) or old(*a))
    packing.pack_documents(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").repartition(2), BPE)
    assert seen[0] <= 1000 and seen[1:] == [int(usual)] * len(seen[1:])
    assert spark.conf.get(name) == usual
