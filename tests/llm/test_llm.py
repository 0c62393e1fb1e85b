"""The training-data operators against brute force, round trips and held-out labels, and on awkward rows."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelyard.llm import licenses, lm, neardup, packing, pieces, quality, rules, sharding, topk, toxicity
from panelyard.llm.common import table
from panelyard.llm.components import components

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(1, "The same words come here and again here", "en", "s"), (2, "The same words come here and again here", "en", "s"),
        (2, "The same words come here and again here", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " \n\t ", "de", None),
        (None, "no id but some words in a row here", "en", "t"), (None, None, None, None), (6, "one", "en", "s"),
        (7, "word " * 30_000 + "end", "en", "s"), (8, "naïve ▁ 😀 \x85 text", "fr", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


# --- near duplicates -----------------------------------------------------------


def test_near_duplicates_equal_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_a_chain_and_blocks(spark, make_docs):
    """A chain of texts, each linked to the next only, through buckets cut into tiny blocks."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [(i, " ".join(base[10 * i:10 * i + 120])) for i in range(20)] + [(100 + i, f"tail {i} " + " ".join(base[:60])) for i in range(8)]
    frame = make_docs([(i, t, "en", "s") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, neardup.Settings(block=4)).collect()}
    assert got == brute_components(rows)


def test_texts_made_to_agree_in_sums_of_powers_stay_apart(make_docs):
    """A word of 1024 letters and its complement agree in any sum of powers modulo 2**64; so do the same patterns of words."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    pairs = [("".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)),
             (" ".join(("left", "right")[s] for s in signs), " ".join(("right", "left")[s] for s in signs))]
    rows = [(k, t) for k, t in enumerate(t for p in pairs for t in p)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(make_docs([(*r, "en", "s") for r in rows])).collect()}
    assert got == brute_components(rows) and got[1][1] == 1
    kinds = lm.counts(make_docs([(*r, "en", "s") for r in rows[:2]])).where("kind = 1").collect()
    assert sorted(r["n"] for r in kinds) == [1, 1, 2]  # two words and two ends


def test_word_digests_forget():
    from panelyard.llm.common import WordDigests, word_digests
    few, words = WordDigests(limit=1000), [str(i).encode() for i in range(500)] * 2 + [b"x" * 5000]
    assert (word_digests(words, few) == word_digests(words)).all()
    assert len(few) < 20


def test_classes_come_back_by_a_salted_join(spark, make_docs):
    rows = [(i, "the same copy of a text in every third row" if i % 3 == 0 else f"own text {i} of row {i * 7} here", "en", "s") for i in range(60)]
    spark.conf.set("spark.panelyard.broadcastBytes", "0")
    try:
        out = neardup.near_duplicates(make_docs(rows))
        last = out._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" in last
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.panelyard.broadcastBytes")
    assert got == brute_components([r[:2] for r in rows])


def test_components_of_long_chain_and_hub(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(1000, k) for k in range(1001, 1200)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 1000 for k in range(1000, 1200)}


def test_near_duplicates_of_awkward_rows(make_docs):
    out = neardup.near_duplicates(make_docs(ROWS)).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[3]["n_shingles"] == 0 and by[4]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    kept = neardup.keep_one(make_docs(ROWS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8]
    assert neardup.near_duplicates(make_docs([])).count() == 0


# --- packing -------------------------------------------------------------------


def test_packing_is_whole_and_tight(docs, texts):
    rows = packing.pack_documents(docs.repartition(9), BPE, end=2).collect()
    tokenizer = Tokenizer.from_file(BPE)
    pieces_of = collections.defaultdict(list)
    for r in rows:
        pieces_of[r["doc_id"]].append(r)
    total = 0
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces_of[i], key=lambda r: r["piece"])):
            span = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(span))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1]) and sum(n for _, n in spans) <= 1024
    assert len(used) <= 1.06 * total / 1024 + 1


def test_packing_of_awkward_rows(make_docs):
    rows = packing.pack_documents(make_docs(ROWS), BPE).collect()
    assert sum(r["doc_id"] is None for r in rows) == 2 and {r["length"] for r in rows if r["doc_id"] == 4} == {1}
    assert sorted({r["piece"] for r in rows if r["doc_id"] == 7}) == list(range(len([r for r in rows if r["doc_id"] == 7])))
    assert packing.pack_documents(make_docs([]), BPE).count() == 0


# --- search --------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 16)), 2)
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [float("nan")] + [0.0] * 15), (902, [None] + [1.0] * 15), (None, [1.0] * 16), (903, [1.0, 2.0]), (904, []), (0, x[0].tolist())]
    frame = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), k=20, block=64).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] < 900)
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:20]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_a_query_block_goes_through_runs_of_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-20, 20, (90, 4))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    out = topk.top_k(frame, frame.where("vec_id % 9 = 0"), k=5, block=8, run_bytes=4 * 8 * 8 * 3)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in out.collect()}
    scores = (64 * vectors) @ (64 * vectors).T
    for q in range(0, 90, 9):
        best = sorted((i for i in range(90) if i != q), key=lambda i: (-scores[q, i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == best


def test_levels_drop_pairs():
    """Unordered vectors: the last level drops a third of the pairs at least; clustered ones: the first levels do."""
    rng = np.random.default_rng(4)
    plain = np.floor(64 * rng.normal(size=(6000, 64)) / 8).astype(np.int64)
    slow = np.repeat(rng.normal(size=(6000, 8)), 8, axis=1) + 0.05 * rng.normal(size=(6000, 64))
    for x, level, most in ((plain, 32, 0.67), (np.floor(64 * slow).astype(np.int64), 16, 0.2)):
        q, ids, left = x[::100], np.arange(len(x)), {}
        exact = q @ x.T
        exact[np.arange(len(q)), ids[::100]] = np.iinfo(np.int64).min
        least = np.sort(exact, axis=1)[:, -20]
        row, name, score = topk.best_of_block(ids[::100], q, least, ids, x, 20, survivors=left)
        assert (np.sort(score.reshape(len(q), 20), axis=1) == np.sort(exact, axis=1)[:, -20:]).all()
        assert left[level] <= most * left[0], left


def test_exact_scores_of_large_components():
    rng = np.random.default_rng(6)
    q, x = rng.integers(-2**28, 2**28, (3, 64)), rng.integers(-2**28, 2**28, (5, 64))
    row, col, score = topk.exact_scores(q, x, np.ones((3, 5), bool))
    assert (score == (q @ x.T)[row, col]).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-99, 99, (20, 64)), rng.integers(-99, 99, (50, 64))
    for s in topk.levels(64):
        assert (topk.bound(topk.segment_statistics(q, s), topk.segment_statistics(x, s), 64 // s) >= q @ x.T).all()


# --- classifiers ---------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    d, k = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = toxicity.score_documents(d, k).join(k, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.65 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_quality_on_labels(spark):
    d, k = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = quality.judge(d, k).join(k, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)


def test_classifiers_on_awkward_rows(make_docs, labels):
    frame = make_docs(ROWS)
    for labelled in (labels, labels.limit(0)):
        scored = toxicity.score_documents(frame, labelled).collect()
        assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
        judged = quality.judge(frame, labelled).collect()
        assert len(judged) == len(ROWS) and all(0 <= r["score"] <= 1 for r in judged)
    assert all(r["kept"] for r in judged)
    assert toxicity.drop_toxic(frame, labels).columns == frame.columns == quality.keep_good(frame, labels).columns
    assert toxicity.score_documents(make_docs([]), labels).count() == 0 == quality.judge(make_docs([]), labels).count()


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("one", "a", 0.05)]
    frame = spark.createDataFrame(rows, "host string, path string, p double").withColumn("logit", F.log(F.col("p") / (1 - F.col("p"))))
    out = {r["host"]: r for r in quality.combine(frame, quality.site_posteriors(frame)).collect()}
    assert out["big"]["p_path"] > 0.85 and out["bad"]["p_path"] < 0.15 and 0.4 < out["one"]["p_path"] < 0.6


# --- rules and shards ----------------------------------------------------------


def repeated_words(text, size=8):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
    many = collections.Counter(windows)
    return len({p for k, x in enumerate(windows) if many[x] > 1 for p in range(k, k + size)})


def test_rule_measures_equal_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated_words(t))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * want[4] > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_rules_of_awkward_rows(make_docs):
    out = rules.judge(make_docs(ROWS)).collect()
    assert len(out) == len(ROWS) and {r["n_repeat_words"] for r in out if r["doc_id"] == 7} == {30_000}
    assert rules.judge(make_docs([])).count() == 0


def test_every_rule_can_reject_what_passes_the_base(make_docs):
    most = {"repeat_permille": 300}  # the base lets no more through
    assert all(r.reach * r.least < most.get(r.name, 1000) for r in rules.RULES if not r.low)
    out = rules.judge(make_docs([(1, " ".join(f"w{k}" for k in range(40)), "en", "s")]))
    assert "repeat_permille" in out.columns and "repeat_permille_high" not in out.columns


def test_fences_shrink_to_the_language_gradually(make_docs):
    def plain(k):
        return " ".join(f"word{k}x{j}" for j in range(30))

    def marked(k, n):
        return plain(k) + " " + "#" * n

    rows = [(k, plain(k), "en", "big") for k in range(400)] + [(1000 + k, marked(k, 40), "en", "few") for k in range(3)]
    rows += [(2000 + k, marked(k, 40), "en", "own") for k in range(300)] + [(5000, plain(1), "xx", None)]
    out = rules.judge(make_docs(rows), prior=20).collect()
    high = {r["source"]: r["symbol_permille_high"] for r in out}
    kept = collections.Counter((r["source"], r["kept"]) for r in out)
    # a language of both kinds has a wide spread, which the few take over and the many do not
    assert high["big"] < high["own"] < high["few"] and kept["own", True] == 300 and kept["big", True] == 400
    wide = {r["source"]: r["symbol_permille_high"] for r in rules.judge(make_docs(rows), prior=10 ** 6).collect()}
    assert wide["few"] == wide["big"]  # the prior alone

    def by_hand(own, toward, prior, part):
        weights = {b: 1000 * own.get(b, 0) + prior * 1000 * toward.get(b, 0) // sum(toward.values()) for b in {*own, *toward}}
        seen = 0
        for b in sorted(weights):
            seen += weights[b]
            if 4 * seen >= part * sum(weights.values()):
                return b, weights
    values = collections.defaultdict(collections.Counter)
    for r in out:
        v = r["symbol_permille"]
        cut = max(v.bit_length() - 6, 0)
        for group in ((r["lang"], r["source"]), (r["lang"],), ()):
            values[group][v >> cut << cut] += 1
    for pair in [g for g in values if len(g) == 2]:
        _, language = by_hand(values[pair[:1]], values[()], 20, 1)
        q1, _ = by_hand(values[pair], language, 20, 1)
        q3, _ = by_hand(values[pair], language, 20, 3)
        assert high[pair[1]] == q3 + 3 * max(q3 - q1, 20)


def test_shards_match_the_mixture(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)  # many buckets
    rows = [(i, f"text {i % 90}", "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(1000)] + [(None, None, None, None)] * 60
    out = sharding.shard_documents(make_docs(rows)).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == 1060 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    for source, n in collections.Counter(r["source"] for r in out).items():
        share = collections.Counter(r["shard"] for r in out if r["source"] == source)
        assert all(abs(share[s] - n / 24) <= 2 for s in range(24))
    again = sharding.shard_documents(make_docs(rows[:1000]).repartition(5)).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in again} == {
        r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(make_docs(rows[:1000])).collect()}
    assert all(r["text_crc32"] == zlib.crc32(f"text {r['doc_id'] % 90}".encode()) for r in again)
    assert sharding.shard_documents(make_docs([])).count() == 0


# --- language model ------------------------------------------------------------


def naive_score(contexts, data):
    data, total = b"\n" * lm.ORDER + data, 0.0
    for p in range(lm.ORDER, len(data)):
        gone = set()
        for k in range(lm.ORDER, -1, -1):
            live = {s: c for s, c in contexts.get(data[p - k:p], {}).items() if s not in gone}
            if not live:
                continue
            room = sum(live.values()) + len(live)
            if data[p] in live:
                total += math.log10(live[data[p]] / room)
                break
            total += math.log10(len(live) / room)
            gone |= set(live)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_language_model_equals_brute_force(docs, texts):
    contexts, count = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), "\n"])
            data = b"\n" * lm.ORDER + " ".join(words(t)).encode() + b"\n"
            for p in range(lm.ORDER, len(data)):
                for k in range(lm.ORDER + 1):
                    contexts[data[p - k:p]][data[p]] += 1
    whole = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    parts = {r["doc_id"]: r for r in lm.score_documents(docs, shard_rows=9_000, shard_words=7_000).collect()}
    room = math.log10(sum(count.values()) + len(count) + 1)
    for i, t in texts:
        tokens, r = [*words(t), "\n"], whole[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), sum(count.values()))
        assert r["base_score"] == pytest.approx(sum(math.log10(count[w] + 1) - room for w in tokens), abs=1e-6)
        assert (parts[i]["n_known"], parts[i]["score"]) == (r["n_known"], pytest.approx(r["score"], abs=1e-6))
    for i, t in texts[:40]:
        assert whole[i]["score"] == pytest.approx(naive_score(contexts, " ".join(words(t)).encode() + b"\n"), abs=1e-6)


def test_language_model_of_awkward_rows(make_docs):
    out = lm.score_documents(make_docs(ROWS)).collect()
    assert len(out) == len(ROWS) and all(r["score"] < 0 for r in out) and {r["n_tokens"] for r in out if r["doc_id"] == 3} == {1}
    assert lm.score_documents(make_docs([])).count() == 0


# --- pieces and licences -------------------------------------------------------


def test_pieces_round_trip_and_repeat(make_docs):
    rows = pieces.encode(make_docs(ROWS), PIECES)
    again = pieces.encode(make_docs(ROWS).repartition(4), PIECES)
    assert all(r["lossless"] for r in rows.collect())
    key = lambda r: (r["doc_id"] or -1, r["ids"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, again.collect()))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, PIECES).collect()}
    assert back[8] == ROWS[-1][1] and back[3] == ""
    assert pieces.encode(make_docs([]), PIECES).count() == 0


def test_sampled_pieces_follow_the_lattice():
    lattice = pieces.Lattice.of(PIECES, 1e-4)
    weights = {}

    def walk(rest, ids, w):
        if not rest:
            weights[tuple(ids)] = math.exp(w)
        for k in range(1, len(rest) + 1):
            if rest[:k] in lattice.weight:
                i, v, _ = lattice.weight[rest[:k]]
                walk(rest[k:], [*ids, i], w + v)
    walk("▁there", [], 0.0)
    seen = collections.Counter(tuple(lattice.sample(" there", str(k))) for k in range(4000))
    total = sum(weights.values())
    for ids, w in weights.items():
        assert abs(seen[ids] / 4000 - w / total) < 0.04


def test_sampled_pieces_of_odd_and_long_texts(monkeypatch):
    lattice = pieces.Lattice.of(PIECES, pieces.SMOOTH)
    odd = ["", " ", "▁", " ▁ ", "a ▁▁ b", "é世界😀\x00\x01", "   x  ", "\n\n a\t b", "a" * 3000, "word" * 900 + " tail", "😀" * 1500, "x y " * 3000]
    rows = [(t, str(k)) for k, t in enumerate(odd)]
    whole = [ids.tolist() for ids in lattice.sample_all(rows)]
    assert [lattice.decode(ids) for ids in whole] == odd
    assert whole == [lattice.sample(t, k) for t, k in rows]
    monkeypatch.setattr(pieces, "SLAB", 50)  # draws do not depend on the slabs
    assert whole == [ids.tolist() for ids in lattice.sample_all(rows)]


def test_long_segments_follow_the_same_law(monkeypatch):
    lattice = pieces.Lattice.of(PIECES, 1e-4)
    rows = [(" therefore" * 3, str(k)) for k in range(300)]
    whole = lattice.sample_all(rows)
    monkeypatch.setattr(pieces, "WHOLE", 4)  # all by blocks of positions
    assert [a.tolist() for a in whole] == [a.tolist() for a in lattice.sample_all(rows)]


def test_licences_are_inherited(make_docs):
    rows = [(1, "x\nReleased under the MIT License.", "a", "r"), (2, "plain text", "a/b", "r"), (3, "Licensed under CC BY-NC 4.0.", "a/b", "r"),
            (4, "plain", "a/b/c", "r"), (5, "plain", "z", "r"), (6, None, None, None), (None, "Released under the MIT License.", "q", "r"), (7, "under the license of a friend", "z", "r")]
    frame = make_docs(rows + rows[:1])
    out = {r["doc_id"]: r for r in licenses.scan(frame, F.concat_ws("/", "lang", F.col("doc_id").cast("string"))).collect()}
    assert [out[k]["licence"] for k in (1, 2, 3, 4, 5, 6, 7)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None, None, None]
    assert out[4]["inherited_from"] == "a/b" and out[1]["inherited_from"] is None
    assert licenses.scan(make_docs([]), F.lit("a")).count() == 0


def test_only_licence_files_rule_a_directory(make_docs):
    header = "Released under the MIT License.\n" + "some other words of a program\n" * 40
    tag = "# SPDX-License-Identifier: Apache-2.0\n" + "x = y + z\n" * 40
    rows = [(1, header, "a/main", "r"), (2, "plain", "a/b", "r"), (3, tag, "c/main", "r"), (4, "plain", "c/b", "r"),
            (5, header, "d/LICENSE.md", "r"), (6, "plain", "d/e/f", "r"), (7, "Released under the MIT License.", "g/h", "r"), (8, None, "g/i", "r"),
            (9, "no words of any grant", "k/COPYING", "r"), (10, "plain", "k/l", "r")]
    out = {r["doc_id"]: r for r in licenses.scan(make_docs(rows), F.col("lang")).collect()}
    assert [out[k]["licence"] for k in range(1, 11)] == ["MIT", None, "Apache-2.0", None, "MIT", "MIT", "MIT", "MIT", None, None]
    assert [k for k in out if out[k]["licence_file"]] == [5, 7] and out[6]["inherited_from"] == "d" and out[8]["inherited_from"] == "g"


def test_licences_in_headers_and_files(make_docs):
    from panelyard.llm.license_texts import TEMPLATES

    header = next(t for t in TEMPLATES["Apache-2.0"] if "in compliance with" in t and "governing" in t)
    full = {n: max(TEMPLATES[n], key=len) for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0")}
    wrapped = "".join(f"# {w}\n" if k % 7 == 6 else f"{w} " for k, w in enumerate(header.split()))
    found = [("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
             ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)", "(MIT OR GPL-2.0)"), ("SPDX-License-Identifier: NONE", None),
             (header, "Apache-2.0"), (f"# Copyright 2020 A\n#\n# {wrapped}\nimport os\n" + "x = y + z\n" * 50, "Apache-2.0"),
             ("Before it. Licensed under the Apache License, Version 2.0. And much text after it, on the same line as the sentence", "Apache-2.0"),
             *[("Copyright (c) 2020 A\n\n" + re.sub(r"(.{60}\S*) ", r"\1\n", t), n) for n, t in full.items()],
             ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
             ("the law permits distribution of software and the terms of this work to any person", None)]
    out = {r["doc_id"]: r["own"] for r in licenses.scan(make_docs([(k, t, "a", "r") for k, (t, _) in enumerate(found)]), F.lit("a/b")).collect()}
    assert [out[k] for k in range(len(found))] == [n for _, n in found]


def test_best_passage_equals_brute_force(texts):
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, 0)
    vectors = [{w: matcher.vectors[k, n] for w, n in matcher.rank.items() if matcher.vectors[k, n]} for k in range(len(matcher.sizes))]
    rng = np.random.default_rng(1)
    vocabulary = [*list(matcher.rank)[:40], "foo", "bar"]
    made = [" ".join(rng.choice(vocabulary) + "\n" * (rng.random() < 0.2) for _ in range(n)) for n in rng.integers(2, 90, 20)]
    for text in [*made, *[t for _, t in texts[:20] if t and len(t) < 1500]]:
        best, every = 0.0, [licenses._TOKEN.findall(line) for line in text.lower().split("\n")]
        blocks, flat = [[]], sum(every, [])
        for line in every:
            blocks[-1].extend(line) if line else blocks.append([])
        for size, vector in zip(matcher.sizes, vectors):
            runs = [flat[k:k + size] for k in range(len(flat) - size + 1)]
            for run in filter(None, [*every, *blocks, flat, *runs]):
                unit = matcher._unit(collections.Counter(run))
                best = max(best, sum(v * unit.get(w, 0.0) for w, v in vector.items()))
        if len(set(flat) & set(matcher.rank)) > 1:
            assert abs(matcher.best(text, 2.0)[1] - best) < 1e-9


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    left = docs
    for k, (_, stage_of) in enumerate(corpus_pipeline.STAGES):
        stage_of(spark, left, SF).write.parquet(str(tmp_path / str(k)))
        left = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert left.columns == docs.columns and 0 < left.count() <= docs.count()
    kept = spark.read.parquet(str(tmp_path / "2"))
    assert {r[0] for r in left.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
