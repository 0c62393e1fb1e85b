"""Language-model scoring: prediction by partial matching over bytes, and a word base to compare with."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import WordDigests, byte_rows, fold, give_back, ship, tidied, word_digests, words_of
from panelyard.plans.stage import stage

ORDER = 5
END = 10  # a line end, which no word can hold, ends a text and pads its start
END_WORD = 0x5BD1E995A7F3C1D5 - (1 << 63)
SHARD_ROWS = 3_000_000
SHARD_WORDS = 4_000_000
WINDOW_BYTES = 1 << 19  # a window takes about 100 bytes of memory per byte of text


def normal(data: bytes) -> bytes:
    """The model's text: lower-case words (A-Z only) with single spaces, then the end symbol."""
    return b" ".join(words_of(data)) + bytes([END])


def grams(text: np.ndarray) -> np.ndarray:
    """Key of every position of texts that each start with ORDER end symbols: five bytes of context and the symbol."""
    n = len(text) - ORDER
    keys = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        keys = (keys << 8) | text[i:n + i]
    return keys


def _windows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a batch in windows of bounded bytes: (first row, normal texts)."""
    first, held, size = 0, [], 0
    for k, data in enumerate(byte_rows(batch.column(column))):
        held.append(normal(data))
        size += len(held[-1])
        if size >= WINDOW_BYTES:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _positions(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all positions of some texts, and the row each belongs to."""
    pad = bytes([END]) * ORDER
    data = np.frombuffer(pad + pad.join(held), np.uint8)
    keys = grams(data)
    sizes = np.array([len(h) for h in held])
    row = np.repeat(np.arange(len(held)), sizes + ORDER)[: len(keys)]
    ends = np.cumsum(sizes + ORDER) - ORDER
    starts = ends - sizes
    good = np.zeros(len(keys) + 1, np.int64)
    np.add.at(good, starts, 1)
    np.add.at(good, ends, -1)
    inside = np.cumsum(good[:-1]) > 0
    return keys[inside], row[inside]


def word_hashes(text: bytes, known: WordDigests | None = None) -> np.ndarray:
    """Hashes of the words of a normal text, the end included."""
    return np.append(word_digests(text[:-1].split(), known).astype(np.int64), END_WORD)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weight = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(weight, first)


def counts(docs: DataFrame) -> DataFrame:
    """kind (0: bytes, 1: words), key, n over the whole texts: every gram and every word, with nothing pruned."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        BUILT.clear()  # a worker that scored with an earlier model does not need it now
        known = WordDigests()
        held: list[tuple[list, list]] = [([], []), ([], [])]
        for batch in batches:
            for _, texts in _windows(batch, 0):
                words = np.concatenate([word_hashes(t, known) for t in texts])
                for kind, keys in ((0, _positions(texts)[0]), (1, words)):
                    seen, n = np.unique(keys, return_counts=True)
                    held[kind][0].append(seen)
                    held[kind][1].append(n)
                    if sum(map(len, held[kind][0])) > 2_000_000:
                        seen, n = _merge(*held[kind])
                        if len(seen) > 1_000_000:  # give out what one task should not hold
                            yield _counted(kind, seen, n)
                            held[kind] = ([], [])
                        else:
                            held[kind] = ([seen], [n])
        for kind in (0, 1):
            if held[kind][0]:
                yield _counted(kind, *_merge(*held[kind]))

    parts = docs.select("text").mapInArrow(tidied(count), "kind int, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _counted(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit: every worker holds its own."""
    return n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n


@dataclass(frozen=True)
class Trie:
    """Contexts of one part of the trie by order: sorted keys with counts and what exclusion needs.

    ``seen[k]``: keys (context of k bytes, symbol) with log10 of the count.
    ``nodes[k]``: context keys with log10 of 1 / (total + kinds) and of the escape
    kinds / (total + kinds); beside them the same for the next shorter context
    when all symbols of this one are excluded.
    """

    seen: list[tuple[np.ndarray, np.ndarray]]
    nodes: list[tuple[np.ndarray, np.ndarray]]


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def build(keys: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Trie:
    """Trie of the grams ``keys`` with counts ``n``; ``low``: counts of orders 0 and 1 over the whole corpus.

    Shorter contexts have the sums of the longer ones. A part of the grams holds
    every gram that ends, before the symbol, in some byte, so contexts of one
    byte and more are whole in it, and orders 0 and below come in ``low``.
    """
    levels = [(keys, n)]
    for k in range(ORDER - 1, -1, -1):
        short = levels[0][0] & ((1 << (8 * (k + 1))) - 1)
        levels.insert(0, _merge([short], [levels[0][1]]))
    if low is not None:
        levels[0] = low[0]
    seen, nodes = [], []
    tables = []
    for k, (key, count) in enumerate(levels):
        context = key >> 8
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, first) if len(key) else np.zeros(0, np.int64)
        kinds = np.diff(np.append(first, len(key)))
        tables.append((context[first], total, kinds, first))
        seen.append((key, _log(count.astype(float)).astype(np.float64)))
    for k, (context, total, kinds, first) in enumerate(tables):
        columns = [-_log(total + kinds), _log(kinds / (total + kinds))]
        if k:
            above, above_total, above_kinds, _ = tables[k - 1]
            at = np.searchsorted(above, context & ((1 << (8 * (k - 1))) - 1))
            key = levels[k][0] & ((1 << (8 * k)) - 1)
            shared = levels[k - 1][1][np.searchsorted(levels[k - 1][0], key)]
            rest = above_total[at] - (np.add.reduceat(shared, first) if len(first) else 0)
            left = above_kinds[at] - kinds
            room = np.maximum(rest + left, 1)
            columns += [-_log(room), np.where(left > 0, _log(left / room), 0.0)]
        else:
            columns += [-_log(np.maximum(256 - kinds, 1)), np.zeros(len(kinds))]
        nodes.append((context, np.column_stack(columns)))
    return Trie(seen, nodes)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def log_probability(trie: Trie, keys: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each distinct gram: longest known context first, then escapes."""
    out = np.zeros(len(keys))
    excluded = np.full(len(keys), -1)  # node whose symbols are excluded, one order up
    alive = np.arange(len(keys))
    for k in range(ORDER, -1, -1):
        gram = keys[alive] & ((1 << (8 * (k + 1))) - 1)
        node, known = _find(trie.nodes[k][0], gram >> 8)
        fresh = excluded[alive] < 0
        values = trie.nodes[k][1]
        room = np.zeros(len(alive))
        escape = np.zeros(len(alive))
        use = known & fresh
        room[use], escape[use] = values[node[use], 0], values[node[use], 1]
        use = known & ~fresh
        if use.any():
            above = trie.nodes[k + 1][1][excluded[alive[use]]]
            room[use], escape[use] = above[:, 2], above[:, 3]
        at, hit = _find(trie.seen[k][0], gram)
        hit &= known
        out[alive[hit]] += trie.seen[k][1][at[hit]] + room[hit]
        miss = known & ~hit
        out[alive[miss]] += escape[miss]
        excluded[alive] = np.where(known, node, excluded[alive] if k == ORDER else -1)
        alive = alive[~hit]
    # below order 0: every byte not seen at all is as likely as the others
    never = excluded[alive] < 0
    out[alive] += np.where(never, -np.log10(256), trie.nodes[0][1][0, 2] if len(trie.nodes[0][0]) else 0.0)
    return out


def _known(trie: Trie, keys: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """:func:`log_probability` of many grams, some at a time."""
    out = np.empty(len(keys))
    for a in range(0, len(keys), step):
        out[a:a + step] = log_probability(trie, keys[a:a + step])
    return out


def score_documents(docs: DataFrame, learn=None, shard_rows: int = SHARD_ROWS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``score`` is the log10 probability of the normal text (lower-case words,
    single spaces, end) under prediction by partial matching: byte contexts up to
    five, escapes by the number of kinds, exclusion of the symbols of the longer
    context, uniform below. Held-out rows are those whose crc32 of the id modulo
    7 is 2; a null id is learned from. The counts of all other texts are gathered
    by grouped sums.

    Models are used in parts of at most ``shard_rows`` grams (more only if one
    byte alone has more) or ``shard_words`` words, 16 bytes each, broadcast
    one after the other: a gram belongs to the part of the last byte of its
    context, so each position is scored in one part, and sums over parts give
    the same result however many there are. Null texts are empty: one end. A
    corpus without training rows gives uniform bytes. Repeated rows score alike;
    an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    taught = docs.where(~held_out if learn is None else learn)
    table = stage(counts(taught), "counts")
    sizes = {r["kind"]: (r["rows"], r["n"]) for r in table.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    gram_rows, (word_rows, total) = sizes.get(0, (0, 0))[0], sizes.get(1, (0, 0))
    last = F.shiftright("key", 8).bitwiseAND(0xFF)
    order0 = table.where("kind = 0").groupBy(F.col("key").bitwiseAND(0xFF).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    low = [(order0["key"].to_numpy().astype(np.int64), order0["n"].to_numpy())]  # at most 256 rows
    plan = []
    if gram_rows:
        # rows per last byte, at most 256: cut the bytes into runs of at most shard_rows where a byte allows it
        per = table.where("kind = 0").groupBy(last.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        first, held = 0, 0
        for r in per:
            if held and held + r["n"] > shard_rows:
                plan.append((0, first, r["b"]))
                first, held = r["b"], 0
            held += r["n"]
        plan.append((0, first, 256))
    word_parts = max(1, -(-word_rows // shard_words))
    plan += [(1, k, word_parts) for k in range(word_parts)]

    rows = docs.select(F.col("doc_id"), "text", held_out.alias("held_out"))
    one_pass = len(plan) == 1 + (1 if gram_rows else 0)
    if not one_pass:
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    results = []
    todo = [plan] if one_pass else [[p] for p in plan]
    for some in todo:
        models = {}
        for kind, a, b in some:
            chosen = table.where("kind = 0").where((last >= a) & (last < b)) if kind == 0 else table.where("kind = 1").where(F.pmod("key", F.lit(b)) == a)
            got = chosen.select("key", "n").toArrow()
            key, n = got["key"].to_numpy(), got["n"].to_numpy()
            order = np.argsort(key)
            models[kind] = (key[order], _narrow(n[order]), a, b)
        shared = spark.sparkContext.broadcast(models)
        results.append(_scored(rows, shared, low, total, word_rows, not one_pass))
    if one_pass:
        scored = results[0].withColumn("score", F.col("score") if gram_rows else F.col("n_bytes") * -float(np.log10(256)))
    else:
        every = results[0]
        for r in results[1:]:
            every = every.unionByName(r)
        sums = [F.sum(c).alias(c) for c in ("n_known", "base_score", "score")]
        scored = every.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes")], *sums)
        if not gram_rows:
            scored = scored.withColumn("score", F.col("n_bytes") * -float(np.log10(256)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


BUILT: dict[str, tuple] = {}


def _scored(rows: DataFrame, shared, low, total: int, kinds: int, keyed: bool) -> DataFrame:
    """Sums over the positions and words that the broadcast parts hold."""
    name = uuid.uuid4().hex
    names = ["doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score"] + ["row"] * keyed

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in BUILT:  # once per worker: its later tasks find it
            BUILT.clear()
            models, trie, memo = shared.value, None, None
            if 0 in models:
                key, n, *_ = models[0]
                trie = build(key, n.astype(np.int64), low)
                memo = _known(trie, key)
                # a gram that the memo lacks is in no place of the longest order, whose counts are done with
                trie.seen[ORDER] = (np.zeros(0, np.int64), np.zeros(0))
                give_back()
            BUILT[name] = models, trie, memo
        models, trie, memo = BUILT[name]
        if trie is not None:
            memo_key, _, first, stop = models[0]
        smooth, known = np.log10(float(total + kinds + 1)), WordDigests()
        for batch in batches:
            sums = np.zeros((5, batch.num_rows))
            for at, texts in _windows(batch, 1):
                span = slice(at, at + len(texts))
                sums[1, span] = [len(t) for t in texts]
                if trie is not None:
                    keys, row = _positions(texts)
                    mine = ((keys >> 8) & 0xFF >= first) & ((keys >> 8) & 0xFF < stop)
                    keys, row = keys[mine], row[mine]
                    order = np.argsort(keys)
                    ordered = keys[order]
                    start = np.append(True, ordered[1:] != ordered[:-1])
                    distinct = ordered[start]
                    value = np.zeros(len(distinct))
                    place, hit = _find(memo_key, distinct)
                    value[hit] = memo[place[hit]]
                    if not hit.all():
                        value[~hit] = log_probability(trie, distinct[~hit])
                    each = np.empty(len(keys))
                    each[order] = value[np.cumsum(start) - 1]
                    sums[4, span] = np.bincount(row, each, len(texts))
                hashes = [word_hashes(t, known) for t in texts]
                size = np.array([len(h) for h in hashes])
                sums[0, span] = size
                if 1 in models:
                    key, n, part, parts = models[1]
                    flat = np.concatenate(hashes)
                    row = np.repeat(np.arange(len(texts)), size)
                    if parts > 1:
                        mine = np.mod(flat, parts) == part
                        flat, row = flat[mine], row[mine]
                    distinct, back = np.unique(flat, return_inverse=True)
                    place, hit = _find(key, distinct)
                    c = np.zeros(len(distinct))
                    c[hit] = n[place[hit]]
                    sums[2, span] = np.bincount(row, hit[back], len(texts))
                    sums[3, span] = np.bincount(row, np.log10(c + 1)[back] - smooth, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(sums[k].astype(np.int64)) for k in (0, 1, 2)), pa.array(sums[3]), pa.array(sums[4]),
                 *([batch.column(3)] if keyed else [])], names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double" + ", row long" * keyed
    return rows.select("doc_id", "text", "held_out", *(["row"] if keyed else [])).mapInArrow(tidied(score), schema)
