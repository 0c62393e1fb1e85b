"""Hierarchical residual packing of documents into sequences of bounded length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import ship, small_batches, tidied
from panelyard.llm.tokens import WordEncoder
from panelyard.plans.stage import stage

LENGTH = 1024
WINDOW_ITEMS = 100_000
WINDOW_BYTES = 1 << 21
#: one piece inside a bin; ``has_id`` is 0 for a null id
PIECE = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("has_id", "u1")])
BINS = "sequence_id long, round int, part int, fill int, pieces binary"


def cut(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences, the rest as the first piece."""
    if n <= length:
        yield 0, n
        return
    first = n % length
    if first:
        yield 0, first
    for start in range(first, n, length):
        yield start, length


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, goes where it leaves the least space.

    Equal sizes keep their order. A sorted list of the free spaces in use, at
    most ``room`` of them, finds the tightest bin.
    """
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(spaces, size)
        if k < len(spaces):
            space = spaces[k]
            at = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space]
                spaces.pop(k)
            bins[at].append(i)
        else:
            space, at = room, len(bins)
            bins.append([i])
        left = space - size
        if left:
            if left not in open_bins:
                open_bins[left] = []
                bisect.insort(spaces, left)
            open_bins[left].append(at)
    return bins


def _bins(sizes: np.ndarray, items: list[bytes], room: int, round_: int, first: int) -> pa.RecordBatch:
    groups = best_fit(sizes, room)
    fills = [int(sizes[g].sum()) for g in groups]
    part = TaskContext.get().partitionId()
    ids = [(round_ << 56) | (part << 32) | (first + k) for k in range(len(groups))]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([round_] * len(groups), pa.int32()), pa.array([part] * len(groups), pa.int32()),
         pa.array(fills, pa.int32()), pa.array([b"".join(items[i] for i in g) for g in groups], pa.binary())],
        ["sequence_id", "round", "part", "fill", "pieces"])


def pack_lengths(pieces: DataFrame, length: int = LENGTH, slack: int = 8, fan: int = 8) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, crc; lengths 1 to ``length``) into sequences.

    Returns doc_id, piece, start, length, crc, sequence_id, offset. Each task
    packs what it holds by best fit, in windows of bounded size; bins with at most
    ``slack`` places free are final. The others go on as items: groups of ``fan``
    tasks merge theirs and pack again, until one group is left. Each round is
    written, so a lost executor repeats tasks of one round only, and only
    underfull bins ever move. Bins hold at most ``length`` pieces.
    """
    ship(pieces.sparkSession)
    narrow = pieces.select("doc_id", F.col("piece").cast("int"), F.col("start").cast("long"), F.col("length").cast("int"),
                           F.col("crc").cast("long"))
    return _merged(narrow.mapInArrow(tidied(_first_round(length)), BINS), length, slack, fan)


def _first_round(length: int):
    """Best fit of the pieces that a task holds, in windows of bounded size: batches of pieces to batches of bins."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, made = [], 0, 0
        for batch in batches:
            rows = np.zeros(batch.num_rows, PIECE)
            rows["has_id"] = np.asarray(batch.column(0).is_valid())
            for name, column in zip(("doc_id", "piece", "start", "length", "crc"), batch.columns, strict=True):
                rows[name] = column.fill_null(0).to_numpy(zero_copy_only=False)
            held.append(rows)
            count += len(rows)
            if count >= WINDOW_ITEMS:
                out = first(np.concatenate(held), made)
                made, held, count = made + out.num_rows, [], 0
                yield out
        if count:
            yield first(np.concatenate(held), made)

    def first(rows: np.ndarray, made: int) -> pa.RecordBatch:
        return _bins(rows["length"].astype(np.int64), [r.tobytes() for r in rows], length, 1, made)

    return local


def _merged(bins: DataFrame, length: int, slack: int, fan: int = 8) -> DataFrame:
    """The pieces of all bins with sequence_id and offset, after the rounds that merge underfull ones."""
    def again(round_: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, made = [], 0
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= WINDOW_ITEMS:
                    out = _next(held, round_, made)
                    made, held = made + out.num_rows, []
                    yield out
            if held:
                yield _next(held, round_, made)
        return merge

    def _next(held: list[pa.RecordBatch], round_: int, made: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).sort_by([("fill", "descending"), ("sequence_id", "ascending")])
        return _bins(whole["fill"].to_numpy().astype(np.int64), whole["pieces"].to_pylist(), length, round_, made)

    with small_batches(bins.sparkSession):
        rounds = [stage(bins, "packed")]
    parts = (rounds[0].agg(F.max("part")).first()[0] or 0) + 1
    final = None
    while parts > 1:
        last = rounds[-1]
        done = last.where(F.col("fill") >= length - slack)
        final = done if final is None else final.unionByName(done)
        left = last.where(F.col("fill") < length - slack).withColumn("group", F.floor(F.col("part") / fan))
        parts = -(-parts // fan)
        moved = left.repartition(parts, "group").select("fill", "sequence_id", "pieces", "group")
        if parts > 1:
            merged = moved.sortWithinPartitions("group").select("fill", "sequence_id", "pieces")
        else:
            merged = moved.select("fill", "sequence_id", "pieces")
        rounds.append(stage(merged.mapInArrow(tidied(again(len(rounds) + 1)), BINS), "packed"))
        parts = min(parts, (rounds[-1].agg(F.max("part")).first()[0] or 0) + 1) if parts > 1 else 1
    final = rounds[-1] if final is None else final.unionByName(rounds[-1])
    return final.select("sequence_id", "pieces").mapInArrow(
        tidied(unpack), "doc_id long, piece int, start long, length int, crc long, sequence_id long, offset long")


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins to one row per piece with its place in the sequence."""
    for batch in batches:
        held = [np.frombuffer(p, PIECE) for p in batch.column(1).to_pylist()]
        if not held:
            continue
        counts = [len(h) for h in held]
        rows = np.concatenate(held)
        offset = np.concatenate([np.cumsum(h["length"]) - h["length"] for h in held])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], mask=rows["has_id"] == 0), pa.array(rows["piece"]), pa.array(rows["start"]),
             pa.array(rows["length"]), pa.array(rows["crc"].astype(np.int64)),
             pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(offset.astype(np.int64))],
            ["doc_id", "piece", "start", "length", "crc", "sequence_id", "offset"])


def token_pieces(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, crc (of little-endian unsigned 32-bit ids) and, on demand, ids of every document.

    Null texts are empty; a document's ids are those of its whole text, then
    ``end``. Null ids of documents stay null; repeated rows are documents of
    their own; an empty table gives no rows; other columns are left out.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, crc long" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(tidied(_encoder(tokenizer, end, length, ids)), schema)


def _encoder(tokenizer: str, end: int, length: int, ids: bool = False):
    """Batches of (doc_id, text) to batches of pieces."""
    names = ["doc_id", "piece", "start", "length", "crc"] + ["ids"] * ids
    last = int(end).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for doc_ids, texts in _windows(batches):
            yield pieces_of(doc_ids, encoder.encode_all(texts))
        encoder.clear()

    def pieces_of(doc_ids: pa.Array, coded: Iterator[np.ndarray]) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in names]
        for doc_id, found in zip(doc_ids.to_pylist(), coded, strict=True):
            data = found.tobytes() + last
            for k, (start, n) in enumerate(cut(len(data) // 4, length)):
                span = data[4 * start:4 * (start + n)]
                for column, value in zip(rows, (doc_id, k, start, n, zlib.crc32(span), span), strict=False):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=False)], names)

    return encode


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text (null: empty) of rows in their order, about ``WINDOW_BYTES`` of text at a time."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy() + 16)  # short texts count too
        at, done = 0, 0
        while at < len(texts):
            to = min(int(np.searchsorted(ends, done + WINDOW_BYTES - size)) + 1, len(texts))
            held.append((batch.column(0).slice(at, to - at), texts.slice(at, to - at)))
            size += int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if size >= WINDOW_BYTES:
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH, slack: int = 8) -> DataFrame:
    """Every piece of every document with its sequence and place: see :func:`token_pieces` and :func:`pack_lengths`.

    A task encodes and packs in one Python worker: two calls one after the other
    would take two, and an executor pays for the memory of both.
    """
    ship(docs.sparkSession)
    encode, pack = _encoder(tokenizer, end, length), _first_round(length)
    bins = docs.select("doc_id", "text").mapInArrow(tidied(lambda batches: pack(encode(batches))), BINS)
    placed = _merged(bins, length, slack)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long"), F.col("crc").alias("ids_crc32"),
                         "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH) -> DataFrame:
    """sequence_id and token ids (little-endian 32-bit) of each packed sequence; doc_id must be unique here."""
    ids = token_pieces(docs, tokenizer, end, length, ids=True).select("doc_id", "piece", "ids")
    rows = packed.join(ids, (packed.doc_id.eqNullSafe(ids.doc_id)) & (packed.piece == ids.piece)).select("sequence_id", "offset", "ids")
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))
