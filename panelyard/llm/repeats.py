"""Repeated passages: shards of suffixes that meet wherever their texts lie, put in order by induced sorting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import byte_rows, mix64, power_tables, ship, tidied
from panelyard.llm.suffixes import permuted_prefixes, suffix_array
from panelyard.plans.skew import broadcast_bytes, measured_bytes
from panelyard.plans.stage import stage

#: a byte that no UTF-8 text holds
GAP = 0xFF
PLACE_BITS = 22
TAG_BITS = 24
WIDTH_BITS = 12
#: rows and bytes of what a task gives out at a time
GIVEN_ROWS, GIVEN_BYTES = 20_000, 1 << 21
SEGMENTS = "key long, d1 long, d2 long, doc_id long, at long, shape long"
MARKS = "doc_id long, at long, shape long"


@dataclass(frozen=True)
class Settings:
    """``span`` bytes make a repeat; ``gram`` bytes an anchor.

    Texts are looked through in chunks of about ``chunk_bytes`` (below 2 MB). A shard
    has about ``shard_bytes``, a partition about ``partition_bytes`` of them unless
    the session asks for more partitions; anchors with over ``shard_segments`` segments of
    different bytes do not go to shards. The segments of one anchor are judged by
    one task, up to ``crowd`` or, if that is more, one ``most_crowded``-th of all;
    of those beyond, at most ``most_crowded``, no task sees all.
    """

    span: int = 100
    gram: int = 24
    shard_bytes: int = 1 << 18
    partition_bytes: int = 1 << 26
    chunk_bytes: int = 1 << 19
    shard_segments: int = 10_000
    crowd: int = 1_000_000
    most_crowded: int = 100_000


# --- anchors and segments ---------------------------------------------------------


def anchored(data: np.ndarray, ends: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key) of the segments of some texts laid end to end.

    Each window of ``span`` bytes has an anchor, the gram with the smallest digest
    in it, the first of equal ones. A segment is a row of neighbouring windows with
    one anchor; its key is the anchor's digest, so equal windows have equal keys,
    whatever surrounds them. Windows do not cross the ends of texts.
    """
    span, gram = settings.span, settings.gram
    count = len(data) - span + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    digest = mix64((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, size, width = (digest & ~low) | np.arange(len(digest), dtype=np.uint64), 1, span - gram + 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    new = np.append(True, least[1:] != least[:-1])
    new[ends[ends < count]] = True
    last = ends - span + 1  # the first place at which no window of the text begins
    new[last[(last >= 0) & (last < count)]] = True
    starts = np.flatnonzero(new)
    windows = np.diff(np.append(starts, count))
    inside = starts + span <= ends[np.searchsorted(ends, starts, "right")]
    starts, windows = starts[inside], windows[inside]
    return starts, windows, digest[(least[starts] & low).astype(np.int64)].view(np.int64)


def _chunks(column: pa.Array, settings: Settings) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a column in chunks of bounded bytes: (bytes, ends, row, first byte in its text, tag) of each piece.

    A long text is cut into pieces that share ``span - 1`` bytes, so that each window is in one.
    """
    held, size = [], 0
    for row, data in enumerate(byte_rows(column)):
        if len(data) < settings.span:
            continue
        tag = tag_of(data)
        for base in range(0, len(data) - settings.span + 1, settings.chunk_bytes):
            held.append((data[base:base + settings.chunk_bytes + settings.span - 1], row, base, tag))
            size += len(held[-1][0])
            if size >= settings.chunk_bytes:
                yield _chunk(held)
                held, size = [], 0
    if held:
        yield _chunk(held)


def _chunk(held: list[tuple[bytes, int, int, int]]):
    pieces, row, base, tag = zip(*held, strict=True)
    return (b"".join(pieces), np.cumsum([len(p) for p in pieces]),
            np.array(row, np.int64), np.array(base, np.int64), np.array(tag, np.int64))


def tag_of(data: bytes) -> int:
    """Tells texts apart that share an id."""
    return zlib.crc32(data) & ((1 << TAG_BITS) - 1)


def _anchor_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, n: segments of every anchor that has two or more; written."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, *_ in _chunks(batch.column(0), settings):
                keys = anchored(np.frombuffer(data, np.uint8), ends, settings)[2]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first]), pa.array(np.diff(np.append(first, len(keys))))], ["key", "n"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(tidied(count), "key long, n long")
    return stage(rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")


def _segments(docs: DataFrame, settings: Settings) -> DataFrame:
    """Every segment: key, 128-bit digest of its bytes, doc_id, at (first byte, tag) and shape (windows, stride, repeats).

    Neighbouring segments with equal bytes, as in runs of one character, are one
    row: ``repeats`` segments, each ``stride`` bytes after the one before.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for data, ends, row, base, tag in _chunks(batch.column(1), settings):
                starts, windows, keys = anchored(np.frombuffer(data, np.uint8), ends, settings)
                if not len(starts):
                    continue
                view = memoryview(data)
                stops = (starts + windows + settings.span - 1).tolist()
                made = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops, strict=True)])
                digest = np.frombuffer(made, "<i8").reshape(-1, 2)
                piece = np.searchsorted(ends, starts, "right")
                stride = np.append(np.diff(starts), 0)
                link = (piece[1:] == piece[:-1]) & (keys[1:] == keys[:-1]) & (digest[1:] == digest[:-1]).all(axis=1)
                joined = np.append(False, link)
                joined[2:] &= ~link[:-1] | (stride[1:-1] == stride[:-2])
                first = np.flatnonzero(~joined)
                repeats = np.diff(np.append(first, len(starts)))
                begin = starts - np.append(0, ends)[piece] + base[piece]
                shape = windows[first] | np.where(repeats > 1, stride[first], 0) << WIDTH_BITS | repeats << 2 * WIDTH_BITS
                columns = [keys[first], digest[first, 0], digest[first, 1], ids[row[piece[first]]],
                           begin[first] << TAG_BITS | tag[piece[first]], shape]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "d1", "d2", "doc_id", "at", "shape"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(tidied(cut), SEGMENTS)


def _place(at: str | Column) -> Column:
    """First byte of a segment, without the tag."""
    return F.shiftright(at, TAG_BITS)


def _judged(rows: DataFrame, first: Column, mixed: Column, wide: Column) -> DataFrame:
    """doc_id, at, shape, key; ``later``: equal bytes lie earlier; ``mixed``: the anchor has segments of other bytes; ``wide``: and too many."""
    place = F.struct("doc_id", _place("at").alias("start"))
    rows = rows.withColumns({"later": place > F.struct(first["doc_id"], _place(first["at"])), "mixed": mixed, "wide": wide})
    repeats = F.shiftright("shape", 2 * WIDTH_BITS) > 1
    return rows.select("doc_id", "at", "shape", "key", "later", "mixed", "wide").where(F.col("later") | F.col("mixed") | repeats)


def _judge_plain(segments: DataFrame, counts: DataFrame, settings: Settings) -> DataFrame:
    """Segments of anchors with a bounded number of them: one shuffle by anchor serves the join and both windows."""
    rows = segments.join(counts.select("key").hint("merge"), "key", "left_semi")
    anchor = Window.partitionBy("key")
    equal = Window.partitionBy("key", "d1", "d2").orderBy("doc_id", "at")
    other = [F.min(c).over(anchor) != F.max(c).over(anchor) for c in ("d1", "d2")]
    wide = F.count(F.lit(1)).over(anchor) > settings.shard_segments
    return _judged(rows, F.first(F.struct("doc_id", "at")).over(equal), other[0] | other[1], wide)


def _judge_crowded(segments: DataFrame, crowded: DataFrame) -> DataFrame:
    """The same for crowded anchors, by sums that are combined before the shuffle."""
    rows = stage(segments.join(F.broadcast(crowded), "key", "left_semi"), "crowded")
    firsts = stage(rows.groupBy("key", "d1", "d2").agg(F.min(F.struct("doc_id", "at")).alias("first")), "firsts")
    kinds = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))  # a row per crowded anchor
    rows = _join(rows, firsts, ["key", "d1", "d2"]).join(F.broadcast(kinds), "key")
    return _judged(rows, F.col("first"), F.col("kinds") > 1, F.lit(True))


def _join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a staged table: broadcast if its measured size is small, else by a shuffle, in which adaptive execution splits skew."""
    if measured_bytes(table) <= broadcast_bytes(rows.sparkSession):
        return rows.join(F.broadcast(table), on, how)
    return rows.join(table, on, how)


# --- shards ---------------------------------------------------------------------


def _bytes_of(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """key, doc_id, at, data of segments (doc_id, at, shape, key), cut from their texts."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # three numbers a segment, a third of what an array of structs takes
            packed = [np.stack([parts.values.field(k).to_numpy() for k in range(3)], axis=1).tobytes() for parts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "wanted"])

    lists = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("at", "shape", "key")).alias("wanted"))
    lists = stage(lists.mapInArrow(tidied(pack), "doc_id long, wanted binary"), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc_id, data, wanted in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), batch.column(2), strict=True):
                tag = tag_of(data)
                for at, shape, key in np.frombuffer(wanted.as_buffer(), np.int64).reshape(-1, 3).tolist():
                    if at & ((1 << TAG_BITS) - 1) == tag:
                        start, windows = at >> TAG_BITS, shape & ((1 << WIDTH_BITS) - 1)
                        for column, value in zip(out, (key, doc_id, at, data[start:start + windows + settings.span - 1]), strict=True):
                            column.append(value)
                        if len(out[0]) == GIVEN_ROWS:
                            yield given(out)
                            out = ([], [], [], [])
            yield given(out)

    def given(out: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["key", "doc_id", "at", "data"])

    rows = _join(docs.select("doc_id", "text"), lists, ["doc_id"])
    return rows.mapInArrow(tidied(cut), "key long, doc_id long, at long, data binary")


def shard_repeats(ids: np.ndarray, at: np.ndarray, parts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some segments that equal a window at an earlier place: (segment, first window, windows).

    The suffixes of all segments are put in one order; neighbours that share
    ``span`` bytes or more are one class, of which the first place stays.
    """
    data = np.frombuffer(bytes([GAP]).join(parts) + bytes([GAP]), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(np.append(data.astype(np.int64) + 1, 0))[1:]
    alike = permuted_prefixes(data, order)[order] >= span
    segment = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.arange(len(data)) - begins[segment]
    # a shared prefix may run over gaps where neighbours are alike too; windows do not
    valid = inside + span <= sizes[segment]
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    place = (rank << 40)[segment] + (at >> TAG_BITS)[segment] + inside
    starts = np.flatnonzero(~(alike & valid[order]))
    first = np.minimum.reduceat(place[order], starts)
    least = np.empty(len(data), np.int64)
    least[order] = np.repeat(first, np.diff(np.append(starts, len(order))))
    later = np.append(valid & (place > least), False)
    edges = np.flatnonzero(later[1:] != later[:-1]) + 1
    edges = np.append(0, edges) if later[0] else edges
    a, b = edges[0::2], edges[1::2]
    return segment[a], inside[a], b - a


def _sorted_shards(rows: DataFrame, settings: Settings) -> DataFrame:
    """Marks of the windows in rows (key, doc_id, at, data) that repeat an earlier one; anchors are never split over shards."""
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # a partition holds many shards, one after the other; partitions grow in number with the rows
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-total // settings.shard_bytes), max(least, -(-total // settings.partition_bytes))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([*(rest.to_batches() if rest else ()), batch]).combine_chunks()
            key, size = rest["key"].to_numpy(), np.cumsum([len(d) for d in rest["data"].to_pylist()])
            begin, done = 0, 0
            for end in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
                if size[end - 1] - done >= settings.shard_bytes:
                    yield _marks(rest.slice(begin, end - begin))
                    begin, done = end, size[end - 1]
            rest = rest.slice(begin)
        if rest:
            yield _marks(rest)

    def _marks(shard: pa.Table) -> pa.RecordBatch:
        ids, at = shard["doc_id"].to_numpy(), shard["at"].to_numpy()
        segment, first, windows = shard_repeats(ids, at, shard["data"].to_pylist(), settings.span)
        # a mark has one window, repeated at the next bytes
        shape = np.int64(1) | np.int64(1) << WIDTH_BITS | windows << 2 * WIDTH_BITS
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[segment]), pa.array(at[segment] + (first << TAG_BITS)), pa.array(shape)], ["doc_id", "at", "shape"])

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidied(work), MARKS)


def _single_windows(rows: DataFrame, settings: Settings) -> DataFrame:
    """Marks for anchors with a crowd of different segments: these are cut into windows, each of which is its own class."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, at, data in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                n = len(data) - settings.span + 1
                digest = np.frombuffer(b"".join([blake2b(data[i:i + settings.span], digest_size=16).digest() for i in range(n)]), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[0::2]), pa.array(digest[1::2]), pa.array(np.full(n, doc_id)),
                     pa.array(at + (np.arange(n) << TAG_BITS))], ["d1", "d2", "doc_id", "at"])

    rows = stage(rows.mapInArrow(tidied(cut), "d1 long, d2 long, doc_id long, at long"), "windows")
    firsts = stage(rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"),
                   "firsts")
    rows = _join(rows, firsts, ["d1", "d2"])
    later = F.struct("doc_id", _place("at").alias("start")) > F.struct(F.col("first.doc_id"), _place("first.at"))
    return rows.where(later).select("doc_id", "at", F.lit(1 | 1 << 2 * WIDTH_BITS).cast("long").alias("shape"))


# --- removal --------------------------------------------------------------------


def _covered(at: np.ndarray, shape: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag, begin, end) of the maximal covered stretches of each tag."""
    windows, stride = shape & ((1 << WIDTH_BITS) - 1), shape >> WIDTH_BITS & ((1 << WIDTH_BITS) - 1)
    repeats = shape >> 2 * WIDTH_BITS
    tag, begin = at & ((1 << TAG_BITS) - 1), at >> TAG_BITS
    # neighbours that repeat overlap or touch: the stride is at most the windows of an anchor
    end = begin + (repeats - 1) * stride + windows + span - 1
    order = np.lexsort((begin, tag))
    tag, begin, end = tag[order], begin[order], end[order]
    reach = np.maximum.accumulate(end + (np.cumsum(np.append(0, tag[1:] != tag[:-1])) << 44))
    reach -= np.cumsum(np.append(0, tag[1:] != tag[:-1])) << 44
    new = np.append(True, (tag[1:] != tag[:-1]) | (begin[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return tag[first], begin[first], np.append(reach[first[1:] - 1], reach[-1])


def _stretches(marks: DataFrame, span: int) -> DataFrame:
    """doc_id, stretches (tag, begin, end) of all bytes that marks cover; written."""
    kind = pa.list_(pa.struct([("tag", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column(1):
                tag, begin, end = _covered(*[parts.values.field(k).to_numpy() for k in range(2)], span)
                found.append([{"tag": t, "begin": a, "end": b} for t, a, b in zip(tag.tolist(), begin.tolist(), end.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "stretches"])

    lists = marks.groupBy("doc_id").agg(F.collect_set(F.struct("at", "shape")).alias("marks"))
    return stage(lists.mapInArrow(tidied(merge), "doc_id long, stretches array<struct<tag:long,begin:long,end:long>>"), "stretches")


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, spans (begin, length; removed stretches of bytes) and kept (the other bytes) of every row of ``docs``.

    Texts are UTF-8 bytes, null as empty. A byte is removed if a string of ``span``
    bytes that covers it also starts at an earlier place: in a text with a smaller
    id, or before in the same one. Rows that share an id count as one text in
    this order: a place is (id, first byte), so equal rows have equal results. A
    row without an id has no place: it stays whole and makes no other a repeat.
    Texts shorter than ``span`` stay whole; an empty table gives no rows; other
    columns are left out. A long text is cut into pieces for all but its last
    step, which holds the text of one row.

    Only segments whose anchor occurs twice are looked at. Equal segments are one
    string of a shard, with the first of their places; where an anchor has
    different segments, the shard's suffixes tell which windows they share.
    Equal means a 128-bit digest for whole segments, all bytes for windows.
    """
    ship(docs.sparkSession)
    counts = _anchor_counts(docs, settings)
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(settings.crowd, (total or 0) // settings.most_crowded)
    segments = _segments(docs, settings)
    judged = stage(_judge_plain(segments, counts.where(F.col("n") <= limit), settings), "judged")
    if (most or 0) > limit:
        crowd = stage(counts.where(F.col("n") > limit).select("key"), "crowd")
        judged = judged.unionByName(stage(_judge_crowded(segments, crowd), "judged"))
    later = judged.where("later").select("doc_id", "at", "shape")
    stride = F.shiftright("shape", WIDTH_BITS).bitwiseAND((1 << WIDTH_BITS) - 1)
    again = judged.where(~F.col("later") & (F.shiftright("shape", 2 * WIDTH_BITS) > 1)).select(
        "doc_id", (F.col("at") + F.shiftleft(stride, TAG_BITS)).alias("at"), (F.col("shape") - (1 << 2 * WIDTH_BITS)).alias("shape"))
    marks = later.unionByName(again)
    wanted = judged.where(~F.col("later") & F.col("mixed"))
    if not wanted.where("wide").isEmpty():
        marks = marks.unionByName(_single_windows(_bytes_of(docs, wanted.where("wide"), settings), settings))
    wanted = wanted.where(~F.col("wide"))
    parts = stage(_bytes_of(docs, wanted, settings), "parts")
    marks = marks.unionByName(_sorted_shards(parts, settings))
    rows = _join(docs.select("doc_id", "text"), _stretches(marks, settings.span), ["doc_id"], "left")
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held = 0, 0
            sizes, spans, kept = [], [], []
            for row, (data, found) in enumerate(zip(byte_rows(batch.column(1)), batch.column(2), strict=True)):
                found = found.as_py()
                tag = tag_of(data) if found else None
                own = [(s["begin"], s["end"]) for s in found or () if s["tag"] == tag]
                sizes.append(len(data))
                spans.append([{"begin": a, "length": b - a} for a, b in own])
                cuts = [0, *[x for pair in own for x in pair], len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(cuts[0::2], cuts[1::2], strict=True)]))
                held += len(data)
                if held >= GIVEN_BYTES or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(spans, kind),
                         pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
                    first, held = row + 1, 0
                    sizes, spans, kept = [], [], []

    return rows.mapInArrow(tidied(cut), "doc_id long, n_bytes long, spans array<struct<begin:long,length:long>>, kept binary")
