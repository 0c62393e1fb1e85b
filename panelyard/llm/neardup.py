"""Near-duplicate documents by HyperMinHash: banded compressed registers, corrected estimate, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import WordDigests, byte_rows, mix64, ship, tidied, word_digests, words_of
from panelyard.llm.components import components
from panelyard.plans.skew import attach
from panelyard.plans.stage import stage


@dataclass(frozen=True)
class Settings:
    """``bands`` x ``rows`` registers. At a similarity of 0.75 a pair shares no band with probability
    (1 - 0.75**rows)**bands = 1e-6, and less above it; more for a few shingles (README). ``margin`` is in standard errors of the estimate."""

    words: int = 5
    percent: int = 75
    bands: int = 36
    rows: int = 4
    mantissa: int = 10
    margin: float = 6.0
    block: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(text: bytes, words: int, known: WordDigests | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; with fewer words, of the whole sequence.

    A shingle's hash is a chain of mixed word digests that starts from their
    number, so shingles that differ in one word never agree unless two digests
    do; any other two agree with a chance of 2**-64.
    """
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    each = word_digests(found, known)
    size = min(words, len(each))
    last = len(each) - size + 1
    out = np.full(last, size, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out ^= each[k:k + last]
    return np.unique(mix64(out))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a cryptographic digest of a sorted set, as two signed numbers."""
    one, other = np.frombuffer(blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8")
    return int(one), int(other)


def registers(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """HyperMinHash of a set: per bucket the leading zeros and leading mantissa bits of the smallest hash.

    A hash times the number of buckets gives bucket and remainder, so in sorted
    hashes the first of a bucket is its smallest. An empty bucket takes the next
    filled one's value, marked by the distance.
    """
    n = settings.registers
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    bucket = (high * np.uint64(n) + ((low * np.uint64(n)) >> np.uint64(32))) >> np.uint64(32)
    at, first = np.unique(bucket.astype(np.int64), return_index=True)
    rest = hashes[first] * np.uint64(n) | np.uint64(1)
    zeros = 63 - _floor_log2(rest)
    body = (rest << (zeros + 1).astype(np.uint64)) if len(rest) else rest
    value = (zeros.astype(np.uint32) << np.uint32(settings.mantissa)) | (body >> np.uint64(64 - settings.mantissa)).astype(np.uint32)
    places = np.arange(n)
    k = np.searchsorted(at, places)
    source = at[k % len(at)]
    distance = (source - places) % n
    return (value[k % len(at)] ^ (distance.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(8))).astype(np.uint32)


def _floor_log2(x: np.ndarray) -> np.ndarray:
    """Exact position of the highest bit of unsigned 64-bit values."""
    top = x >> np.uint64(32)
    big = top > 0
    part = np.where(big, top, x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.frexp(part)[1] - 1 + 32 * big


def band_keys(found: np.ndarray, settings: Settings) -> np.ndarray:
    keys = np.arange(settings.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in found.reshape(settings.bands, settings.rows).astype(np.uint64).T:
        keys = mix64(keys ^ mix64(column + np.uint64(1)))
    return keys.astype(np.int64)


def signature(found: np.ndarray, settings: Settings) -> np.ndarray:
    """A short sketch: one byte of every register."""
    return ((found * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def may_link(a: np.ndarray, b: np.ndarray, n_a, n_b, settings: Settings, stray: float | None = None) -> np.ndarray:
    """Whether sizes and the estimated similarity of sketches leave room for a link; one pair or rows of pairs.

    Equal registers of different minima are taken off: with ``mantissa`` bits
    two unequal minima agree in about one of 2**mantissa registers. The estimate
    may fall short by ``margin`` standard errors, which for small sets count
    their elements rather than registers, so it never decides a close case.
    """
    goal = settings.percent / 100
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    stray = 1 / (1 << settings.mantissa) if stray is None else stray
    estimate = ((a == b).mean(axis=-1) - stray) / (1 - stray)
    slack = settings.margin * np.sqrt(goal * (1 - goal) / np.minimum(a.shape[-1], least))
    return (least >= goal * most) & (estimate >= goal - slack)


def linked(a: np.ndarray, b: np.ndarray, settings: Settings) -> bool:
    """The exact rule on full sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= settings.percent * (len(a) + len(b) - both)


def _sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n, digest of the set (d1, d2), band keys and short sketch of every row."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordDigests()
        for batch in batches:
            n, d1, d2, bands, signs = [], [], [], [], []
            for text in byte_rows(batch.column(1)):
                h = shingles(text, settings.words, known)
                one, other = digest(h)
                n.append(len(h))
                d1.append(one)
                d2.append(other)
                found = registers(h, settings) if len(h) else None
                bands.append(b"" if found is None else band_keys(found, settings).tobytes())
                signs.append(b"" if found is None else signature(found, settings).tobytes())
            flat = np.frombuffer(b"".join(bands), np.int64)
            ends = np.cumsum([0, *(len(b) // 8 for b in bands)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(signs, pa.binary())],
                ["doc_id", "n", "d1", "d2", "bands", "sign"])

    return docs.select("doc_id", "text").mapInArrow(tidied(sketch), "doc_id long, n long, d1 long, d2 long, bands array<long>, sign binary")


def _with_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """Rows of ``wanted`` (id, key, ...) with the full set of their document, made from its text."""
    names = wanted.columns
    schema = "hashes binary, " + ", ".join(f"{n} {t}" for n, t in wanted.dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packed, known = None, b"", WordDigests()
        for batch in batches:
            sets = []
            for text in byte_rows(batch.column(0)):
                if text != last:  # rows of one document come together
                    last, packed = text, shingles(text, settings.words, known).tobytes()
                sets.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], ["hashes", *names])

    rows = attach(docs.select(F.col("doc_id").alias("id"), "text"), wanted, ["id"], "inner")
    return rows.select("text", *names).mapInArrow(tidied(build), schema)


def _pivot_groups(pairs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, key), ``key`` naming a block of about ``settings.block`` pairs of one b; and the blocks of each b."""
    blocks = stage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / settings.block).alias("blocks")), "pivots")
    rows = attach(pairs, blocks, ["b"], "inner")
    return rows.select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a", F.lit(11)), "blocks")).alias("key")), blocks


def _candidates(pairs: DataFrame, signs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b, key) whose sizes and short sketches leave room for a link.

    ``key`` names a block of about ``settings.block`` pairs of one pivot b, so a
    pivot of a third of all rows is in many groups.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                          for c in ("sign_a", "sign_b"))
            keep = may_link(one, other, n_a, n_b, settings, 1 / 256) if batch.num_rows else []
            yield batch.select(["a", "b", "key"]).filter(pa.array(keep, pa.bool_()))

    rows, blocks = _pivot_groups(pairs, settings)
    rows = rows.join(signs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a")), "a")
    pivots = blocks.join(signs.withColumnRenamed("id", "b"), "b").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pivots = pivots.select(F.xxhash64("b", "block").alias("key"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    rows = rows.join(pivots, "key").select("a", "b", "key", "n_a", "n_b", "sign_a", "sign_b")
    return rows.mapInArrow(tidied(compare), "a long, b long, key long").distinct()


def _check(found: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Candidates (a, b) that link by the exact rule on full sets; the pivot's sets come first in each group."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, sets = None, None, []
        for batch in batches:
            a, b = [], []
            for key, doc, first, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "first", "hashes")), strict=True):
                if key != at:
                    at, sets = key, []
                own = np.frombuffer(packed, np.uint64)
                if first:
                    pivot = doc
                    sets.append(own)
                elif any(linked(own, s, settings) for s in sets):
                    a.append(doc)
                    b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = found.select(F.col("a").alias("id"), "key", F.lit(False).alias("first")).unionByName(
        found.select(F.col("b").alias("id"), "key", F.lit(True).alias("first")).distinct())
    rows = _with_sets(docs, rows, settings).repartition("key").sortWithinPartitions("key", F.col("first").desc(), "id")
    return rows.mapInArrow(tidied(check), "a long, b long").distinct()


def _mixed(members: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Rows (key, id, n, component, size, held, top) of buckets that hold more than one component, equal buckets once.

    ``top`` is the largest component of the bucket, with ``held`` of its ``size`` rows.

    A link needs sizes within a factor of 4 / 3, so a bucket is split by size
    class; each row is in its own class and the next, and two rows that could
    link meet in one of them.
    """
    step = float(np.log(100 / settings.percent))
    size_class = F.floor(F.log(F.col("n").cast("double")) / step)
    rows = attach(members, labels, ["id"]).withColumn("component", F.coalesce("component", "id"))
    rows = rows.withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    rows = rows.withColumn("key", F.xxhash64("key", "class")).select("key", "id", "n", "component")
    parts = rows.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    state = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.sum("who").alias("who"),
                                     F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    once = state.groupBy("size", "who").agg(F.min(F.struct("key", "top")).alias("first"))
    once = once.select("first.key", "size", F.col("first.top.n").alias("held"), F.col("first.top.component").alias("top"))
    return rows.join(once, "key")


def _in_slices(mixed: DataFrame, turn: int, settings: Settings) -> DataFrame:
    """Deal each bucket into slices of about ``settings.block`` rows, others at every turn; each row is in one."""
    cut = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / settings.block))
    return mixed.select(F.xxhash64("key", cut).alias("key"), "id", "n", "component")


def _in_blocks(mixed: DataFrame, settings: Settings) -> DataFrame:
    """Cut each bucket into blocks of about ``settings.block`` rows; ``key`` now names a pair of blocks, so groups are bounded.

    Where it makes fewer rows, blocks hold either the largest component of the
    bucket or the rest, and blocks of the largest are not paired with each other:
    its rows are copied once for each block of the rest.
    """
    held, rest = F.ceil(F.col("held") / settings.block), F.ceil((F.col("size") - F.col("held")) / settings.block)
    whole = F.ceil(F.col("size") / settings.block)
    apart = F.col("held") * rest + (F.col("size") - F.col("held")) * (held + rest) < F.col("size") * whole
    main = apart & (F.col("component") == F.col("top"))
    held, rest = F.when(apart, held).otherwise(F.lit(0).cast("long")), F.when(apart, rest).otherwise(whole)
    dealt = F.xxhash64("id", F.lit(7))
    rows = mixed.withColumn("block", F.when(main, F.pmod(dealt, held)).otherwise(held + F.pmod(dealt, rest)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(main, held).otherwise(F.lit(0).cast("long")), held + rest - 1)))
    name = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return rows.withColumn("key", name).select("key", "id", "n", "component")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by their first column so that no value of it is cut."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        key = rows[0].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield rows.slice(0, cut)
        kept = rows.slice(cut)
    if kept is not None and len(kept):
        yield kept


def _best(mixed: DataFrame, signs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) worth a check: for each component of a group, its member nearest to another component by the short sketch."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            key, ids, n, component = (rows[c].to_numpy() for c in ("key", "id", "n", "component"))
            sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(len(key), -1)
            score, mate = np.zeros(len(key)), np.full(len(key), -1)
            lag = 1
            while lag < len(key):
                i = np.flatnonzero(key[:-lag] == key[lag:])  # rows at this distance in one group
                if not len(i):
                    break
                i = i[component[i] != component[i + lag]]
                i = i[may_link(sign[i], sign[i + lag], n[i], n[i + lag], settings, 1 / 256)]
                near = (sign[i] == sign[i + lag]).mean(axis=-1)
                for one, other in ((i, i + lag), (i + lag, i)):
                    better = near > score[one]
                    score[one[better]], mate[one[better]] = near[better], other[better]
                lag += 1
            i = np.flatnonzero(mate >= 0)
            i = i[np.lexsort((-score[i], component[i], key[i]))]
            first = np.append(True, (key[i][1:] != key[i][:-1]) | (component[i][1:] != component[i][:-1]))[: len(i)]
            a, b = ids[i[first]], ids[mate[i[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["a", "b"])

    rows = mixed.join(signs, "id").select("key", "id", "n", "component", "sign")
    rows = rows.repartition("key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(tidied(compare), "a long, b long").distinct()


def _near(mixed: DataFrame, signs: DataFrame, settings: Settings) -> DataFrame:
    """Rows of groups for which the short sketch leaves room for a link to another component: at most one each."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            key, n, component = (rows[c].to_numpy() for c in ("key", "n", "component"))
            sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(len(key), -1)
            marked = np.zeros(len(key), bool)
            lag = 1
            while lag < len(key):
                i = np.flatnonzero(key[:-lag] == key[lag:])  # rows at this distance in one group
                if not len(i):
                    break
                i = i[component[i] != component[i + lag]]
                i = i[may_link(sign[i], sign[i + lag], n[i], n[i + lag], settings, 1 / 256)]
                marked[i] = marked[i + lag] = True
                lag += 1
            yield from rows.filter(pa.array(marked)).select(["key", "id", "component"]).to_batches()

    rows = mixed.join(signs, "id").select("key", "id", "n", "component", "sign")
    rows = rows.repartition("key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(tidied(compare), "key long, id long, component long")


def _rest(near: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Links between components inside groups.

    Only members of components that are still apart are compared, and only a
    link that joins two of them is given out: fewer links than members, though
    no linked pair stays apart.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            key, ids, root = (rows[c].to_numpy().copy() for c in ("key", "id", "component"))
            held = [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
            a, b = [], []
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for low, high in zip(starts, np.append(starts[1:], len(key)), strict=True):
                seen = np.stack([registers(h, settings) for h in held[low:high]])
                size = np.array([len(h) for h in held[low:high]])
                at = root[low:high]
                for i in range(high - low - 1):
                    apart = np.flatnonzero(at[i + 1:] != at[i]) + i + 1
                    for j in apart[may_link(seen[apart], seen[i], size[apart], size[i], settings)]:
                        if at[j] != at[i] and linked(held[low + i], held[low + j], settings):
                            a.append(ids[low + i])
                            b.append(ids[low + j])
                            at[at == at[j]] = at[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = _with_sets(docs, near, settings).select("key", "id", "component", "hashes")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(tidied(join), "a long, b long").distinct()


def _crowd(mixed: DataFrame, settings: Settings) -> tuple[int, int]:
    """Rows in buckets of several components, and those among them outside the largest component of a bucket of several blocks."""
    outside = (F.col("size") > settings.block) & (F.col("component") != F.col("top"))
    return tuple(mixed.agg(F.count(F.lit(1)), F.count(F.when(outside, 1))).first())


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    1. A sketch per document; documents with equal sets (copies) fall together by
       a grouped minimum, and only the smallest id of each goes on.
    2. Representatives that share a band meet in a bucket, of which those with the
       same members count once; each is checked with the smallest id of all its
       buckets, and links give components.
    3. Buckets that still hold several components are dealt into slices. In each,
       every component's nearest pair to another one is checked, and links join
       components; new slices follow for as long as crowded buckets shrink.
    4. What is still apart is compared inside each bucket, block by block, and the
       components are joined.

    No pair that shares a band and links is left out, and no bucket is emitted
    as pairs. Documents without words or text link with nothing and keep their
    own id; rows with a null id have a null component and are kept; rows that
    repeat an id are one document with several texts; an empty table gives no
    rows. Other columns are left out.
    """
    ship(docs.sparkSession)
    sketches = stage(_sketches(docs, settings), "sketches")
    sets = sketches.where("n > 0 AND doc_id IS NOT NULL")
    whole = stage(sets.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "bands", "sign")).alias("first")).select(
        "n", "d1", "d2", F.col("first.doc_id").alias("id"), "first.bands", "first.sign"), "classes")
    who = F.xxhash64("id", "n", "d1", "d2")
    rows = whole.select("id", "n", who.alias("who"), F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), F.bit_xor("who").alias("who"))
    crowded = buckets.where("size > 1").groupBy("size", "pivot", "who").agg(F.min("key").alias("key"))
    members = stage(rows.drop("who").join(crowded.select("key", "pivot"), "key"), "members")
    classes = whole.select("n", "d1", "d2", "id")
    if not members.isEmpty():
        if not sketches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
            docs = docs.select("doc_id", "text").distinct()
        signs = whole.select("id", "n", "sign")
        pairs = stage(members.groupBy(F.col("id").alias("a")).agg(F.min("pivot").alias("b")).where("a <> b"), "pairs")
        found = stage(_candidates(pairs, signs, settings), "candidates")
        links = stage(_check(found, docs, settings), "links")
        labels = stage(components(links), "labels")
        members, signs = members.select("key", "id", "n"), whole.select("id", "sign")
        mixed, turn, before = stage(_mixed(members, labels, settings), "mixed"), 0, None
        while (crowd := _crowd(mixed, settings))[0] and (before is None or crowd[1] and crowd[1] <= 0.9 * before):
            turn, before = turn + 1, crowd[1]
            pairs = stage(_best(_in_slices(mixed, turn, settings), signs, settings), "pairs")
            fresh = stage(_check(stage(_pivot_groups(pairs, settings)[0], "candidates"), docs, settings), "links")
            if fresh.isEmpty():
                break
            links = stage(links.unionByName(fresh), "links")
            labels = stage(components(links), "labels")
            mixed = stage(_mixed(members, labels, settings), "mixed")
        near = stage(_near(_in_blocks(mixed, settings), signs, settings), "near")
        if not near.isEmpty():
            links = links.unionByName(_rest(near, docs, settings))
            labels = stage(components(links), "labels")
        classes = classes.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    else:
        classes = classes.withColumn("component", F.col("id"))
    out = attach(sketches.select("doc_id", "n", "d1", "d2"), classes.select("n", "d1", "d2", "component"), ["n", "d1", "d2"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs`` with the smallest id of their component, all columns; rows with a null id stay.

    Of rows that repeat a kept id, the one whose columns sort first stays.
    """
    gone = near_duplicates(docs, settings).where(~F.col("kept")).select("doc_id")
    many = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    left = attach(docs, gone, ["doc_id"], "left_anti")
    again = stage(many, "repeated")
    if again.isEmpty():
        return left.select(*docs.columns)
    first = left.join(again, "doc_id", "left_semi").select(*docs.columns)
    first = first.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
