"""Collapse of records that differ in formatting only, with a pair of partition-merged Bloom filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import append_table, materialize, new_table, skew_join


@dataclass(frozen=True)
class Filters:
    """Sizes of the filters: bits for each row, and the largest filter of one range of hashes, which is broadcast."""

    bits_a_row: int = 16
    range_bits: int = 1 << 28  # 32 MB; more rows make more ranges, not fuller filters


SEGMENT_BITS = 1 << 16


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of each hash, by its lower half: the upper one tells the range."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([mixed >> np.uint64(64 - bits.bit_length() + 1), (mixed ^ (mixed >> np.uint64(29))) & np.uint64(bits - 1)])


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether both bits are set."""
    return ((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1).all(0)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, (at >> np.uint64(3)).ravel(), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)).ravel())


def _hash_forms(exact: Callable[[str], str]):
    """Rows with the 128-bit hash of their canonical form; equal forms of different parts have different hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for b in batches:
            high, low = [], []
            for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist()):
                x = digest(exact(text), (1 << 40) if part is None else part & 0xFFFFFFFF)
                high.append((x >> 64) - (1 << 63))
                low.append((x & ((1 << 64) - 1)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("id"), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["part", "id", "h1", "h2"])

    return run


def _low(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("h2").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _partition_filters(bits: int):
    """One task's filters of once and repeatedly seen hashes, by segment, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            found, count = np.unique(_low(b), return_counts=True)
            at = _positions(found, bits)
            again = (count > 1) | _has(once, at)
            _set(twice, at[:, again])
            _set(once, at)
        pack = zstandard.ZstdCompressor(level=1).compress
        for s in range(0, bits // 8, SEGMENT_BITS // 8):
            o, t = once[s : s + SEGMENT_BITS // 8], twice[s : s + SEGMENT_BITS // 8]
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([8 * s // SEGMENT_BITS], pa.int32()), pa.array([pack(o.tobytes())]), pa.array([pack(t.tobytes()) if t.any() else b""])], names=["segment", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit that two tasks have set was, for all the filter knows, seen twice. Segments come one after another."""
    unpack = zstandard.ZstdDecompressor().decompress
    nothing = np.zeros(SEGMENT_BITS // 8, np.uint8)
    segment, once, twice = None, nothing, nothing

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])

    for b in batches:
        for s, o, t in zip(b.column("segment").to_pylist(), b.column("once").to_pylist(), b.column("twice").to_pylist()):
            o, t = np.frombuffer(unpack(o), np.uint8), np.frombuffer(unpack(t), np.uint8) if t else nothing
            if s == segment:
                once, twice = once | o, twice | t | (once & o)
            else:
                if segment is not None and twice.any():
                    yield done()
                segment, once, twice = s, o, t
    if segment is not None and twice.any():
        yield done()


def _marked(bits: int, filter_of):
    """Rows with whether they may be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = filter_of.value
        for b in batches:
            maybe = _has(twice, _positions(_low(b), bits))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "id", "h1", "h2")), pa.array(maybe)], names=["part", "id", "h1", "h2", "maybe"])

    return run


_HASHED = "part int, id bigint, h1 bigint, h2 bigint"


def _possible_repeats(hashed: DataFrame, bits: int) -> DataFrame:
    """``hashed`` with ``maybe`` from one pair of filters of ``bits`` bits."""
    spark = hashed.sparkSession
    filters = hashed.mapInArrow(_partition_filters(bits), "segment int, once binary, twice binary")
    merged = filters.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary").collect()  # range_bits at most
    twice = np.zeros(bits // 8, np.uint8)
    for r in merged:
        twice[r.segment * SEGMENT_BITS // 8 : (r.segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(r.twice, np.uint8)
    return hashed.mapInArrow(_marked(bits, spark.sparkContext.broadcast(twice)), _HASHED + ", maybe boolean")


def _ranges(n: int) -> list[Column]:
    """Conditions that cut the hashes into n ranges of equal width."""
    edges = [-(1 << 63) + (1 << 64) * i // n for i in range(1, n)]
    h = F.col("h1")
    return [(h >= a if a is not None else F.lit(True)) & (h < b if b is not None else F.lit(True)) for a, b in zip([None, *edges], [*edges, None])]


def assign_keepers(rows: DataFrame, exact: Callable[[str], str], repeats_only: bool = False, filters: Filters = Filters()) -> DataFrame:
    """(part, id, keep_id, n_copies) of every row of ``rows(part int, id bigint, text string)`` whose text isn't NULL.

    Rows of one part are the same if ``exact`` is equal. Every text is read once and replaced by the hash of its
    canonical form. Every task builds filters of the hashes it saw once and repeatedly; merged, they tell which rows
    may have a copy. Only those are shuffled, as hashes with ids, and grouped exactly; all others are singletons.

    The filters hold ``bits_a_row`` bits a row at any number of rows: what exceeds one filter of ``range_bits`` is cut
    into ranges of hashes, whose filters are built and used one after another. Each task has sorted its hashes then,
    so that a range reads its own pages of the written hashes only.

    ``keep_id`` is the smallest id of the group. Empty texts are equal to each other, a NULL part is a part of its
    own; an empty table gives no rows; a row repeated with its id counts as a copy. With ``repeats_only`` singletons
    are left out.
    """
    rows = rows.filter("text is not null and id is not null").select(F.col("part").cast("int"), F.col("id").cast("bigint"), F.col("text").cast("string"))
    hashed = rows.mapInArrow(_hash_forms(exact), _HASHED)
    hashed = materialize(hashed, "forms")
    n = hashed.count()
    bits = SEGMENT_BITS
    while bits < min(filters.range_bits, filters.bits_a_row * n):
        bits *= 2
    ranges = -(-filters.bits_a_row * n // bits)
    if ranges <= 1:
        split = materialize(_possible_repeats(hashed, bits), "split")
    else:
        hashed = materialize(hashed.sortWithinPartitions("h1"), "forms")
        path = new_table(hashed.sparkSession, "split")
        for inside in _ranges(ranges):
            append_table(_possible_repeats(hashed.filter(inside), bits), path)
        split = hashed.sparkSession.read.schema(_HASHED + ", maybe boolean").parquet(path)
    maybe = split.filter("maybe")
    groups = maybe.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))
    groups = materialize(groups.filter("n_copies > 1") if repeats_only else groups, "groups")
    many = skew_join(maybe, groups, ["h1", "h2"], "n_copies", n).select("part", "id", "keep_id", "n_copies")
    if repeats_only:
        return many
    return many.unionByName(split.filter("not maybe").select("part", "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n_copies")))
