"""Removal of long repeats: every byte of a ``WIDTH``-byte string that also starts elsewhere.

The suffixes that matter are reduced without loss. Each window of ``WIDTH`` bytes is led by one of its own
positions, the one whose ``GRAM`` bytes have the smallest hash; equal windows are led from the same place,
so only suffixes at leading positions are compared, about one in fifty. They are range-partitioned by
fingerprints of the leading bytes, which split evenly, sorted in their buckets, and neighbours compared:
equal suffixes never lie on two sides of a boundary.

A leading position stands for a stretch of window starts. If all that its windows can see (the outer piece)
stands elsewhere, they are all repeats; if what they share (the inner piece) does not, none is; else the
stretch is cut into cells of ``CELL`` starts, and those in the end into single windows, and compared again. Only
edges of repeats come that far.

Defined cases: a null text is empty; texts shorter than ``WIDTH`` have nothing to remove; repeated rows repeat
each other; ids may be null or repeat; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm import arrays as ar
from leaksieve.llm.exchange import COVERED, COVERED_OPEN, OPEN, compare, store_buckets
from leaksieve.session import materialise

WIDTH = 200
GRAM = 96
REACH = WIDTH - GRAM  # window starts before a leading position that it can lead
CELL = 8
CHUNK_BYTES = 1 << 19


def _keys(sums, low, high, start, stop):
    """Fingerprints of the inner and outer pieces of window starts ``[low, high]`` in texts ``[start, stop)``.

    Where a text ends inside the outer piece, how much is missing on each side is part of the fingerprint.
    """
    inner = ar.fingerprints(sums, high, low + WIDTH)
    left, right = np.maximum(low, start), np.minimum(high + WIDTH, stop)
    missing = ((left - low) * 512 + (high + WIDTH - right)).astype(np.uint64)
    outer = ar.mix(ar.fingerprints(sums, left, right) ^ ar.mix(missing + ar.U64(1)))
    return inner, outer


def _tags(high, first, last):
    """Window starts ``[first, last]`` of the cell that ends with ``high``, all relative to the text."""
    return (high << 16) | ((high - first) << 8) | (high - last)


def _untag(tags):
    high = tags >> 16
    return high, high - ((tags >> 8) & 255), high - (tags & 255)


def leading(data: np.ndarray, sums: np.ndarray, offsets: np.ndarray):
    """Leading positions of all windows that lie in one text, with the first and last window of each."""
    n = len(data)
    if n < WIDTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    at = np.arange(n - GRAM + 1, dtype=np.uint64)
    inverse = ar._powers("down", n + 1)[: len(at)]
    low = (sums[GRAM:] - sums[: len(at)]) * inverse * ar.U64(0xD6E8FEB86659FD93)
    bits = ar.U64(max(1, int(n).bit_length()))
    low = ((low >> bits) << bits) | at  # smallest hash, then the leftmost
    least, width = low, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    leader = (least & ((ar.U64(1) << bits) - ar.U64(1))).astype(np.int64)  # one for each window start
    edge = np.zeros(n + 1, np.int64)
    sizes = np.diff(offsets)
    long = sizes >= WIDTH
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - WIDTH + 1, -1)
    inside = np.cumsum(edge)[: len(leader)] > 0
    fresh = inside.copy()
    same = (leader[1:] == leader[:-1]) & inside[:-1]
    fresh[1:] &= ~same
    begins = np.flatnonzero(fresh)
    fresh_end = inside.copy()
    fresh_end[:-1] &= ~((leader[1:] == leader[:-1]) & inside[1:])
    return leader[begins], begins, np.flatnonzero(fresh_end)


def _positions(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The entries of all leading positions in a batch of ``id, text``."""
    ids = batch.column(0).to_pylist()
    data, offsets = ar.text_bytes(batch.column(1))
    for low, high in ar.chunks(offsets, CHUNK_BYTES):
        raw = data[offsets[low] : offsets[high]]
        at = offsets[low : high + 1] - offsets[low]
        sums = ar.prefix_sums(raw)
        leader, first, last = leading(raw, sums, at)
        row = np.searchsorted(at, first, side="right") - 1
        start, stop = at[row], at[row + 1]
        inner, outer = _keys(sums, leader - REACH, leader, start, stop)
        tags = _tags(leader - start, first - start, last - start)
        cuts = np.searchsorted(row, np.arange(high - low + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield ids[low + k], inner[a:b], outer[a:b], tags[a:b]


def _cells(cell: int):
    """The entries of open stretches, cut into cells of ``cell`` starts, from a batch of ``id, text, open``."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        data, offsets = ar.text_bytes(batch.column(1))
        for k, (one, tags) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
            raw = data[offsets[k] : offsets[k + 1]]
            sums = ar.prefix_sums(raw)
            high, first, last = _untag(np.asarray(tags.values, dtype=np.int64))
            from_, to = (high - last) // cell, (high - first) // cell
            counts = to - from_ + 1
            which = np.repeat(np.arange(len(high)), counts)
            step = from_[which] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            upper = high[which] - cell * step
            lower = upper - cell + 1
            inner, outer = _keys(sums, lower, upper, 0, len(raw))
            # two leading positions may share a cell of one text: their windows differ in their step
            inner, outer = (ar.mix(x + step.astype(np.uint64) * ar.U64(0x9E3779B97F4A7C15)) for x in (inner, outer))
            yield one, inner, outer, _tags(upper, np.maximum(first[which], lower), np.minimum(last[which], upper))

    return read


def _finer(texts: DataFrame, told: DataFrame, cell: int) -> DataFrame:
    """The open stretches of ``told``, compared cell by cell."""
    still = told.where(F.col("code").isin(OPEN, COVERED_OPEN)).groupBy("id").agg(F.collect_list("tag").alias("open"))
    return compare(texts.join(still, "id").select("id", "text", "open"), _cells(cell))


def _store_texts(docs: DataFrame) -> DataFrame:
    """The distinct texts that are long enough, stored in buckets by id."""
    whole = docs.where(F.octet_length("text") >= WIDTH).groupBy("id").agg(F.first("text").alias("text"))
    return store_buckets(whole, "id", "texts")


def find_repeats(texts: DataFrame) -> DataFrame:
    """``id, first, stop`` in bytes: covered stretches of distinct texts ``id, text``; they may overlap."""
    rounds = [materialise(compare(texts.select("id", "text"), _positions), "told")]
    for cell in (CELL, 1):
        rounds.append(materialise(_finer(texts, rounds[-1], cell), "told"))
    told = rounds[0]
    for more in rounds[1:]:
        told = told.unionByName(more)
    covered = told.where(F.col("code").isin(COVERED, COVERED_OPEN))
    high = F.shiftright("tag", 16)
    first = high - F.shiftright("tag", 8).bitwiseAND(F.lit(255))
    return covered.select("id", first.alias("first"), (high - F.col("tag").bitwiseAND(F.lit(255)) + WIDTH).alias("stop"))


def _cut(texts: DataFrame, spans: DataFrame, with_kept: bool) -> DataFrame:
    lists = spans.groupBy("id").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    schema = "id bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ar.text_bytes(batch.column(1))
            removed, runs, digests, rest = [], [], [], []
            for k, spans in enumerate(batch.column(2)):
                raw = data[offsets[k] : offsets[k + 1]]
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, np.asarray(spans.values.field(0)), 1)
                np.add.at(edge, np.asarray(spans.values.field(1)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(rest, pa.binary())],
                names=["id", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return texts.join(lists, "id").select("id", "text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with the remaining bytes as ``kept`` if asked for."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("id"), text.alias("text"))
    texts = _store_texts(rows)
    cut = materialise(_cut(texts, find_repeats(texts), with_kept), "cut")
    copies = rows.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    # a text that is there twice is covered whole
    whole = materialise(copies.where("copies > 1").select("id", F.lit(True).alias("whole")), "whole")
    size = F.octet_length("text").cast("long")
    names = ["doc_id", "id", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_sha256")]
    joined = rows.select(*names, *([F.col("text").cast("binary").alias("all")] if with_kept else []))
    joined = joined.join(whole, "id", "left").join(cut.select("id", F.lit(True).alias("some"), *cut.columns[1:]), "id", "left")
    every = F.coalesce("whole", F.lit(False)) & (F.col("n_bytes") >= WIDTH)

    def value(gone, some, none):
        return F.when(every, gone).when(F.col("some"), some).otherwise(none)

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = [
        "doc_id",
        "n_bytes",
        value(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        value(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        value(nothing, F.col("kept_sha256"), F.col("all_sha256")).alias("kept_sha256"),
    ]
    if with_kept:
        columns.append(value(F.lit(b""), F.col("kept"), F.col("all")).alias("kept"))
    return joined.select(*columns)
