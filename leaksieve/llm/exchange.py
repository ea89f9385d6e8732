"""Which fingerprints occur more than once in a corpus, and connected components.

Fingerprints travel packed: a task sorts a chunk of them and sends each bucket one row of arrays, so the
shuffle costs little more than the fingerprints. Within a chunk a repeated fingerprint is sent
twice at most, whatever its count, so no bucket ever grows with a hot one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.arrays import tidy
from leaksieve.session import materialise, scratch_path

CHUNK = 1 << 19  # fingerprints that a task sorts at a time
_SILENT = 0xFFFFFFFF  # place of an entry that needs no answer
_PACKED = "bucket int, found boolean, fps binary, ids binary, places binary"


def shuffle_buckets(spark: SparkSession, per_partition: int = 4) -> int:
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def store_buckets(frame: DataFrame, key: str, name: str) -> DataFrame:
    """Store a table in buckets by a key, so that later joins on it read the rows where they lie."""
    spark = frame.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = frame.write.bucketBy(shuffle_buckets(spark, 1), key).option("path", scratch_path(spark, name))
    writer.format("parquet").saveAsTable(table)
    return spark.table(table)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: which equal a neighbour, and which are the first of their kind."""
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    return ~alone, first


def _pack(fps: np.ndarray, ids: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(fps, kind="stable")
    fps, ids, places = fps[order], ids[order], places[order]
    twice, first = _runs(fps)
    once = ~twice
    leaders = np.repeat(fps[twice & first], 2)
    sent = np.concatenate([fps[once], leaders])
    sent_ids = np.concatenate([ids[once], np.zeros(len(leaders), np.int64)])
    sent_places = np.concatenate([places[once], np.full(len(leaders), _SILENT, np.uint32)])
    order = np.argsort(sent, kind="stable")
    sent, sent_ids, sent_places = sent[order], sent_ids[order], sent_places[order]
    bucket = ((sent >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [
        (b, False, sent[lo:hi].tobytes(), sent_ids[lo:hi].tobytes(), sent_places[lo:hi].tobytes())
        for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))
        if hi > lo
    ]
    if twice.any():  # already known here: only passed on, by any bucket
        rows.append((int(sent[0] % np.uint64(buckets)) if len(sent) else 0, True, b"", ids[twice].tobytes(), places[twice].tobytes()))
    columns = list(zip(*rows)) if rows else [[], [], [], [], []]
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "found", "fps", "ids", "places"])


def occurring_twice(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """``id, place`` of every fingerprint that also stands elsewhere.

    ``read`` makes ids and arrays of unsigned 64-bit fingerprints from a batch of ``rows``; ``place`` is a
    fingerprint's index in its array. Ids need not be unique: entries of equal ids count like any others.
    """
    buckets = shuffle_buckets(rows.sparkSession, 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, ...] = ([], [], [])
        size = 0
        for batch in batches:
            for one, own in read(batch):
                columns = own, np.full(len(own), one, np.int64), np.arange(len(own), dtype=np.uint32)
                for to, column in zip(kept, columns):
                    to.append(column)
                size += len(own)
                if size >= CHUNK:
                    yield _pack(*map(np.concatenate, kept), buckets)
                    kept, size = ([], [], []), 0
        if size:
            yield _pack(*map(np.concatenate, kept), buckets)

    def meet(table: pa.Table) -> pa.Table:
        found = np.asarray(table.column("found"))
        ids = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("ids")]
        places = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("places")]
        fps = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("fps")]
        known = np.repeat(found, [len(x) for x in ids])
        ids, places, fps = np.concatenate(ids), np.concatenate(places), np.concatenate(fps)
        open_ids, open_places = ids[~known], places[~known]
        order = np.argsort(fps, kind="stable")
        twice, _ = _runs(fps[order])
        told = order[twice & (open_places[order] != _SILENT)]
        ids = np.concatenate([ids[known], open_ids[told]])
        places = np.concatenate([places[known], open_places[told]])
        return pa.table({"id": ids, "place": places.astype(np.int64)})

    packed = rows.mapInArrow(tidy(send), _PACKED)
    return packed.groupBy("bucket").applyInArrow(meet, "id bigint, place bigint")


FILTER_BITS = 1 << 26
_FILTER_BLOCK = 1 << 20


def id_filter(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray] | None = None, bits: int = FILTER_BITS) -> np.ndarray:
    """A set of 64-bit ids as ``bits`` bits: it holds every id, and others by chance.

    ``read`` makes the ids of a batch of ``rows``; without it they are its only column.
    Of one size, 8 MB, whatever the number of ids, so that it may go to every task: rows that cannot be wanted stay where
    they are. With very many ids it lets all pass, and what comes after it decides alone. Put together by the executors.
    """
    block = min(_FILTER_BLOCK, bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = read(batch) if read else batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            own = np.unique((own.view(np.uint64) & np.uint64(bits - 1)).astype(np.uint32))
            edges = np.searchsorted(own, np.arange(0, bits + 1, block))
            some = np.flatnonzero(np.diff(edges)).tolist()
            inside = (own % block).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([inside[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())],
                names=["block", "cells"],
            )

    def add(table: pa.Table) -> pa.Table:
        held = np.zeros(block, dtype=bool)
        for own in table.column("cells"):
            held[np.frombuffer(own.as_buffer(), np.uint32)] = True
        return pa.table({"block": table.column("block")[:1], "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    parts = rows.mapInArrow(tidy(cells), "block int, cells binary")
    for row in parts.groupBy("block").applyInArrow(add, "block int, held binary").toLocalIterator():
        out[row.block * (block // 8) : (row.block + 1) * (block // 8)] = np.frombuffer(row.held, np.uint8)
    return out


def passes(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids a filter lets pass."""
    cells = ids.view(np.uint64) & np.uint64(len(held) * 8 - 1)
    return (held[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


#: how many different outer fingerprints of one inner a chunk sends; see ``compare``
MOST_OUTER = 64
OUTSIDE, COVERED, OPEN, COVERED_OPEN = 0, 1, 2, 3
_PAIRS = "bucket int, done boolean, inner binary, outer binary, ids binary, tags binary, silent binary"


def _pack_pairs(inner, outer, ids, tags, buckets: int) -> pa.RecordBatch:
    order = np.lexsort((outer, inner))
    inner, outer, ids, tags = inner[order], outer[order], ids[order], tags[order]
    new_inner = np.ones(len(inner), dtype=bool)
    new_inner[1:] = inner[1:] != inner[:-1]
    first = new_inner.copy()
    first[1:] |= outer[1:] != outer[:-1]
    group = np.cumsum(first) - 1
    sizes = np.bincount(group)
    leaders = np.flatnonzero(first)
    # different outers of one inner: beyond MOST_OUTER they stay open without asking
    inner_of = (np.cumsum(new_inner) - 1)[leaders]
    rank = np.arange(len(leaders)) - np.searchsorted(inner_of, inner_of)
    many = np.bincount(inner_of)[inner_of] > MOST_OUTER
    asks = ~many
    tells = many & (rank < 2)  # so that other chunks learn of several outers
    doubled = asks & (sizes > 1)
    at = np.concatenate([leaders[asks], leaders[tells], leaders[doubled]])
    silent = np.concatenate([np.zeros(asks.sum(), np.uint8), np.ones(tells.sum() + doubled.sum(), np.uint8)])
    order = np.argsort(inner[at], kind="stable")
    at, silent = at[order], silent[order]
    bucket = ((inner[at] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if hi > lo:
            own = at[lo:hi]
            rows.append((b, False, inner[own].tobytes(), outer[own].tobytes(), ids[own].tobytes(), tags[own].tobytes(), silent[lo:hi].tobytes()))
    # answers that are known here: copies of a leader, and members of an inner with many outers
    code = np.zeros(len(inner), np.uint8)
    code[~first] = COVERED
    own = np.flatnonzero(many)
    code[leaders[own]] = np.where(sizes[own] > 1, COVERED_OPEN, OPEN)
    told = np.flatnonzero(code)
    if len(told):
        where = int(inner[0] % np.uint64(buckets))
        rows.append((where, True, b"", b"", ids[told].tobytes(), tags[told].tobytes(), code[told].tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 7
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    names = ["bucket", "done", "inner", "outer", "ids", "tags", "silent"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def compare(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """``id, tag, code`` for entries with two fingerprints, an inner piece and an outer piece around it.

    ``read`` makes ids and arrays ``inner, outer, tags`` of 64-bit numbers from a batch of ``rows``. ``COVERED``:
    the outer piece stands elsewhere too. ``OPEN``: only the inner one does. ``COVERED_OPEN``: covered, and
    the one of its equals to be looked at more closely for the sake of the open ones. Others get no row.

    An inner piece may be in a third of all texts with a different outer piece each time. A chunk that holds
    more than ``MOST_OUTER`` of them calls them open on its own authority and tells others of two, so
    no bucket gathers them all. An entry that is called open though its outer piece stands elsewhere
    is decided by a later, finer comparison.
    """
    buckets = shuffle_buckets(rows.sparkSession, 1)
    kinds = (np.uint64, np.uint64, np.int64, np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            for one, inner, outer, tags in read(batch):
                for to, own in zip(kept, (inner, outer, np.full(len(inner), one, np.int64), tags)):
                    to.append(own)
                size += len(inner)
                if size >= CHUNK:
                    yield _pack_pairs(*map(np.concatenate, kept), buckets)
                    kept, size = ([], [], [], []), 0
        if size:
            yield _pack_pairs(*map(np.concatenate, kept), buckets)

    def meet(table: pa.Table) -> pa.Table:
        done = np.asarray(table.column("done"))

        def all_of(name: str, kind, chosen) -> np.ndarray:
            column = table.column(name)
            parts = [np.frombuffer(column[int(k)].as_buffer(), kind) for k in np.flatnonzero(chosen)]
            return np.concatenate(parts) if parts else np.zeros(0, kind)

        inner, outer, ids, tags = (all_of(n, k, ~done) for n, k in zip(("inner", "outer", "ids", "tags"), kinds))
        silent = all_of("silent", np.uint8, ~done)
        order = np.lexsort((silent, outer, inner))
        inner, outer, silent = inner[order], outer[order], silent[order]
        new_inner = np.ones(len(order), dtype=bool)
        new_inner[1:] = inner[1:] != inner[:-1]
        first = new_inner.copy()
        first[1:] |= outer[1:] != outer[:-1]
        group = np.cumsum(first) - 1
        run = np.cumsum(new_inner) - 1
        twice = np.bincount(group)[group] > 1 if len(group) else first
        several = np.bincount(run, weights=first)[run] > 1 if len(run) else first
        code = np.where(twice, COVERED, OUTSIDE).astype(np.uint8)
        code[several & first] = np.where(twice[several & first], COVERED_OPEN, OPEN)
        told = (code > 0) & (silent == 0)
        return pa.table(
            {
                "id": np.concatenate([ids[order][told], all_of("ids", np.int64, done)]),
                "tag": np.concatenate([tags[order][told], all_of("tags", np.int64, done)]),
                "code": np.concatenate([code[told], all_of("silent", np.uint8, done)]).astype(np.int32),
            }
        )

    packed = rows.mapInArrow(tidy(send), _PAIRS)
    return packed.groupBy("bucket").applyInArrow(meet, "id bigint, tag bigint, code int")


def _roots(parents: DataFrame) -> DataFrame:
    """``node, root``: where the parents of a forest (``node, root``) end; a root is its own parent. Depths halve each time."""
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = materialise(parents.join(above, "root").select("node", "root", "next"), "roots")
        parents = step.select("node", F.col("next").alias("root"))
        if step.where("next <> root").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node of ``edges (a, b)`` is connected with.

    Every round hooks nodes to their smallest neighbour, or to their largest if that hooks more of them, and contracts
    the trees to their roots. Of two neighbours one hooks in either case, so a round leaves at most half of the nodes
    that have neighbours, whatever their order. Rounds are stored; labels never pass through the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    labels = None
    while True:
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.max("b").alias("high"))
        near = materialise(near, "near")
        down, up = near.agg(F.count_if(F.col("low") < F.col("node")), F.count_if(F.col("high") > F.col("node"))).first()
        if not down:
            break
        hook = F.least("node", "low") if down >= up else F.greatest("node", "high")
        roots = _roots(near.select("node", hook.alias("root")))
        if labels is None:
            labels = roots
        else:
            further = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = materialise(labels, "labels")
        one = roots.select(F.col("node").alias("a"), F.col("root").alias("one"))
        other = roots.select(F.col("node").alias("b"), F.col("root").alias("other"))
        both = both.join(one, "a").join(other, "b").where("one <> other")
        both = materialise(both.select(F.col("one").alias("a"), F.col("other").alias("b")).distinct(), "edges")
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = materialise(labels.groupBy("root").agg(F.min("node").alias("component")), "least")
    return materialise(labels.join(least, "root").select("node", "component"), "components")
