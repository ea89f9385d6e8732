"""Best-fit packing with certified bin counts.

Texts become token pieces of at most ``length`` ids, in one pass without a shuffle. Pieces are dealt to
partitions of bounded size by a hash, each partition packs its own by best fit decreasing, and
dual-feasible functions of the lengths give a lower bound of its bin count. Partitions that meet their
bound are done. The others put the pieces of their bins that are not full into a pool, which is dealt
anew and packed again, as long as that saves bins.

Defined cases: a null or empty text is the closing id alone; repeated rows and null ids are documents of
their own; an empty table packs to nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm import arrays as ar
from leaksieve.llm.tokens import tokenizer
from leaksieve.session import materialise

PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, _row bigint"
PLACES = "_row bigint, length bigint, sequence_id bigint, offset bigint, fill bigint, gap bigint"


@dataclass(frozen=True)
class PackOptions:
    length: int = 2048
    closing: int = 0
    #: pieces that one task packs together
    per_part: int = 50_000
    #: most exchanges between partitions; each also ends when it saves nothing
    rounds: int = 3
    with_ids: bool = False


def token_pieces(docs: DataFrame, path: str, options: PackOptions = PackOptions()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: the ids of each text and the closing id, cut at ``length``."""
    closing = np.array([options.closing], dtype="<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    step = options.length * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            data, offsets = ar.text_bytes(batch.column(1))
            for low, high in ar.chunks(offsets, 1 << 20):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[low:high], offsets[low + 1 : high + 1])]
                row, piece, size, crc, ids = [], [], [], [], []
                for k, body in enumerate(words.encode(texts)):
                    body += closing
                    for number, at in enumerate(range(0, len(body), step)):
                        part = body[at : at + step]
                        row.append(low + k)
                        piece.append(number)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part if options.with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(np.array(piece, np.int64) * options.length),
                        pa.array(size, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    schema = PIECES.format(kind=kind).replace(", _row bigint", "")
    return docs.select("doc_id", "text").mapInArrow(ar.tidy(run, model=True), schema)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """The best of the dual-feasible functions tried; ``counts[x]`` pieces have length ``x``."""
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // size)
    # pieces above size - e count whole, those below e not at all
    number, weight = np.cumsum(counts), np.cumsum(counts * x)
    edge = np.arange(1, size // 2 + 1)
    large = number[-1] - number[size - edge]
    middle = weight[size - edge] - weight[edge - 1]
    best = max(best, int((large + -(-middle // size)).max()))
    # multiples of 1/(k+1) stay, other lengths round down to multiples of 1/k
    for k in range(1, 33):
        scaled = np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size)
        best = max(best, -(-int((counts * scaled).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece and the number of bins, taking pieces by falling length.

    The free rooms of open bins are one bit mask, so the tightest bin is found by a shift.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask = used = 0
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, chosen = size, used
            used += 1
        bins[at], offsets[at] = chosen, size - room
        if room > length:
            rooms[room - length].append(chosen)
            mask |= 1 << (room - length)
    return bins, offsets, used


def _pack(rows: DataFrame, count: int, salt: int, options: PackOptions) -> DataFrame:
    """Deal rows of ``_row, length`` to partitions and pack each. Sequence numbers differ between salts."""
    parts = max(1, -(-count // options.per_part))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, used = best_fit(lengths, options.length)
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=options.length + 1), options.length)
        part = (salt << 54) + (key[0].as_py() << 32)
        return pa.table(
            {
                "_row": table.column("_row"),
                "length": lengths,
                "sequence_id": part + bins,
                "offset": offsets,
                "fill": fill[bins],
                "gap": np.full(len(lengths), used - bound),
            }
        )

    dealt = rows.select("_row", "length", F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(parts)).alias("_part"))
    return dealt.groupBy("_part").applyInArrow(run, PLACES)


def _bins(places: DataFrame) -> int:
    return places.agg(F.count_if(F.col("offset") == 0)).first()[0]


def pack(pieces: DataFrame, options: PackOptions = PackOptions()) -> DataFrame:
    """``_row, sequence_id, offset`` for rows of ``_row, length``; ``_row`` is unique."""
    count = pieces.count()
    places = materialise(_pack(pieces, count, 0, options), "packed")
    settled = []
    for salt in range(1, options.rounds + 1):
        if count <= options.per_part:  # one partition has nobody to exchange with
            break
        loose = (F.col("gap") > 0) & (F.col("fill") < options.length)
        pool = places.where(loose)
        count = pool.count()
        if not count:
            break
        again = materialise(_pack(pool, count, salt, options), "packed")
        if _bins(again) >= _bins(pool):
            break
        settled.append(places.where(~loose))
        places = again
    for other in settled:
        places = places.unionByName(other)
    return places.select("_row", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, options: PackOptions = PackOptions()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, with ``ids`` if asked for."""
    pieces = token_pieces(docs, path, options).withColumn("_row", F.monotonically_increasing_id())
    pieces = materialise(pieces, "pieces")
    packed = pieces.join(pack(pieces.select("_row", "length"), options), "_row").drop("_row")
    return packed if options.with_ids else packed.drop("ids")
