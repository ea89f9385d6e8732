"""Line dedup by an exact set-similarity join of the lines' word sets.

1. Lines become sets of words, equal sets one row with the place of their first line.
2. Words are ordered by rarity, counted in a sketch of fixed size. Two sets can only reach the similarity if
   their prefixes, a fifth of their rarest words, meet. Sets meet at each word of their prefix.
3. At a word, an earlier set is a candidate if its size fits (length filter), if the word and what follows
   it can hold the whole overlap in both (positional filter, exact at the first word they share), and if the parity bitmaps
   of both sets differ in no more bits than their words may. Sets travel to words in packed arrays.
4. Candidates are verified on their whole word sets, which are read from the texts once, without moving these. Each set asks
   the earliest candidates of each word first. Sets for which these fail while others are left meet all sets of
   the word in blocks, where overlaps are counted by an inverted index.

A line goes if an earlier line is similar: the first of its own set, or any line of a similar set. Order is by
``doc_id``, of any type and size, null last, then by line, then by hashes of set and text.

Sets of fewer than four words are similar to their equals alone and need no prefix.

Defined cases: lines of fewer than ``least_words`` distinct words are left alone (``WHOLE``, which the queries
use, leaves none); a null or empty text has no
line that counts; rows with equal id and text are one document and share its fate; a document that
loses lines goes if no line with a word is left; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm import arrays as ar
from leaksieve.llm.exchange import id_filter, passes, shuffle_buckets, store_buckets
from leaksieve.llm.jaccard import FIVE, FOUR
from leaksieve.operators.ordered import PLACE, RANGE, laid_out
from leaksieve.session import materialise

CHUNK_BYTES = 1 << 18
BLOCK = 1 << 16
COUNTED = 1 << 19  # words that are counted at a time
PAIRS = 1 << 17  # pairs that are filtered at a time
BLOCK_SETS = 1500  # sets on each side of a block
ENTRIES = 1 << 18  # entries that a task packs at a time


@dataclass(frozen=True)
class LineOptions:
    least_words: int = 5
    #: cells of the rarity sketch, one byte each; a power of two
    cells: int = 1 << 24
    #: candidates a set asks first at each word
    first_asked: int = 2


#: lines of any length count
WHOLE = LineOptions(least_words=1)


def _by_line(line: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes in order within each line, of which the numbers ascend: one sort of packed numbers unless two hashes of a line
    look alike in the bits that line and place leave."""
    if not len(line):
        return hashes
    lines, places = int(line[-1]).bit_length(), len(line).bit_length()
    left = 64 - lines - places
    if left < 1:
        return hashes[np.lexsort((hashes, line))]
    keys = (line.astype(np.uint64) << ar.U64(left)) | (hashes >> ar.U64(64 - left))
    order = ar.stable_order(keys, lines + left)
    out, keys = hashes.take(order), keys.take(order)
    alike = np.flatnonzero(keys[1:] == keys[:-1])
    if (out[alike] != out[alike + 1]).any():
        return hashes[np.lexsort((hashes, line))]
    return out


def line_words(data: np.ndarray, offsets: np.ndarray, low: int, high: int):
    """Of rows ``[low, high)``: word hashes, the line of each, and the row and number of each line with words.

    Hashes are sorted and distinct within a line.
    """
    raw = ar.lowered(data[offsets[low] : offsets[high]])
    at = offsets[low : high + 1] - offsets[low]
    begin, end, first = ar.words(raw, at, ar.NOT_BLANK)
    hashes = ar.fingerprints(ar.prefix_sums(raw), begin, end)
    breaks = np.flatnonzero(raw == 10)
    # a line with words starts at the first word of a row or behind a break
    starts = np.unique(np.concatenate([first[:-1], np.searchsorted(begin, breaks)]))
    starts = starts[: np.searchsorted(starts, len(begin))]
    rows = np.searchsorted(first, starts, side="right") - 1
    numbers = np.searchsorted(breaks, begin[starts]) - np.searchsorted(breaks, at[rows])
    line = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(begin)))
    hashes = _by_line(line, hashes)
    distinct = np.ones(len(line), dtype=bool)
    distinct[1:] = hashes[1:] != hashes[:-1]
    distinct[starts] = True
    return hashes[distinct], line[distinct], rows, numbers


def _names(hashes: np.ndarray, line: np.ndarray, count: int) -> np.ndarray:
    """The 64-bit name of each line's set."""
    if not count:
        return hashes[:0].view(np.int64)
    starts = np.searchsorted(line, np.arange(count))
    total = np.add.reduceat(ar.mix(hashes + ar.U64(17)), starts)
    twist = np.bitwise_xor.reduceat(ar.mix(hashes + ar.U64(29)), starts)
    return ar.mix(total ^ ar.mix(twist)).view(np.int64)


def _parities(hashes: np.ndarray, line: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit parity bitmap of each line's set."""
    if not count:
        return (hashes[:0].view(np.int64),) * 2
    starts = np.searchsorted(line, np.arange(count))
    bit = ar.U64(1) << (hashes & ar.U64(63))
    upper = (hashes >> ar.U64(6)) & ar.U64(1)
    high = bit * upper
    parity = [np.bitwise_xor.reduceat(c, starts) for c in (high, bit ^ high)]
    return parity[0].view(np.int64), parity[1].view(np.int64)


def rarity_codes(docs: DataFrame, options: LineOptions = LineOptions()) -> np.ndarray:
    """For each cell of word hashes, eight times the base-2 logarithm of its count, rounded down.

    ``options.cells`` bytes whatever the corpus. Any order of words finds all pairs; this one keeps
    frequent words out of the prefixes. Cells are counted by chunk and summed by the executors.
    """
    mask = ar.U64(options.cells - 1)

    def told(cells: np.ndarray) -> pa.RecordBatch:
        cells, counts = np.unique(cells, return_counts=True)
        block = cells // BLOCK
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(cells)]]) if len(cells) else [0]
        inside = (cells % BLOCK).astype(np.uint16)
        counts = counts.astype(np.uint32)
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(block[a]) for a, _ in spans], pa.int32()),
                pa.array([inside[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            names=["block", "cells", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            data, offsets = ar.text_bytes(batch.column(0))
            for low, high in ar.chunks(offsets, CHUNK_BYTES):
                raw = ar.lowered(data[offsets[low] : offsets[high]])
                begin, end, _ = ar.words(raw, offsets[low : high + 1] - offsets[low], ar.NOT_BLANK)
                kept.append((ar.fingerprints(ar.prefix_sums(raw), begin, end) & mask).astype(np.uint32))
                size += len(begin)
                if size >= COUNTED:
                    yield told(np.concatenate(kept))
                    kept, size = [], 0
        if size:
            yield told(np.concatenate(kept))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.float64)
        for cells, counts in zip(table.column("cells"), table.column("counts")):
            total[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        codes = np.where(total > 1, np.minimum(255, 8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1], "codes": pa.array([codes.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(ar.tidy(count), "block int, cells binary, counts binary")
    codes = np.zeros(options.cells, np.uint8)
    for row in parts.groupBy("block").applyInArrow(add, "block int, codes binary").toLocalIterator():
        codes[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.codes, np.uint8)
    return codes


def _lines(docs: DataFrame, codes, options: LineOptions) -> DataFrame:
    """The word sets of the lines of ``docs (ref, text)`` that count: a row for each set of a document's lines with its first
    line, how many lines there are, size, parities and prefix."""
    mask = ar.U64(options.cells - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = ar.text_bytes(batch.column(2))
            for low, high in ar.chunks(offsets, CHUNK_BYTES):
                hashes, line, rows, numbers = line_words(data, offsets, low, high)
                names = _names(hashes, line, len(rows))
                p0, p1 = _parities(hashes, line, len(rows))
                sizes = np.bincount(line, minlength=len(rows))
                # of equal lines of a document the first
                order = np.lexsort((np.arange(len(rows)), names, rows))
                fresh = np.ones(len(rows), dtype=bool)
                fresh[1:] = (names[order][1:] != names[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                leaders = np.zeros(len(rows), dtype=bool)
                leaders[order[fresh]] = True
                alike = np.zeros(len(rows), np.int64)
                alike[order[fresh]] = np.diff(np.append(np.flatnonzero(fresh), len(rows)))
                counts = (sizes >= options.least_words) & leaders
                code = codes.value[(hashes & mask).astype(np.int64)]
                # hashes are in order within a line, and the sort keeps them so
                order = ar.stable_order((line * 256 + code).astype(np.uint64), len(rows).bit_length() + 8)
                place = np.arange(len(line)) - (np.cumsum(sizes) - sizes)[line]
                shown = (place < (sizes - -(-FOUR * sizes // FIVE) + 1)[line]) & (counts & (sizes >= FOUR))[line]
                # a word alone in its cell is in no other set, but keeps its place in the prefix
                chosen = np.flatnonzero(shown)
                tokens = hashes[order][chosen].view(np.int64)
                tokens = np.where(code[order][chosen] > 0, tokens, 0)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(line[chosen], minlength=len(rows))[counts])])
                own = low + rows[counts]
                columns = [
                    pa.array(doc[own]),
                    pa.array(ids[own]),
                    pa.array(numbers[counts].astype(np.int32)),
                    pa.array(alike[counts]),
                    pa.array(names[counts]),
                    pa.array(sizes[counts].astype(np.int32)),
                    pa.array(p0[counts]),
                    pa.array(p1[counts]),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "id", "line", "lines", "set", "n", "p0", "p1", "prefix"])

    kinds = "doc bigint, id bigint, line int, lines bigint, set bigint, n int, p0 bigint, p1 bigint, prefix array<bigint>"
    return docs.select("ref.doc", "ref.id", "text").mapInArrow(ar.tidy(run), kinds)


_KINDS = {
    "word": np.uint32, "set": np.int64, "p0": np.uint64, "p1": np.uint64,
    "doc": np.int64, "line": np.int32, "n": np.int32, "place": np.int32,
}


def _pack_entries(kept: list[list[np.ndarray]], slots: int) -> pa.RecordBatch:
    """For each slot of words one row of arrays, from parts of hashes and of the columns behind ``word``, which are emptied.

    Columns go one by one and are not copied again, so little more is held than the entries twice.
    """
    hashes = np.concatenate(kept[0])
    slot = ((hashes >> ar.U64(40)) * ar.U64(slots) >> ar.U64(24)).astype(np.int64)
    kept[0][:] = [hashes.astype(np.uint32)]
    order = np.lexsort((kept[0][0], slot))
    edges = np.searchsorted(slot[order], np.arange(slots + 1))
    del hashes, slot
    some = np.flatnonzero(np.diff(edges))
    cuts = np.append(edges[some], edges[-1])
    rows = []
    for parts in kept:
        column = np.concatenate(parts)[order]
        parts.clear()
        buffers = [None, pa.py_buffer((cuts * column.itemsize).astype(np.int32)), pa.py_buffer(column)]
        rows.append(pa.Array.from_buffers(pa.binary(), len(some), buffers))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *rows], names=["slot", *_KINDS])


def _packed_entries(sets: DataFrame, slots: int) -> DataFrame:
    """Sets at the words of their prefixes: for each slot of words one row of arrays from a chunk of sets.

    A word is the lower half of its hash, the slot its upper bits: words that look alike only add candidates.
    """
    kinds = list(_KINDS.values())[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in _KINDS]
        size = 0
        for batch in batches:
            prefix = batch.column(6)
            lengths = np.diff(prefix.offsets.to_numpy())
            hashes = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            some = hashes != 0
            row, own = row[some], [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
            for parts, column, kind in zip(kept[1:], [*(c[row] for c in own), place[some]], kinds):
                parts.append(column.astype(kind))
            kept[0].append(hashes[some])
            size += len(row)
            if size >= ENTRIES:
                yield _pack_entries(kept, slots)
                size = 0
        if size:
            yield _pack_entries(kept, slots)

    rows = sets.select("set", "p0", "p1", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "n", "prefix")
    return rows.mapInArrow(ar.tidy(run), "slot int, " + ", ".join(f"{k} binary" for k in _KINDS))


def _candidates(sets: DataFrame, most: int) -> DataFrame:
    """For each set ``x`` at each word, its ``most`` earliest candidates ``y``; ``more`` says that there are others.

    Sets are in the order of their first line (``doc, line``), then of their names. Words at which some set has more come
    with all of their sets, as rows ``member`` with the set as ``x`` and its place.
    """
    slots = shuffle_buckets(sets.sparkSession)
    names = ("x", "y", "word", "more", "doc", "line", "member")

    def run(table: pa.Table) -> pa.Table:
        columns = []
        for name, kind in _KINDS.items():
            parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
            columns.append(np.concatenate(parts))
        ordered = np.sort(columns[0])
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        keep = np.isin(columns[0], shared)
        words, sets, p0, p1, doc, line, n, place = (c[keep] for c in columns)
        # the order of first lines, and at each word the order of sizes
        order = np.lexsort((sets, line, doc))
        when = np.empty(len(order), np.int64)
        when[order] = np.arange(len(order))
        order = np.lexsort((n, words))
        words, sets, p0, p1, doc, line, when = (c[order] for c in (words, sets, p0, p1, doc, line, when))
        n, place = n[order].astype(np.int64), place[order].astype(np.int64)
        start = np.searchsorted(words, words)
        # with a larger set whose overlap this one can hold: a stretch behind it
        largest = np.minimum(FIVE * n // FOUR, ((FIVE + FOUR) * (n - place) - FOUR * n) // FOUR)
        upper = words.astype(np.uint64) << ar.U64(32)
        last = np.searchsorted(upper | n.astype(np.uint64), upper | np.maximum(largest, 0).astype(np.uint64), side="right")
        behind = np.maximum(last - np.arange(len(words)) - 1, 0)
        out: list[tuple] = []
        low = 0
        ends = np.cumsum(behind)
        while low < len(words):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            one = np.repeat(np.arange(low, high), behind[low:high])
            other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(behind[low:high]) - behind[low:high], behind[low:high])
            least = -(-FOUR * (n[one] + n[other]) // (FIVE + FOUR))
            # at the first word that both share, the rest of either must hold the whole overlap
            good = np.minimum(n[one] - place[one], n[other] - place[other]) >= least
            one, other, least = one[good], other[good], least[good]
            differ = np.bitwise_count(p0[one] ^ p0[other]).astype(np.int64) + np.bitwise_count(p1[one] ^ p1[other])
            good = differ <= n[one] + n[other] - 2 * least
            one, other = one[good], other[good]
            later = when[one] > when[other]
            out.append((np.where(later, one, other), np.where(later, other, one)))
            low = high
        x, y = (np.concatenate(c) for c in zip(*out)) if out else (start[:0], start[:0])
        order = np.lexsort((when[y], x))
        x, y = x[order], y[order]
        more = np.bincount(x, minlength=len(words))[x] > most
        asked = np.arange(len(x)) - np.searchsorted(x, x) < most
        x, y, more = x[asked], y[asked], more[asked]
        crowded = np.zeros(len(words), dtype=bool)
        crowded[start[x[more]]] = True
        word, x, y = words[x], sets[x], sets[y]
        slot = np.int64(table.column("slot")[0].as_py()) << 32
        own = crowded[start]
        none = np.zeros(own.sum(), np.int64)
        columns = [
            np.concatenate([x, sets[own]]),
            np.concatenate([y, none]),
            np.concatenate([word, words[own]]).astype(np.int64) + slot,
            np.concatenate([more, none > 0]),
            np.concatenate([np.zeros(len(x), np.int64), doc[own]]),
            np.concatenate([np.zeros(len(x), np.int32), line[own]]),
            np.concatenate([np.zeros(len(x), bool), none == 0]),
        ]
        return pa.table(dict(zip(names, columns)))

    kinds = "x bigint, y bigint, word bigint, more boolean, doc bigint, line int, member boolean"
    return _packed_entries(sets, slots).groupBy("slot").applyInArrow(run, kinds)


def _settled(unsettled: DataFrame, members: DataFrame, words: DataFrame) -> DataFrame:
    """The sets of ``unsettled (x, word)`` that are similar to any earlier set of their word.

    A word's sets are dealt to parts of about ``BLOCK_SETS``; each part of its unsettled sets meets each part of
    all its sets in a block of bounded size.
    """
    slots = shuffle_buckets(members.sparkSession)
    members = members.select("word", F.col("x").alias("set"), "doc", "line").join(unsettled.select("word").distinct(), "word")
    parts = F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("parts")
    parts = members.groupBy("word").agg(parts)
    part = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.join(parts, "word").withColumn("part", part)
    place = ["set", "doc", "line"]
    base = members.select("word", *place, F.col("part").alias("b"), every.alias("k"), F.lit(False).alias("asks"))
    asking = members.join(unsettled.select(F.col("x").alias("set"), "word"), ["set", "word"], "left_semi")
    asking = asking.select("word", *place, every.alias("b"), F.col("part").alias("k"), F.lit(True).alias("asks"))
    rows = base.unionByName(asking).join(words, "set")
    rows = rows.select(F.xxhash64("word", "b", "k").alias("block"), *place, "asks", "words")

    def meet(sets, place, asks, bags) -> list[int]:
        base = np.flatnonzero(~asks)
        if not len(base):
            return []
        sizes = np.array([len(bags[k]) for k in base])
        owner = np.repeat(np.arange(len(base)), sizes)
        tokens = np.concatenate([bags[k] for k in base])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        out = []
        for x in np.flatnonzero(asks).tolist():
            own = bags[x]
            low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            counts = high - low
            at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            both = np.bincount(owner[at], minlength=len(base))
            earlier = (place[base] < place[x]) & (sets[base] != sets[x])
            if (earlier & (FIVE * both >= FOUR * (len(own) + sizes - both))).any():
                out.append(int(sets[x]))
        return out

    def run(table: pa.Table) -> pa.Table:
        block, sets, doc, line = (table.column(c).to_numpy() for c in ("block", "set", "doc", "line"))
        asks, bags = np.asarray(table.column("asks")), table.column("words")
        # places in the order of first lines; both rows of a set may differ in it, but never in that order with others
        place = np.empty(len(sets), np.int64)
        place[np.lexsort((sets, line, doc))] = np.arange(len(sets))
        order = np.argsort(block, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
        out: list[int] = []
        for low, high in zip(cuts, cuts[1:]):
            some = order[low:high]
            own = [np.frombuffer(bags[int(k)].as_buffer(), np.uint64) for k in some]
            out += meet(sets[some], place[some], asks[some], own)
        return pa.table({"set": pa.array(out, pa.int64())})

    dealt = rows.withColumn("slot", F.pmod("block", F.lit(slots)))
    return dealt.groupBy("slot").applyInArrow(run, "set bigint").distinct()


def _line_keys(ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A 64-bit name for a line of a text."""
    return ar.mix(ids.view(np.uint64) ^ ar.mix(lines.astype(np.uint64) + ar.U64(3))).view(np.int64)


def _word_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set, words``: the whole word sets of ``wanted (id, line)``, read from the texts where they lie.

    A filter of fixed size says which lines may be wanted, so that texts never move and other lines are not taken
    apart; what it lets pass by chance does no harm.
    """

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return _line_keys(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))

    wanted = wanted.select("id", F.col("line").cast("bigint"))
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = ar.text_bytes(batch.column(1))
            for low, high in ar.chunks(offsets, CHUNK_BYTES):
                raw, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                breaks = np.flatnonzero(raw == 10)
                # a text's first line and each behind a break; breaks at the end of a text begin its last, empty line
                row = np.repeat(np.arange(high - low), np.diff(np.searchsorted(breaks, at)) + 1)
                first = np.searchsorted(row, np.arange(high - low))
                number = np.arange(len(row)) - first[row]
                begin = np.where(number == 0, at[:-1][row], 0)
                begin[number > 0] = breaks + 1
                end = np.empty(len(row), np.int64)
                end[:-1], end[-1:] = begin[1:], len(raw)
                end = np.minimum(end, at[1:][row])
                some = np.flatnonzero(passes(held.value, _line_keys(ids[low:high][row], number)) & (end > begin))
                sizes = end[some] - begin[some]
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                chosen = raw[np.arange(cuts[-1]) + np.repeat(begin[some] - cuts[:-1], sizes)]
                hashes, line, lines, _ = line_words(chosen, cuts, 0, len(some))
                names = _names(hashes, line, len(lines))
                cuts = np.searchsorted(line, np.arange(len(lines) + 1))
                words = [hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(words, pa.binary())], names=["set", "words"])

    found = docs.select("ref.id", "text").mapInArrow(ar.tidy(run), "set bigint, words binary")
    return store_buckets(found.groupBy("set").agg(F.first("words").alias("words")), "set", "words")


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The sets ``x`` of ``pairs (x, y)`` with a similar ``y``."""
    a = words.select(F.col("set").alias("x"), F.col("words").alias("xw"))
    b = words.select(F.col("set").alias("y"), F.col("words").alias("yw"))
    joined = pairs.select("x", "y").distinct().join(a, "x").join(b, "y").select("x", "xw", "yw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, xw, yw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a, b = (np.frombuffer(w.as_buffer(), np.uint64) for w in (xw, yw))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if FIVE * both >= FOUR * (len(a) + len(b) - both):
                    good.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], names=["set"])

    return joined.mapInArrow(ar.tidy(run), "set bigint").distinct()


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _with_ref(docs: DataFrame) -> DataFrame:
    """Add ``__ref``, which names a document: its place in the order of ids, the last for null, and a hash of its text.

    Integers are their own place. Others are put in order by ranges, and a range and the place in it are the number.
    """
    last = F.lit((1 << 63) - 1)
    if docs.schema["doc_id"].dataType.simpleString() in _INTEGERS:
        place = F.col("doc_id").cast("bigint")
    else:
        ids = laid_out(docs.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct(), ["__id"], "ids")
        ids = ids.select("__id", (F.shiftleft(F.col(RANGE).cast("bigint"), 33) + F.col(PLACE)).alias("__place"))
        docs = docs.join(ids, F.col("doc_id") == F.col("__id"), "left").drop("__id")
        place = F.col("__place")
    ref = F.struct(F.coalesce(place, last).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("id"))
    return docs.withColumn("__ref", ref).drop("__place")


def similar_sets(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """``set, first, matched``: word sets of ``docs (ref, text)`` of which a line goes, their first line, and whether a
    similar set has an earlier one. All lines of other sets stay."""
    codes = docs.sparkSession.sparkContext.broadcast(rarity_codes(docs, options))
    lines = _lines(docs, codes, options)
    first = F.min(F.struct("doc", "line", "id")).alias("first")
    details = [F.first(c).alias(c) for c in ("n", "p0", "p1", "prefix")]
    number = F.sum("lines").alias("lines")
    sets = materialise(lines.groupBy("set").agg(first, number, *details), "linesets")
    asked = materialise(_candidates(sets, options.first_asked), "candidates")
    pairs, members = asked.where("NOT member"), asked.where("member")
    names = asked.select(F.explode(F.when(F.col("member"), F.array("x")).otherwise(F.array("x", "y"))).alias("set")).distinct()
    words = _word_sets(docs, sets.join(names, "set").select("first.id", "first.line"))
    matched = materialise(_verified(pairs, words), "matched")
    unsettled = pairs.where("more").select("x", "word").distinct()
    unsettled = materialise(unsettled.join(matched.select(F.col("set").alias("x")), "x", "left_anti"), "unsettled")
    matched = matched.unionByName(_settled(unsettled, members, words)).distinct()
    found = sets.select("set", "first", "lines").join(matched.withColumn("matched", F.lit(True)), "set", "left")
    found = found.where("matched OR lines > 1")
    return materialise(found.select("set", "first", F.coalesce("matched", F.lit(False)).alias("matched")), "decided")


def _named_lines(docs: DataFrame, sets: DataFrame, options: LineOptions) -> DataFrame:
    """``doc, id, n_lines, line, set``: how many lines of a document count, and those of ``sets (set)``, or one row of nulls.

    A filter of fixed size says which may be of these sets.
    """
    held = docs.sparkSession.sparkContext.broadcast(id_filter(sets.select("set")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ar.text_bytes(batch.column(2))
            for low, high in ar.chunks(offsets, CHUNK_BYTES):
                hashes, line, rows, numbers = line_words(data, offsets, low, high)
                names = _names(hashes, line, len(rows))
                counts = np.bincount(line, minlength=len(rows)) >= options.least_words
                of_row = np.bincount(rows[counts], minlength=high - low)
                some = np.flatnonzero(counts & passes(held.value, names))
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rows[some], minlength=high - low))])
                keep = np.flatnonzero(of_row)
                at = pa.array(np.append(cuts[keep], cuts[-1]), pa.int32())  # documents without a line have none of these
                chosen = pa.array(low + keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(chosen),
                        batch.column(1).take(chosen),
                        pa.array(of_row[keep], pa.int64()),
                        pa.ListArray.from_arrays(at, pa.array(numbers[some].astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(names[some])),
                    ],
                    names=["doc", "id", "n_lines", "lines", "sets"],
                )

    found = docs.select("ref.doc", "ref.id", "text").mapInArrow(
        ar.tidy(run), "doc bigint, id bigint, n_lines bigint, lines array<int>, sets array<bigint>"
    )
    one = F.explode_outer(F.arrays_zip(F.col("lines").alias("line"), F.col("sets").alias("set")))
    return found.select("doc", "id", "n_lines", one.alias("one")).select("doc", "id", "n_lines", "one.line", "one.set")


def line_decisions(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """``ref, n_lines, removed``: of each document with lines that count, how many, and the numbers of those to go.

    ``docs`` come with their ``__ref``.
    """
    named = docs.select(F.col("__ref").alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    decided = similar_sets(named, options)
    lines = _named_lines(named, decided, options).join(decided, "set", "left")
    first = (F.col("first.doc") == F.col("doc")) & (F.col("first.id") == F.col("id"))
    stays = first & (F.col("first.line") == F.col("line")) & ~F.col("matched")
    gone = F.col("first").isNotNull() & ~stays
    lists = lines.groupBy("doc", "id").agg(F.max("n_lines").alias("n_lines"), F.collect_set(F.when(gone, F.col("line"))).alias("gone"))
    return lists.select(F.struct("doc", "id").alias("ref"), "n_lines", F.sort_array("gone").alias("removed"))


def line_report(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed``: one row per document, line numbers from 0."""
    docs = _with_ref(docs.select("doc_id", "text"))
    decisions = materialise(line_decisions(docs, options), "decisions")
    rows = docs.select("doc_id", F.col("__ref").alias("ref")).join(decisions, "ref", "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return rows.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"),
    )


def drop_repeated_lines(docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """The documents without the lines that go, in the columns of ``docs``; a column ``n_chars`` follows the text.

    Documents that lose lines go if no line with a word is left.
    """
    named = _with_ref(docs)
    decisions = materialise(line_decisions(named, options).where(F.size("removed") > 0), "decisions")
    decisions = decisions.select(F.col("ref").alias("__ref"), F.col("removed").alias("__gone"))
    joined = named.join(decisions, "__ref", "left")
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__gone", i))
    joined = joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    joined = joined.where(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(size))
    return joined.select(*docs.columns)
