"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows.

A shard is a run of documents of a task, up to ``SHARD_BYTES`` of text; documents are neither shuffled nor
cut. Words that no benchmark text holds, and runs of words too short for any window, cannot be part of an
occurrence and are left out of the index. Occurrences are located by sampled suffix positions and merged
to spans of words.

The benchmark is collected in blocks of at most ``block_bytes`` of text, one pass over the documents
for each; the test sets of a pass are broadcast.

Defined cases: a null or empty text has no words; an item without words is left out; the windows of an item without
an id hit words, but it is not among the items found; items that share an id are one item; rows are judged one by one, so repeated rows and null ids need no
care; an empty benchmark hits nothing; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.llm import arrays as ar
from leaksieve.llm.fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 1 << 20
PART_BYTES = 1 << 17  # of a shard, hashed at a time
MARKS = ("__n_words", "__n_hit", "__items", "__hit_words")


@dataclass
class TestSet:
    """Distinct windows as word numbers, by length, and the items each is part of."""

    vocabulary: np.ndarray  # sorted fingerprints; word number = index + 1
    windows: list[tuple[np.ndarray, list[np.ndarray]]]
    names: list[str]
    shortest: int


def build_test_set(items: list[tuple[str | None, str]], window: int = WINDOW) -> TestSet:
    """Of items without a name the windows count, but nothing is found by name."""
    names = sorted({name for name, _ in items if name is not None})
    number = {name: i for i, name in enumerate(names)}
    data = np.frombuffer("\n".join(text for _, text in items).encode(), dtype=np.uint8)
    sizes = [len(text.encode()) for _, text in items]
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])
    offsets[-1] = len(data)
    data = ar.LOWER[data]
    begin, end, first = ar.words(data, offsets, ar.ALNUM)
    hashes = ar.fingerprints(ar.prefix_sums(data), begin, end)
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    owners: dict[tuple[int, ...], set[int]] = {}
    for k, (name, _) in enumerate(items):
        own = (ids[first[k] : first[k + 1]] + 1).tolist()
        width = min(window, len(own))
        for i in range(len(own) - width + 1 if own else 0):
            owners.setdefault(tuple(own[i : i + width]), set()).update([number[name]] if name is not None else [])
    lengths = sorted({len(w) for w in owners})
    windows = []
    for n in lengths:
        chosen = [w for w in owners if len(w) == n]
        windows.append((np.array(chosen, dtype=np.int64), [np.array(sorted(owners[w]), dtype=np.int64) for w in chosen]))
    return TestSet(vocabulary, windows, names, min(lengths, default=0))


def _word_numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64)
    sieve = np.zeros(1 << 16, dtype=bool)
    sieve[(vocabulary & ar.U64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(hashes & ar.U64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    numbers = np.zeros(len(hashes), dtype=np.int64)
    numbers[maybe] = np.where(vocabulary[at] == hashes[maybe], at + 1, 0)
    return numbers


def _numbered(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
    """Begins and ends of the words of a shard's rows, the first word of each row, and the words' numbers."""
    begin, end, first = ar.words(data, offsets, ar.ALNUM)
    numbers = []
    for low, high in ar.chunks(offsets, PART_BYTES):
        own, at = slice(first[low], first[high]), offsets[low]
        sums = ar.prefix_sums(data[at : offsets[high]])
        numbers.append(_word_numbers(ar.fingerprints(sums, begin[own] - at, end[own] - at), vocabulary))
    return begin, end, first, np.concatenate(numbers)


def search_shard(numbers: np.ndarray, first: np.ndarray, tests: TestSet) -> tuple[np.ndarray, list[set[int]]]:
    """Which words of a shard are hit, and the items found in each of its rows (``first``: rows' first words)."""
    rows = len(first) - 1
    covered, items = np.zeros(len(numbers) + 1, dtype=np.int64), [set() for _ in range(rows)]
    # runs of known words inside one row
    row_of = np.repeat(np.arange(rows), np.diff(first))
    known = np.flatnonzero(numbers)
    if not len(known):
        return covered[:-1] > 0, items
    fresh = np.ones(len(known), dtype=bool)
    fresh[1:] = (np.diff(known) != 1) | (row_of[known[1:]] != row_of[known[:-1]])
    run = np.cumsum(fresh) - 1
    long = np.bincount(run)[run] >= tests.shortest
    known, fresh = known[long], fresh[long]
    if not len(known):
        return covered[:-1] > 0, items
    # one separator before each run, one at the end
    at = np.arange(len(known)) + np.cumsum(fresh)
    text = np.zeros(len(known) + int(fresh.sum()) + 1, dtype=np.int64)
    text[at] = numbers[known]
    word_at = np.zeros(len(text), dtype=np.int64)
    word_at[at] = known
    index = FMIndex(text)
    for patterns, owners in tests.windows:
        low, high = index.search(patterns)
        counts = high - low
        if not counts.sum():
            continue
        which = np.repeat(np.arange(len(patterns)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = word_at[index.locate(low[which] + offset)]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + patterns.shape[1], -1)
        pairs = np.unique(row_of[begin] * len(patterns) + which)
        for pair in pairs.tolist():
            items[pair // len(patterns)].update(owners[pair % len(patterns)].tolist())
    return np.cumsum(covered[:-1]) > 0, items


def _cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """A text without its hit words and what stands between neighbours that are both hit."""
    keep = np.ones(len(data), dtype=bool)
    marked = np.flatnonzero(hit)
    starts = marked[np.concatenate([[True], np.diff(marked) != 1])]
    stops = marked[np.concatenate([np.diff(marked) != 1, [True]])]
    for a, b in zip(begin[starts].tolist(), end[stops].tolist()):
        keep[a:b] = False
    return data[keep].tobytes()


def mark_hits(docs: DataFrame, benchmark: DataFrame, cut: bool = False, block_bytes: int = 32 << 20) -> DataFrame:
    """Add ``MARKS``: the number of words, of hit words, the items found and a bitmap of the hit words.

    With ``cut`` the text loses its hit spans in the last pass.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null")
    items = items.select(F.col("item_id").cast("string").alias("name"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    marked = docs.drop(*[c for c in docs.columns if c in MARKS])
    for block in range(blocks):
        # an item of many rows may fall into several blocks: its windows are still those of its rows
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)  # without a name the hash of the text
        tests = spark.sparkContext.broadcast(build_test_set([(r.name, r.text) for r in part.toLocalIterator()]))
        marked = _pass(marked, tests, cut and block == blocks - 1)
    return marked


def _pass(docs: DataFrame, tests, cut: bool) -> DataFrame:
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.BinaryType())
    kept = [f for f in docs.schema.fields if f.name not in MARKS]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(MARKS, kinds))])
    plain = [f.name for f in kept]
    at_text = plain.index("text")
    again = MARKS[0] in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tests.value
        for batch in batches:
            text = batch.column(at_text)
            data, offsets = ar.text_bytes(text)
            n_words, n_hit, items, hits, texts = [], [], [], [], []
            old_items = batch.column(len(plain) + 2).to_pylist() if again else None
            old_hits = batch.column(len(plain) + 3).to_pylist() if again else None
            for low, high in ar.chunks(offsets, SHARD_BYTES):
                raw = data[offsets[low] : offsets[high]]
                at = offsets[low : high + 1] - offsets[low]
                begin, end, first, numbers = _numbered(ar.lowered(raw), at, known.vocabulary)
                hit, found = search_shard(numbers, first, known)
                if again:
                    for k in range(high - low):
                        bits = np.unpackbits(np.frombuffer(old_hits[low + k], dtype=np.uint8), count=first[k + 1] - first[k])
                        hit[first[k] : first[k + 1]] |= bits.astype(bool)
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(np.diff(first))
                n_hit.append(sums[first[1:]] - sums[first[:-1]])
                for k in range(high - low):
                    names = {known.names[i] for i in found[k]}
                    if again:
                        names.update(old_items[low + k])
                    items.append(sorted(names))
                    own = slice(first[k], first[k + 1])
                    hits.append(np.packbits(hit[own]).tobytes())
                    if cut:
                        if n_hit[-1][k]:
                            a, b = at[k], at[k + 1]
                            texts.append(_cut(raw[a:b], begin[own] - a, end[own] - a, hit[own]).decode())
                        else:
                            texts.append(text[low + k].as_py())
            columns = [batch.column(i) for i in range(len(plain))]
            if cut:
                columns[at_text] = pa.array(texts, type=text.type)
            empty = [np.zeros(0, np.int64)]
            columns += [
                pa.array(np.concatenate(n_words or empty), type=pa.int64()),
                pa.array(np.concatenate(n_hit or empty), type=pa.int64()),
                pa.array(items, type=pa.list_(pa.string())),
                pa.array(hits, type=pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*[docs[f"`{c}`"] for c in [*plain, *(MARKS if again else ())]]).mapInArrow(ar.tidy(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``; items sorted as strings."""
    marked = mark_hits(docs.select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


def remove_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, in the columns of ``docs``.

    Documents that were nothing but passages go; a column ``n_chars`` follows the new text.
    """
    cut = mark_hits(docs, benchmark, cut=True).where("__n_hit < __n_words or __n_words = 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh = F.char_length("text").cast(kind)
        cut = cut.withColumn("n_chars", F.when(F.col("__n_hit") > 0, fresh).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)
