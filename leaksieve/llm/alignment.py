"""Links between the tokens that two tokenizers make of the same text.

Both token lists cover the same bytes, so each tokenizer has an incidence matrix of its tokens with the bytes, ``A``
and ``B``. The entries of ``A · Bᵀ`` are the pairs of tokens that overlap, their values the shared bytes. Where tokens of both
end, a group ends; with the incidence of tokens and groups, ``G`` and ``H``, the entries of ``G · Hᵀ`` are the pairs that share a
group. Matrices and products are those of ``csr``.

How many documents hold a pair of ids linked is counted over the corpus. Documents are gathered in chunks of at most
``ENTRIES`` pairs (or one document): each chunk names its pairs once, so a pair moves once a chunk, not once a document. The counts
come back to the chunk by a join on the pair, and the documents are summed up where their chunk lies. A pair has
at most a row for each chunk, and the highest counts of the first tokenizer's ids, which are broadcast, at most a row for each id.

Defined cases: a text that is null or empty, or that one of the tokenizers does not give back byte by byte, has no tokens;
null and repeated keys are rows of their own; an empty table gives none; extra columns are ignored; a text of any length is
aligned as a whole, products in blocks of rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.llm.csr import CSR, members, product, product_blocks, row_work, spans, transpose
from leaksieve.session import materialise

ENTRIES = 1_500_000
BYTES = 1 << 18  # of texts that are aligned together


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


# Fixed value: the published pattern by which byte-level vocabularies part a text before merging.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_BLANK = re.compile(r"\s{1000}")  # more than tiktoken's search for words takes


class ByteLevel:
    """A tokenizer whose entries spell bytes; it gets the text behind a space.

    A file of plain merges, in the order of their ids, is run by tiktoken with these merges, which gives the same ids several
    times faster; any other file, and texts with very long blanks, by the library the file is made for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        spelled = byte_characters()
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        entries = form["model"]["vocab"]
        self.pieces = [b""] * (max([*entries.values(), *self.tokenizer.get_vocab().values()]) + 1)
        for entry, number in entries.items():
            if all(c in spelled for c in entry):
                self.pieces[number] = bytes(spelled[c] for c in entry)
        self.fast = self._merges(form, entries)

    def _merges(self, form: dict, entries: dict[str, int]):
        model, words = form["model"], form.get("pre_tokenizer") or {}
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        merged = [entries.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", ())]
        if (
            any(model.get(k) != v for k, v in plain.items())
            or form.get("normalizer")
            or (words.get("type"), words.get("add_prefix_space"), words.get("use_regex")) != ("ByteLevel", False, True)
            or merged != sorted(set(merged))
            or -1 in merged
            or len(set(self.pieces[n] for n in entries.values())) != len(entries)
            or any(len(self.pieces[n]) != 1 for n in set(entries.values()).difference(merged))
        ):
            return None
        import tiktoken

        ranks = {self.pieces[n]: n for n in entries.values()}
        return tiktoken.Encoding("merges", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._encode(texts)
        encode = self.fast.encode_ordinary
        return [self._encode([t])[0] if _LONG_BLANK.search(t) else encode(" " + t) for t in texts]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A tokenizer of pieces with byte fallback, which writes U+2581 for a space and puts one before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for number in range(self.tokenizer.get_piece_size()):
            piece = self.tokenizer.id_to_piece(number)
            raw = bytes([int(piece[3:-1], 16)]) if self.tokenizer.is_byte(number) else piece.replace("▁", " ").encode()
            self.pieces.append(raw)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1)


@dataclass
class Alignment:
    """Token lists of some texts, one after another; byte positions run on from text to text.

    ``a_at`` and ``b_at`` say where each text's tokens begin, ``cuts`` where groups end.
    """

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray

    def overlap_links(self) -> CSR:
        """Rows: tokens of the first tokenizer; columns: tokens of the second; values: shared bytes."""
        return product(spans(self.a_ends), transpose(spans(self.b_ends)))

    def groups(self) -> tuple[CSR, CSR]:
        """Incidence of either tokenizer's tokens with the groups."""
        return tuple(members(np.searchsorted(self.cuts, ends), len(self.cuts)) for ends in (self.a_ends, self.b_ends))

    def group_links(self) -> Iterator[tuple[int, CSR]]:
        """Pairs of tokens that share a group, in blocks of rows: a group without common ends has all its pairs."""
        first, second = self.groups()
        return product_blocks(first, transpose(second))

    def group_link_counts(self) -> np.ndarray:
        """The number of those pairs for each token of the first tokenizer; none is formed."""
        first, second = self.groups()
        return row_work(first, transpose(second))

    def text_ends(self) -> np.ndarray:
        """Where the texts begin and end, in bytes."""
        ends = np.concatenate([[0], self.a_ends])
        return ends[self.a_at]

    def spelled_groups(self, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids by groups.

        All ids are laid out in this order, each with the sign behind it, and cut to the length of their digits.
        """
        signs, lengths = digits
        a_until = np.searchsorted(self.a_ends, self.cuts, side="right")
        b_until = np.searchsorted(self.b_ends, self.cuts, side="right")
        a_group, b_group = np.searchsorted(self.cuts, self.a_ends), np.searchsorted(self.cuts, self.b_ends)
        b_before = np.concatenate([[0], b_until])[:-1]
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + b_before[a_group]] = self.a
        order[np.arange(len(self.b)) + a_until[b_group]] = self.b
        sign = np.full(len(order), ord(","), dtype=np.uint8)
        sign[a_until - 1 + b_before] = ord("|")
        sign[b_until - 1 + a_until] = ord(";")
        n = lengths[order]
        spelled = signs[order]
        spelled[np.arange(len(order)), n] = sign
        flat = spelled[np.arange(spelled.shape[1]) <= n[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(n + 1)])[self.a_at + self.b_at].tolist()
        return [flat[low : max(low, high - 1)] for low, high in zip(ends, ends[1:])]


class Aligner:
    def __init__(self, first: str, second: str):
        self.first, self.second = ByteLevel(first), Pieces(second)
        self.sizes = [np.array([len(p) for p in t.pieces], dtype=np.int64) for t in (self.first, self.second)]
        self.width = len(self.second.pieces)  # a pair of ids is one number: a * width + b
        most = max(len(self.first.pieces), self.width)
        self.digits = (
            np.array([list(str(n).ljust(len(str(most)) + 1).encode()) for n in range(most)], dtype=np.uint8),
            np.array([len(str(n)) for n in range(most)]),
        )

    def align(self, texts: list[str | None]) -> Alignment:
        some = [k for k, t in enumerate(texts) if t]
        lists: list[list[list[int]]] = [[[] for _ in texts], [[] for _ in texts]]
        given = [texts[k] for k in some]
        for k, a, b in zip(some, self.first.encode(given) if given else [], self.second.encode(given) if given else []):
            raw = b" " + texts[k].encode()
            if b"".join(map(self.first.pieces.__getitem__, a)) == raw == b"".join(map(self.second.pieces.__getitem__, b)):
                lists[0][k], lists[1][k] = a, b
        ids, at, ends = [], [], []
        for own, sizes in zip(lists, self.sizes):
            flat = np.fromiter(chain.from_iterable(own), dtype=np.int64, count=sum(map(len, own)))
            ids.append(flat)
            at.append(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64))
            ends.append(np.cumsum(sizes[flat]))
        ended = np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, dtype=bool)
        ended[ends[0]] = True
        return Alignment(ids[0], ids[1], at[0], at[1], ends[0], ends[1], ends[1][ended[ends[1]]])


_OPEN: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One for each worker process and pair of files."""
    if (first, second) not in _OPEN:
        _OPEN[first, second] = Aligner(first, second)
    return _OPEN[first, second]


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch by some ``BYTES``, with the number of the first."""
    low, size, own = 0, 0, []
    for value in batch.column(text).to_pylist():
        if own and size + len(value or "") > BYTES:
            yield low, own
            low, size, own = low + len(own), 0, []
        own.append(value)
        size += len(value or "")
    if own:
        yield low, own


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _links(first: str, second: str, schema: T.StructType, by_group: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, form = aligner(first, second), _arrow(schema)
        for batch in batches:
            for low, texts in _parts(batch, "text"):
                made = model.align(texts)
                blocks = made.group_links() if by_group else [(0, made.overlap_links())]
                for row, block in blocks:
                    i, j = block.row_of() + row, block.indices
                    doc = np.searchsorted(made.a_at, i, side="right") - 1
                    found = {
                        "key": batch.column("key").take(pa.array(doc + low)),
                        "a": i - made.a_at[doc],
                        "b": j - made.b_at[doc],
                        "a_id": made.a[i],
                        "b_id": made.b[j],
                    }
                    if not by_group:
                        found["bytes"] = block.values
                    yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in form], schema=form)

    return run


def _link_rows(docs: DataFrame, key: str, text: str, first: str, second: str, by_group: bool) -> DataFrame:
    fields = T._parse_datatype_string("struct<a:bigint,b:bigint,a_id:bigint,b_id:bigint" + ("" if by_group else ",bytes:bigint") + ">").fields
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType, True), *fields])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_links(first, second, schema, by_group), schema).withColumnRenamed("key", key)


def overlap_links(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, a, b, a_id, b_id, bytes``: a row for each pair of tokens that overlap, by their places in the text."""
    return _link_rows(docs, key, text, first, second, False)


def group_links(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, a, b, a_id, b_id``: a row for each pair of tokens that share a group."""
    return _link_rows(docs, key, text, first, second, True)


_CHUNK = """chunk bigint, doc array<struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_group_links:bigint,sha256:string>>,
 pairs array<struct<pair:bigint,docs:int>>, entries array<int>, steps binary, times binary"""
_REPORT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class _Chunk:
    """Documents whose pairs of ids are named once.

    ``steps`` are the documents' pairs as places among the chunk's, each as the step from the one before, ``times`` how
    often a document has each.
    """

    def __init__(self):
        self.keys: list = []
        self.docs: list[dict] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.entries: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: list, model: Aligner, made: Alignment) -> None:
        n = len(keys)
        links = made.overlap_links()
        at = links.indptr[made.a_at]
        doc = np.repeat(np.arange(n), np.diff(at))
        pair = made.a[links.row_of()] * model.width + made.b[links.indices]
        span = len(model.first.pieces) * model.width
        code = np.sort(doc * span + pair)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
        own = code[first]
        self.pairs.append(own % span)
        self.times.append(np.diff(np.append(first, len(code))))
        self.entries.append(np.bincount(own // span, minlength=n))
        self.size += len(own)
        grouped = np.concatenate([[0], np.cumsum(made.group_link_counts())])
        cuts = np.searchsorted(made.cuts, made.text_ends(), side="right")
        spelled = made.spelled_groups(model.digits)
        columns = zip(np.diff(made.a_at), np.diff(made.b_at), np.diff(cuts), np.diff(at), np.diff(grouped[made.a_at]))
        names = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
        for key, numbers, text in zip(keys, columns, spelled):
            sha = hashlib.sha256(text).hexdigest() if text else ""
            self.docs.append(dict(zip(names, map(int, numbers))) | {"sha256": sha})
            self.keys.append(key)

    def row(self, number: int, form: pa.Schema) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs)
        named, places = np.unique(pairs, return_inverse=True)
        docs = np.bincount(places, minlength=len(named))
        steps = np.diff(places, prepend=0).astype("<i4").tobytes()
        times = np.concatenate(self.times).astype("<u4").tobytes()
        zipped = pa.StructArray.from_arrays([pa.array(named), pa.array(docs, type=pa.int32())], names=["pair", "docs"])
        values = {
            "chunk": [number],
            "keys": [self.keys],
            "doc": [self.docs],
            "pairs": pa.ListArray.from_arrays(pa.array([0, len(named)], type=pa.int32()), zipped),
            "entries": [np.concatenate(self.entries).astype(np.int32)],
            "steps": [steps],
            "times": [times],
        }
        arrays = [v.cast(f.type) if isinstance(v := values[f.name], pa.Array) else pa.array(v, type=f.type) for f in form]
        return pa.RecordBatch.from_arrays(arrays, schema=form)


def _chunks(first: str, second: str, schema: T.StructType, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, form = aligner(first, second), _arrow(schema)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for low, texts in _parts(batch, "text"):
                chunk.add(keys[low : low + len(texts)], model, model.align(texts))
                if chunk.size >= most:
                    yield chunk.row(number, form)
                    number, chunk = number + 1, _Chunk()
        if chunk.docs:
            yield chunk.row(number, form)

    return run


def _summed(schema: T.StructType):
    """A function over a chunk and what came back for its pairs: twice the count, and one more for an id's highest."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        form = _arrow(schema)
        if not chunk.num_rows:
            return form.empty_table()
        row = chunk.to_pylist()[0]
        value = np.zeros(len(found), dtype=np.int64)
        value[found.column("at").to_numpy()] = found.column("value").to_numpy()
        own = value[np.cumsum(np.frombuffer(row["steps"], dtype="<i4"))]
        times = np.frombuffer(row["times"], dtype="<u4").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(row["entries"])]).astype(np.int64)
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * x)])[ends]).tolist() for x in (own & 1, own >> 1)]
        names = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
        columns = [row["keys"], *([d[n] for d in row["doc"]] for n in names), *sums, [d["sha256"] for d in row["doc"]]]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, form)], schema=form)

    return run


def alignment_report(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", most: int = ENTRIES) -> DataFrame:
    """A row for each document: tokens, groups, links, and what the corpus says of its links.

    ``n_best`` links have the highest count of their id of the first tokenizer, ``count_sum`` is the sum of the links' counts.
    """
    field = docs.schema[key]
    schema = T.StructType([*T._parse_datatype_string(f"struct<{_CHUNK}>").fields, T.StructField("keys", T.ArrayType(field.dataType, True), True)])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks(first, second, schema, most), schema), "alignment")

    width = aligner(first, second).width
    pairs = chunks.select("chunk", F.posexplode("pairs").alias("at", "p")).select("chunk", "at", F.col("p.pair").alias("pair"), F.col("p.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = counts.select("pair", F.expr(f"pair div {width}").alias("a"), "n")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each id
    counts = counts.join(F.broadcast(highest), "a").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("int")).alias("value"))
    found = pairs.join(counts, "pair").select(F.col("chunk").alias("of"), "at", "value")

    schema = T.StructType([T.StructField(key, field.dataType, True), *T._parse_datatype_string(f"struct<{_REPORT}>").fields])
    left = chunks.select("chunk", "keys", "doc", "entries", "steps", "times")
    return left.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_summed(schema), schema)
