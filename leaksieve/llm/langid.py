"""Language identification by cross-parsing against suffix automata.

For each language, a suffix automaton holds every substring of a sample of its labelled text. A text is
parsed greedily into the longest phrases an automaton knows. A phrase costs as many bits as it takes to point into
the sample, or at least to name a character; the language in which the text costs least wins. So samples may
differ in length, and where they do not, the fewest phrases win.

A text is parsed whole, in blocks of ``BLOCK`` characters that start at a new phrase for every language
alike: many blocks then advance together, one character a step. All automata lie in one table of displaced rows, whose size
follows their transitions, not their alphabets.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text when no
language could be learned; ties go to the smaller language name; every language with a labelled letter is learned
from what it has, unless ``least_chars`` asks for more; extra columns are carried along except those of the result,
which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.llm.arrays import held, tidy
from leaksieve.session import materialise

BLOCK = 256
LANES = 8192
UNKNOWN = "und"


@dataclass(frozen=True)
class TrainOptions:
    """Bounds of what the automata are built from."""

    #: rows of a language that are drawn first, by the smallest hashes; more follow until ``chars`` are reached
    rows: int = 64
    #: characters of a language's sample
    chars: int = 20_000
    #: characters of all samples together: with many languages each gets its share
    total_chars: int = 1_000_000
    #: languages with less are not learned
    least_chars: int = 1


@dataclass(frozen=True)
class LanguageSamples:
    """Normalised text of each language."""

    texts: dict[str, str]


def normalise(text: str) -> str:
    """Lower case; runs of what is no letter become one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def draw_samples(labelled: DataFrame, keys: list[str], options: TrainOptions = TrainOptions()) -> LanguageSamples:
    """Bounded samples from rows with ``text`` and ``lang``.

    Rows are chosen by the smallest hashes. What can be among them follows from a language's number of rows, so that few rows
    are ranked, whatever share of the table a language has. Only as much text is read and gathered as the samples hold. A
    language whose rows are short draws four times as many until its sample is full or its rows are used up.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("_draw", F.shiftrightunsigned(F.xxhash64(*keys, "text"), 1))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    most = min(options.chars, max(1, options.total_chars // max(1, len(counts))))
    texts: dict[str, str] = {}
    left, wanted = dict(counts), options.rows
    order = Window.partitionBy("lang").orderBy("_draw")
    while left:
        # four times the share that would do on average
        limits = [(k, (1 << 63) - 1 if 4 * wanted >= n else int(4 * wanted / n * 2**63)) for k, n in left.items()]
        limit = spark.createDataFrame(limits, "lang string, _limit bigint")
        some = rows.join(F.broadcast(limit), "lang").where(F.col("_draw") <= F.col("_limit"))  # a row for each language
        # without what is no letter, so that little is gathered of texts that hold few
        letters = F.regexp_replace("text", r"\P{L}+", " ")
        cut = some.select("lang", "_draw", F.substring(letters, 1, most).alias("_letters")).dropDuplicates(["lang", "_draw"])
        sized = cut.select("lang", "_draw", F.char_length("_letters").alias("_size")).withColumn("_at", F.row_number().over(order))
        sized = sized.withColumn("_before", F.sum("_size").over(order) - F.col("_size"))
        # stored, so that its size is known and only small tables are broadcast
        chosen = materialise(sized.where(F.col("_before") < most).select("lang", "_draw", "_before"), "chosen")
        picked = cut.join(chosen, ["lang", "_draw"]).select("lang", "_draw", F.expr(f"substring(_letters, 1, cast({most} - _before as int))").alias("text"))
        own: dict[str, str] = {}
        for row in sorted(picked.collect(), key=lambda r: (r.lang, r._draw)):
            own[row.lang] = f"{own.get(row.lang, '')} {normalise(row.text)}"[: most + 1]
        texts |= own
        full = {k for k, v in own.items() if len(v) >= most}
        left = {k: n for k, n in left.items() if k not in full and 4 * wanted < n}
        wanted *= 4
    return LanguageSamples({k: v for k, v in texts.items() if len(v.strip()) >= options.least_chars})


def sample_texts(labelled: DataFrame, keys: list[str], options: TrainOptions = TrainOptions()) -> LanguageSamples:
    """Samples cut to the length of the shortest, for callers that compare them; the queries use each whole."""
    texts = draw_samples(labelled, keys, options).texts
    size = min(map(len, texts.values()), default=0)
    return LanguageSamples({k: v[:size] for k, v in texts.items()})


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return moves


def displaced(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions as displaced rows: state ``s`` goes on by ``x`` to ``target[base[s] + x]`` if ``owner`` there is ``s``.

    Rows lie in each other's gaps, so there are little more places than transitions, however large the alphabet.
    """
    count = sum(map(len, moves))
    base = np.zeros(len(moves), dtype=np.int64)
    owner = np.full(count + 3 * width + 64, -1, dtype=np.int32)
    target = np.zeros(len(owner), dtype=np.int32)
    wide = sorted((s for s, out in enumerate(moves) if len(out) > 1), key=lambda s: -len(moves[s]))
    since: dict[int, int] = {}  # where the last row of a size found its place; narrow rows fill the gaps before it
    for state in wide:
        symbols = np.array(sorted(moves[state]), dtype=np.int64)
        at, step = since.get(len(symbols), width), 64
        while True:
            if at + step + 2 * width > len(owner):
                owner = np.concatenate([owner, np.full(len(owner) // 2 + step + 2 * width, -1, np.int32)])
                target = np.concatenate([target, np.zeros(len(owner) - len(target), np.int32)])
            tries = at + np.flatnonzero(owner[at : at + step] < 0) - symbols[0]
            good = (owner[tries[:, None] + symbols] < 0).all(axis=1) if len(tries) else np.zeros(0, dtype=bool)
            if good.any():
                base[state] = tries[good.argmax()]
                since[len(symbols)] = at
                break
            at += step
            step = min(2 * step, 8192)
        owner[base[state] + symbols] = state
        target[base[state] + symbols] = [moves[state][x] for x in symbols.tolist()]
    narrow = [(s, *next(iter(out.items()))) for s, out in enumerate(moves) if len(out) == 1]
    free = width + np.flatnonzero(owner[width:] < 0)
    if len(free) < len(narrow):
        more = len(narrow) - len(free)
        free = np.concatenate([free, np.arange(len(owner), len(owner) + more)])
        owner = np.concatenate([owner, np.full(more, -1, np.int32)])
        target = np.concatenate([target, np.zeros(more, np.int32)])
    if narrow:
        states, symbols, targets = (np.array(c, dtype=np.int64) for c in zip(*narrow))
        at = free[: len(narrow)]
        owner[at], target[at], base[states] = states, targets, at - symbols
    used = int(np.flatnonzero(owner >= 0).max(initial=0)) + 1
    pad = np.full(width, -1, np.int32)  # any symbol of the last row stays inside
    return base, np.concatenate([owner[:used], pad]), np.concatenate([target[:used], np.zeros(width, np.int32)])


class CrossParser:
    """All automata in one table of displaced rows; state 0 is dead."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        longest = max(map(len, samples.values()))
        alphabet = sorted(set("".join(samples.values())) - {" "})
        #: symbol 0 is a character no sample holds, 1 is a blank
        self.width = len(alphabet) + 2
        bits = {k: math.log2(max(len(v), self.width)) for k, v in samples.items()}
        #: what a phrase of each language costs, as a share of one of the longest sample
        self.costs = np.array([bits[k] / math.log2(max(longest, self.width)) for k in self.names])
        number = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": 1}
        self.codes = np.ones(0x110000, dtype=np.int32)  # what is no letter is a blank
        for point in range(0x110000):
            letter = chr(point)
            if letter.isalpha():
                self.codes[point] = number.get(letter.lower(), 0)
        bases, owners, targets, starts = [np.zeros(1, np.int64)], [], [], []
        first = np.zeros((len(self.names), self.width), dtype=np.int32)
        row = places = 0
        for k, name in enumerate(self.names):
            moves = suffix_automaton([number[c] for c in samples[name]])
            base, owner, target = displaced(moves, self.width)
            starts.append(row + 1)
            bases.append(base + places)
            owners.append(np.where(owner >= 0, owner + row + 1, -1).astype(np.int32))
            targets.append((target + row + 1).astype(np.int32))
            for symbol, to in moves[0].items():
                first[k, symbol] = row + 1 + to
            row, places = row + len(moves), places + len(owner)
        self.base = np.concatenate(bases)
        self.owner, self.target = np.concatenate(owners), np.concatenate(targets)
        self.starts = np.array(starts, dtype=np.int32)
        #: the state after a character that starts a phrase; an unknown one leaves the start state
        self.first = np.where(first, first, self.starts[:, None]).astype(np.int32)

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block (rows of symbols, longest first) in each language."""
        lanes, n = len(blocks), len(self.names)
        state = np.repeat(self.starts[:, None], lanes, axis=1)
        ended = np.zeros((n, lanes), dtype=np.int32)
        steps = np.ascontiguousarray(blocks.T)
        alive = np.searchsorted(-lengths, -np.arange(1, steps.shape[0] + 1), side="right")
        for t in range(steps.shape[0]):
            k = alive[t]
            if not k:
                break
            symbols = steps[t, :k]
            now = state[:, :k]
            at = self.base[now] + symbols
            dead = self.owner[at] != now
            ended[:, :k] += dead
            state[:, :k] = np.where(dead, self.first[:, symbols], self.target[at])
        return (ended + (lengths > 0)).T

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text per language, and its length in characters."""
        counts = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        symbols = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        begin = np.cumsum(sizes) - sizes
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        start = begin[owner] + number * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
        order = np.argsort(-length, kind="stable")
        padded = np.concatenate([symbols, np.zeros(BLOCK, dtype=symbols.dtype)])
        for low in range(0, len(order), LANES):
            some = order[low : low + LANES]
            blocks = padded[start[some][:, None] + np.arange(int(length[some[0]]))]
            np.add.at(counts, owner[some], self.phrases(blocks, length[some]))
        return counts, sizes


def parser(samples: dict[str, str]) -> CrossParser:
    """One for each worker process and set of samples; only the samples travel."""
    return held(("languages", *sorted(samples.items())), lambda: CrossParser(samples))


def identify(
    docs: DataFrame, samples: LanguageSamples, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Add the language and a score: by how much the best language beats the second, from 0 to 1."""
    known = samples.texts
    added = [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in into]
    at_text = [f.name for f in kept].index(text)
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(known) if known else None
        for batch in batches:
            names, scores = [], []
            for low in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column(at_text).slice(low, 512).to_pylist()]
                if model is None:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                costs = model.parse(texts)[0] * model.costs
                best = costs.argmin(axis=1)
                ranked = np.sort(costs, axis=1)
                second = ranked[:, 1] if costs.shape[1] > 1 else ranked[:, 0]
                lead = np.where(second > 0, (second - ranked[:, 0]) / np.where(second > 0, second, 1), 0.0)
                for k, body in enumerate(texts):
                    lettered = any(map(str.isalpha, body))
                    names.append(model.names[best[k]] if lettered else UNKNOWN)
                    scores.append(float(lead[k]) if lettered else 0.0)
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*[docs[f"`{f.name}`"] for f in kept]).mapInArrow(tidy(run, model=True), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_samples(docs: DataFrame, options: TrainOptions = TrainOptions()) -> LanguageSamples:
    """From the documents that are not held out."""
    return draw_samples(docs.where(~held_out()).select("doc_id", "text", "lang"), ["doc_id"], options)


def identify_documents(docs: DataFrame, options: TrainOptions = TrainOptions()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``."""
    named = identify(docs.select("doc_id", "text"), language_samples(docs, options))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, options: TrainOptions = TrainOptions()) -> DataFrame:
    """The documents in a language, in the columns of ``docs``; ``lang`` becomes the predicted one."""
    named = identify(docs, language_samples(docs, options), into=("__lang", "__score"))
    named = named.where(F.col("__lang") != UNKNOWN)
    return named.withColumn("lang", F.col("__lang")).select(*docs.columns)
