"""N-gram Jaccard join: documents whose shingle sets overlap by at least ``least`` of their union.

1. A set that links to another shares almost all its shingles with it, so of its smallest fingerprints more
   than a known number occur elsewhere. Only documents that pass go on; most texts end here, where they lie.
2. Sets that share a smallest hash are stored in prefix trees, a few central ones at a time, and the others walk them: those
   that link to a common one, their pivot, become its cluster.
3. Exact search for the links that are left: shingles are ordered by rarity over all sets, a set's rarest
   shingles are its prefix, and two sets can only link if their prefixes meet. Pairs of clusters that meet and
   are not yet connected are compared by a prefix tree: the larger cluster's sets are stored in a trie in a
   global order, each set of the smaller one walks it once with running overlaps, and subtrees that
   cannot reach the needed overlap are pruned.

Links are exact; copies and clusters stand for their members, so no pairs within a group are listed.

Defined cases: a null, empty or blank text has the empty set, which links with nothing; fewer than five words
are one shingle; equal sets link; a null id never is the smallest id of a component unless all are null;
repeated rows are documents of their own; extra columns are ignored or carried, as stated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm import arrays as ar
from leaksieve.llm.exchange import components, id_filter, occurring_twice, passes, shuffle_buckets, store_buckets
from leaksieve.session import materialise

WORDS = 5
CHUNK_BYTES = 1 << 19
OUT_ROWS = 1000  # rows of a batch that holds whole sets
# 100 * intersection >= 80 * union, in whole numbers: FIVE * intersection >= FOUR * union
FIVE, FOUR = 5, 4
ROUNDS = 3  # hashes by which clusters are gathered
GROUP = 2000  # sets that one task gathers into clusters at a time
PIVOTS = 4  # sets of a trie that others walk to become members
TRIES = 2  # such tries before what is left goes to the exact search
CELLS = 1 << 21  # of the sketch that orders shingles by rarity


def needed(n: int, m: int) -> int:
    """The smallest overlap that links sets of these sizes: 5 i >= 4 (n + m - i)."""
    return -(-FOUR * (n + m) // (FIVE + FOUR))


def prefix_size(n: int) -> int:
    """Of the ordered shingles of a set, so many hold one of any set it links to."""
    return n - -(-FOUR * n // FIVE) + 1


def sampled_size(n: int) -> tuple[int, int]:
    """How many of its smallest shingles a set shows, and how many of them any linked set must show too.

    With ``e`` extra shingles beyond the longest stretch without a common one, sets of both sizes show at least
    ``1 + min(e)`` common ones; a partner has at least 4/5 of the size.
    """
    extra = n // 12
    smallest = -(-FOUR * n // FIVE)
    return min(n, prefix_size(n) + extra), 1 + smallest // 12


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row."""
    for low, high in ar.chunks(offsets, CHUNK_BYTES):
        raw = ar.LOWER[data[offsets[low] : offsets[high]]]
        begin, end, first = ar.words(raw, offsets[low : high + 1] - offsets[low], ar.NOT_BLANK)
        hashes = ar.fingerprints(ar.prefix_sums(raw), begin, end)
        chained = ar.chain(hashes, WORDS)
        for k in range(high - low):
            a, b = first[k], first[k + 1]
            if b - a >= WORDS:
                yield np.unique(chained[a : b - WORDS + 1])
            elif b > a:
                short = ar.chain(hashes[a:b], int(b - a))
                yield ar.mix(short + ar.U64(b - a))
            else:
                yield hashes[:0]


def _shown(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The shingles that the texts of a batch of ``id, text`` show to others."""
    for one, tokens in zip(batch.column(0).to_pylist(), shingle_sets(*ar.text_bytes(batch.column(1)))):
        if len(tokens):
            yield one, tokens[: sampled_size(len(tokens))[0]]


def _required(n):
    smallest = F.ceil(F.lit(FOUR) * n / F.lit(FIVE))
    return F.floor(smallest / 12) + 1


SETS = "id bigint, n bigint, tokens binary, " + ", ".join(f"k{r} bigint" for r in range(ROUNDS))


def _full_sets(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``id, n, tokens`` of the ``chosen (id)`` texts, and the smallest of the shingles under each of ``ROUNDS`` hashes.

    A filter of fixed size says which texts may be chosen: the others are not taken apart, and none moves. What it lets
    pass by chance goes with the join.
    """
    salts = [ar.U64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF) for r in range(ROUNDS)]
    held = texts.sparkSession.sparkContext.broadcast(id_filter(chosen.select("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            some = np.sort(first)
            some = some[passes(held.value, batch.column(0).to_numpy()[some])]
            batch = batch.take(pa.array(some))
            for low in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(low, OUT_ROWS)
                sizes, tokens, keys = [], [], [[] for _ in salts]
                for own in shingle_sets(*ar.text_bytes(part.column(1))):
                    for key, salt in zip(keys, salts):
                        key.append(int(ar.mix(own ^ salt).min()) >> 1 if len(own) else 0)
                    sizes.append(len(own))
                    tokens.append(own.tobytes())
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())]
                columns += [pa.array(k, pa.int64()) for k in keys]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "tokens", *[f"k{r}" for r in range(ROUNDS)]])

    found = texts.select("id", "text").mapInArrow(ar.tidy(run), SETS)
    rest = [F.first(c).alias(c) for c in found.columns if c != "id"]
    return found.groupBy("id").agg(*rest).join(chosen, "id", "left_semi")


def _central_first(sets: list[np.ndarray]) -> list[int]:
    """Sets by how common their shingles are among them: the text that others were made from comes first."""
    sizes = np.array([len(own) for own in sets])
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.add.reduceat(counts[number], np.cumsum(sizes) - sizes) / sizes
    return np.argsort(-shared, kind="stable").tolist()


def _pivots(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Sets with the pivot that they link to: one of the most central sets that link to none before them.

    ``PIVOTS`` sets at a time are stored in a trie; all that are left walk it.
    """
    left, out = _central_first(sets), []
    for _ in range(TRIES):
        base, rest = left[:PIVOTS], left[PIVOTS:]
        if len(base) + len(rest) < 2:
            break
        own: dict[int, int] = {}
        for k, p in join_block([sets[k] for k in base], [sets[k] for k in base], every=True):
            if k < p:
                own[p] = min(k, own.get(p, k))
        out += [(base[p], base[k]) for p, k in own.items()]
        hits = join_block([sets[k] for k in base], [sets[k] for k in rest]) if rest else []
        out += [(rest[p], base[k]) for k, p in hits]
        gone = {p for _, p in hits}
        left = [k for p, k in enumerate(rest) if p not in gone]
    return out


def _gather(sets: DataFrame, key: str) -> DataFrame:
    """``id, pivot``: sets with an equal key that link to a pivot among them.

    A key that many sets share is dealt to groups of about ``GROUP``. Sets whose key no other has stay where they are.
    """
    keys = sets.select("id", key)
    shared = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    parts = F.ceil(F.col("_c") / GROUP).cast("bigint")
    dealt = keys.join(shared, key).select("id", F.xxhash64(key, F.pmod(F.xxhash64("id"), parts)).alias("group"))
    # the sets lie in buckets by id: only what meets others moves
    dealt = sets.select("id", "tokens").join(dealt, "id")
    slot = F.pmod("group", F.lit(shuffle_buckets(sets.sparkSession))).alias("slot")

    def run(table: pa.Table) -> pa.Table:
        ids, groups = table.column("id").to_numpy(), table.column("group").to_numpy()
        column = table.column("tokens")
        order = np.lexsort((ids, groups))
        cuts = [0, *(np.flatnonzero(np.diff(groups[order])) + 1).tolist(), len(order)]
        members, chosen = [], []
        for low, high in zip(cuts, cuts[1:]):
            if high - low == 1:
                continue
            some = order[low:high].tolist()
            for k, p in _pivots([np.frombuffer(column[k].as_buffer(), np.uint64) for k in some]):
                members.append(ids[some[k]])
                chosen.append(ids[some[p]])
        return pa.table({"id": pa.array(members, pa.int64()), "pivot": pa.array(chosen, pa.int64())})

    return dealt.withColumn("slot", slot).groupBy("slot").applyInArrow(run, "id bigint, pivot bigint")


def rarity_sketch(rows: DataFrame, column: str = "tokens", cells_: int = CELLS) -> np.ndarray:
    """How often fingerprints fall into each of ``cells_`` cells: a count that never is too small, of fixed size.

    Any order of shingles finds every link; this one puts frequent shingles last. The sketch is the same for
    all tasks, takes ``4 * cells_`` bytes whatever the corpus, and is summed by the executors.
    """
    block = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column(0)]
            cells = np.concatenate([np.zeros(0, np.uint64), *own]) & ar.U64(cells_ - 1)
            found, counts = np.unique(cells.astype(np.uint32), return_counts=True)
            cuts = np.searchsorted(found, np.arange(0, cells_ + 1, block))
            some = [k for k in range(len(cuts) - 1) if cuts[k + 1] > cuts[k]]
            inside, counts = (found % block).astype(np.uint16), counts.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([inside[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()),
                    pa.array([counts[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()),
                ],
                names=["block", "cells", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, np.float64)
        for inside, counts in zip(table.column("cells"), table.column("counts")):
            total[np.frombuffer(inside.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        sums = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = rows.select(column).mapInArrow(ar.tidy(count), "block int, cells binary, counts binary")
    sketch = np.zeros(cells_, np.uint32)
    for row in parts.groupBy("block").applyInArrow(add, "block int, sums binary").toLocalIterator():
        sketch[row.block * block : (row.block + 1) * block] = np.frombuffer(row.sums, np.uint32)
    return sketch


def by_rarity(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The global order: rare first, ties by fingerprint."""
    counts = sketch[(tokens & ar.U64(len(sketch) - 1)).astype(np.int64)]
    return tokens[np.lexsort((tokens, counts))]


def _prefixes(sets: DataFrame, sketch) -> DataFrame:
    """``token, id, n, room``: the prefix of each set; ``room`` is what of the set a token and those after it hold.

    Shingles whose cell counts one are nobody else's: they take a place but give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            out: tuple[list, ...] = ([none], [none], [none], [none])
            for one, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = by_rarity(np.frombuffer(raw.as_buffer(), np.uint64), sketch.value)
                n = len(own)
                own = own[: prefix_size(n)]
                place = np.flatnonzero(sketch.value[(own & ar.U64(CELLS - 1)).astype(np.int64)] > 1)
                for to, values in zip(out, (own[place].view(np.int64), np.full(len(place), one), np.full(len(place), n), n - place)):
                    to.append(values)
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "id", "n", "room"])

    return sets.select("id", "tokens").mapInArrow(ar.tidy(run), "token bigint, id bigint, n bigint, room bigint")


@dataclass
class Node:
    """A stretch of numbers that all sets below share; ``ends`` are the sets that end here."""

    run: np.ndarray
    deepest: int = 0  # most numbers below
    smallest: int = 1 << 60
    largest: int = 0
    ends: list[int] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)


def build_trie(rows: list[np.ndarray]) -> Node:
    """A path-compressed trie of sorted rows of numbers."""
    root = Node(np.zeros(0, np.int64))

    def grow(node: Node, chosen: list[int], at: int) -> None:
        sizes = [len(rows[k]) for k in chosen]
        node.smallest, node.largest = min(sizes), max(sizes)
        node.ends = [k for k, s in zip(chosen, sizes) if s == at]
        node.deepest = node.largest - at
        chosen = [k for k, s in zip(chosen, sizes) if s > at]
        low = 0
        while low < len(chosen):
            head = rows[chosen[low]][at]
            high = low + 1
            while high < len(chosen) and rows[chosen[high]][at] == head:
                high += 1
            # rows are sorted, so what the first and last share is shared by all between them
            a, b = rows[chosen[low]][at:], rows[chosen[high - 1]][at:]
            least = min(len(rows[k]) for k in chosen[low:high]) - at
            differ = np.flatnonzero(a[:least] != b[:least])
            shared = int(differ[0]) if len(differ) else least
            child = Node(a[:shared])
            node.below.append(child)
            todo.append((child, chosen[low:high], at + shared))
            low = high

    todo = [(root, sorted(range(len(rows)), key=lambda k: rows[k].tolist()), 0)] if rows else []
    while todo:
        grow(*todo.pop())
    return root


def walk(root: Node, probe: np.ndarray, n: int, known: np.ndarray, lengths: list[int], every: bool = False) -> list[int]:
    """Sets of a trie that link to a probe of ``n`` shingles; the first one unless ``every``.

    ``known`` marks the probe's numbers. A subtree is left when even a match of all that remains there
    cannot reach the overlap its smallest set needs, or when its sizes do not fit.
    """
    found, stack = [], [(root, 0)]
    while stack:
        node, overlap = stack.pop()
        overlap += int(known[node.run].sum())
        low, high = max(node.smallest, -(-FOUR * n // FIVE)), node.largest
        if low > high or FIVE * n < FOUR * low:
            continue
        if overlap + min(node.deepest, n - overlap) < needed(n, low):
            continue
        for k in node.ends:
            if overlap >= needed(n, lengths[k]):
                found.append(k)
                if not every:
                    return found
        stack.extend((child, overlap) for child in node.below)
    return found


def join_block(base: list[np.ndarray], probes: list[np.ndarray], every: bool = False) -> list[tuple[int, int]]:
    """For each probe, one set of ``base`` that it links to, if any, or ``every`` one. Frequent shingles lead, so paths are shared."""
    tokens, counts = np.unique(np.concatenate(base), return_counts=True)
    number = np.empty(len(tokens), np.int64)
    number[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    trie = build_trie([np.sort(number[np.searchsorted(tokens, own)]) for own in base])
    lengths, out = [len(own) for own in base], []
    for p, own in enumerate(probes):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        known = np.zeros(len(tokens), dtype=bool)
        known[number[at[tokens[at] == own]]] = True
        out += [(k, p) for k in walk(trie, own, len(own), known, lengths, every)]
    return out


def _compare(pairs: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges ``a, b`` between the clusters of ``pairs (block, probe)``, found by a trie of each block's sets."""
    # only clusters that are compared send their sets
    named = pairs.select(F.explode(F.array("block", "probe")).alias("pivot")).distinct()
    wanted = clusters.join(named, "pivot")
    members = sets.select("id", "tokens").join(wanted, "id").select("pivot", "id", "tokens")
    members = materialise(members, "members")
    counts = pairs.groupBy("block").agg(F.count(F.lit(1)).alias("_c"))
    parts = F.ceil(F.col("_c") / GROUP).cast("int")
    pairs = pairs.join(counts, "block").withColumn("part", F.pmod(F.xxhash64("probe"), parts).cast("int"))
    probes = pairs.join(members.withColumnRenamed("pivot", "probe"), "probe")
    probes = probes.select("block", "part", F.col("probe").alias("cluster"), "tokens")
    base = counts.select("block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    base = base.join(members.withColumnRenamed("pivot", "block"), "block")
    base = base.select("block", "part", F.lit(None).cast("bigint").alias("cluster"), "tokens")

    def run(table: pa.Table) -> pa.Table:
        cluster = table.column("cluster").to_pylist()
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        probes = [k for k, c in enumerate(cluster) if c is not None]
        base = [tokens[k] for k, c in enumerate(cluster) if c is None]
        hits = join_block(base, [tokens[k] for k in probes]) if base and probes else []
        linked = sorted({cluster[probes[p]] for _, p in hits})
        block = table.column("block")[0].as_py()
        return pa.table({"a": pa.array([block] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return base.unionByName(probes).groupBy("block", "part").applyInArrow(run, "a bigint, b bigint")


def linked_sets(sets: DataFrame) -> DataFrame:
    """``id, component`` of distinct sets (``id, n, tokens, k0, k1, k2``); a set without links is its own."""
    clusters, edges = None, []
    todo = sets
    for r in range(ROUNDS):
        found = materialise(_gather(todo, f"k{r}"), "gathered")
        edges.append(found.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        if r == 0:  # a set joins one cluster; later rounds connect pivots
            clusters = found
            todo = sets.join(found.select("id"), "id", "left_anti")
    clusters = sets.select("id").join(clusters, "id", "left").select("id", F.coalesce("pivot", "id").alias("pivot"))
    clusters = materialise(clusters, "clusters")
    linked = edges[0]
    for more in edges[1:]:
        linked = linked.unionByName(more)
    parts = components(linked)
    sketch = sets.sparkSession.sparkContext.broadcast(rarity_sketch(sets))
    placed = clusters.join(parts.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("id", "pivot", F.coalesce("component", "id").alias("component"))
    meets = _prefixes(sets, sketch).join(placed, "id").groupBy("token", "pivot").agg(
        F.first("component").alias("component"), F.max("room").alias("room"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    meets = materialise(meets, "meets")
    mixed = meets.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    meets = meets.join(mixed.where("lo <> hi").select("token"), "token")

    def side(name: str) -> DataFrame:
        columns = ["pivot", "component", "room", "low", "high"]
        return meets.select("token", *[F.col(c).alias(f"{name}_{c}") for c in columns])

    # where two linked sets meet first, neither shares what comes before: the rest must hold the whole overlap
    reach = F.least("p_room", "q_room") * (FIVE + FOUR) >= (F.col("p_low") + F.col("q_low")) * FOUR
    fits = (F.col("p_high") * FIVE >= F.col("q_low") * FOUR) & (F.col("q_high") * FIVE >= F.col("p_low") * FOUR)
    a, b = side("p"), side("q")
    pairs = a.join(b, (a["token"] == b["token"]) & (F.col("p_component") < F.col("q_component")) & reach & fits)
    pairs = pairs.select(F.col("p_pivot").alias("p"), F.col("q_pivot").alias("q")).distinct()
    sizes = clusters.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    pairs = pairs.join(sizes.select(F.col("pivot").alias("p"), F.col("size").alias("ps")), "p")
    pairs = pairs.join(sizes.select(F.col("pivot").alias("q"), F.col("size").alias("qs")), "q")
    larger = F.col("ps") >= F.col("qs")
    pairs = pairs.select(
        F.when(larger, F.col("p")).otherwise(F.col("q")).alias("block"),
        F.when(larger, F.col("q")).otherwise(F.col("p")).alias("probe"),
    )
    pairs = materialise(pairs, "pairs")
    rest = materialise(_compare(pairs, sets, clusters), "links")
    parts = components(linked.unionByName(rest))
    return sets.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _sized(hashed: DataFrame) -> DataFrame:
    """``key, id, n`` of every document."""
    kind = hashed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(own) for own in shingle_sets(*ar.text_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["key", "id", "n"]
            )

    return hashed.mapInArrow(ar.tidy(run), f"key {kind}, id bigint, n bigint")


def link_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, id, n_shingles, component_id, component``: one row per document.

    ``id`` is a hash of the text; ``component_id`` is the smallest key that links reach, a document without
    links being its own; ``component`` numbers the components.
    """
    body = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("id"), body.alias("text"))
    sized = materialise(_sized(hashed), "sized")
    # copies of a text answer alike, so their answers are divided by their number
    answers = occurring_twice(hashed.select("id", "text"), _shown).groupBy("id").agg(F.count(F.lit(1)).alias("answers"))
    texts = sized.where("n > 0").groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    chosen = texts.join(answers, "id").where(F.col("answers") >= _required(F.col("n")) * F.col("copies"))
    chosen = materialise(chosen.select("id"), "chosen")
    sets = store_buckets(_full_sets(hashed, chosen), "id", "sets")
    parts = linked_sets(sets)
    placed = sized.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = materialise(placed, "placed")
    least = placed.where("n > 0").groupBy("component").agg(F.min("key").alias("least"))
    # stored, so that the join below can split a component that holds most documents
    least = materialise(least, "least")
    named = placed.join(least, "component", "left")
    return named.select(
        F.col("key").alias(key),
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"),
        "component",
    )


def link_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``."""
    return link_documents(docs).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest ``doc_id``, in the columns of ``docs``.

    Several texts under that id: the one with the smallest hash stays. Repeated rows of a document and text
    count as one. Documents without any word stay; a component without any id keeps one text.
    """
    linked = link_documents(docs)
    alike = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # at most a few rows of each component carry its smallest id
    first = linked.where(alike & (F.col("n_shingles") > 0)).groupBy("doc_id", "component").agg(F.min("id").alias("id"))
    first = first.select(F.col("doc_id").alias("__doc"), F.col("id").alias("__id")).distinct()
    first = materialise(first, "kept")
    whole = docs.withColumn("__id", F.xxhash64(F.coalesce("text", F.lit(""))))
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = whole.where(words).dropDuplicates(["doc_id", "__id"])
    kept = some.join(first, some["doc_id"].eqNullSafe(first["__doc"]) & (some["__id"] == first["__id"]), "left_semi")
    return kept.unionByName(whole.where(~words)).select(*docs.columns)
