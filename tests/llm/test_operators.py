"""Every operator against a brute-force version on the odd cases, and on empty tables."""

import zlib

import cases
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cases import docs, no_docs  # noqa: F401
from leaksieve.llm import decontaminate, jaccard, langid, lines, packing, quality, repeats, secrets, sharding
from leaksieve.llm.fmindex import FMIndex

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- 1: decontamination


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontamination(spark, docs):
    texts = cases.texts()
    words = texts[9].split()
    items = [(1, " ".join(words[3:20])), (2, " ".join(words[10:24]).upper()), (2, "one two"), (None, texts[4]), (5, None), (6, "-"), (7, texts[12])]
    got = decontaminate.contamination(docs, benchmark(spark, items)).collect()
    cases.same(got, cases.contamination(cases.pairs(docs), items))


def test_decontamination_in_blocks(spark, docs):
    items = [(k, t) for k, t in enumerate(cases.texts()[:8])]
    plan = decontaminate.mark_hits(docs.select("doc_id", "text"), benchmark(spark, items), block_bytes=1500)
    want = cases.contamination(cases.pairs(docs), items)
    got = plan.select("doc_id", "__n_words", "__n_hit", F.size("__items")).collect()
    cases.same(got, [w[:4] for w in want])


def test_passages_are_cut(spark, docs):
    items = [(1, cases.texts()[9])]
    left = decontaminate.remove_passages(docs, benchmark(spark, items))
    assert left.columns == docs.columns and not any(r[5] for r in cases.contamination(cases.pairs(left), items))
    clean = {r[0] for r in cases.contamination(cases.pairs(docs), items) if not r[5]}
    assert clean <= {r.doc_id for r in left.collect()}


def test_empty_benchmark(spark, docs, no_docs):
    none = benchmark(spark, [])
    assert not decontaminate.contamination(docs, none).where("contaminated").count()
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_fm_index():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(0, 4, 400), [0]])
    index = FMIndex(text, sample=4)
    for n in (1, 2, 3, 5):
        patterns = rng.integers(1, 6, (60, n))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- 2: language


def test_languages(spark, docs, no_docs):
    known = docs.where("text is not null and length(text) > 80 and lang is not null").select("doc_id", "text", "lang")
    options = langid.TrainOptions(rows=40, chars=4000, least_chars=200)
    samples = langid.sample_texts(known, ["doc_id"], options)
    assert set(samples.texts) == {"en", "fr"} and len(set(map(len, samples.texts.values()))) == 1
    got = langid.identify(docs.drop("score"), samples).select("text", "lang_pred", "score").collect()
    for r in got:
        assert 0 <= r.score <= 1
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    french = [r for r in got if r.text in set(cases.texts()[0:24:3])]
    assert len(french) >= 8 and all(r.lang_pred == "fr" for r in french)
    assert langid.identify(no_docs, samples).count() == 0
    nothing = langid.identify(docs, langid.LanguageSamples({}))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_cross_parsing_counts_phrases():
    samples = {"a": "abracadabra", "b": "bbbbbbbbbbb"}
    model = langid.CrossParser(samples)

    def phrases(text, sample):
        count, at = 0, 0
        while at < len(text):
            size = 0
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            at += max(size, 1)
            count += 1
        return count

    texts = ["abra", "bbab", "cadbra", "braabb", ""]
    counts, sizes = model.parse(texts)
    assert sizes.tolist() == [4, 4, 6, 6, 0]
    assert counts[:, 0].tolist() == [phrases(t, samples["a"]) for t in texts]


def test_long_blocks_parse_like_short_ones():
    import random

    rng = random.Random(1)
    samples = {"en": cases.prose(rng, "en", 400), "fr": cases.prose(rng, "fr", 400)}
    size = min(map(len, samples.values()))
    model = langid.CrossParser({k: langid.normalise(v)[: size // 2] for k, v in samples.items()})
    text = cases.prose(rng, "fr", 900)
    pieces = [text[k : k + langid.BLOCK] for k in range(0, len(text), langid.BLOCK)]
    assert (model.parse([text])[0][0] == model.parse(pieces)[0].sum(axis=0)).all()


# --- 4: sharding


def test_shards(docs, no_docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = {(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in cases.pairs(docs)}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == want
    assert sharding.shard_documents(no_docs).count() == 0


def test_weights_share_records(spark):
    rows = sharding.assign_shards(spark.range(40_000), ["id"], [1, 2, 5]).groupBy("shard").count().collect()
    counts = {r.shard: r["count"] for r in rows}
    for shard, weight in enumerate((1, 2, 5)):
        assert abs(counts[shard] / 40_000 - weight / 8) < 0.02
    moved = sharding.move_plan(spark.range(40_000), ["id"], [1, 1, 1], [1, 1, 1, 1])
    assert {r.to_shard for r in moved.collect()} == {3} and abs(moved.count() / 40_000 - 1 / 4) < 0.02
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1), ["id"], [])


def test_slots_of_one_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("key"), F.lit(0).alias("shard"))
    assert sorted(r.slot for r in sharding.number_slots(rows, buckets=8).collect()) == list(range(3000))


# --- 5: quality


def test_statistics(docs):
    got = quality.text_stats(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    cases.same(got.collect(), [(k, *cases.stats(t)) for k, t in cases.pairs(docs)])


def test_learned_list(spark, docs, no_docs):
    rows = [(k, ("word" + str(k * 7 % 97) + " ") * 3 + ("$$ " * 40 if k % 5 == 0 else "") + cases.texts()[k % 20]) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(0, 300)] + [(None, 0, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.judge_documents(table, labels)
    for r in out.collect():
        assert r.kept == (not r.base_failed and r.doc_id % 5 > 0)
    none = labels.where("false")
    judged = quality.judge_documents(docs, none)
    assert judged.where("kept = base_failed").count() == 0 and judged.count() == docs.count()
    assert quality.judge_documents(no_docs, labels).count() == 0


# --- 6: lines


def test_lines(docs, no_docs):
    got = lines.line_report(docs).collect()
    cases.same(got, cases.line_report(cases.pairs(docs)))
    assert lines.line_report(no_docs).count() == 0


def test_lines_ask_again(docs):
    """With one candidate asked first, and a small sketch, the second round finds the rest."""
    options = lines.LineOptions(cells=1 << 16, first_asked=1)
    cases.same(lines.line_report(docs, options).collect(), cases.line_report(cases.pairs(docs)))


def test_lines_are_dropped(docs):
    left = lines.drop_repeated_lines(docs)
    assert left.columns == docs.columns
    assert all(r[2] == 0 for r in cases.line_report(cases.pairs(left)))


# --- 7: repeats


def test_repeats(docs, no_docs):
    cases.same(repeats.remove_repeats(docs).collect(), cases.repeats(cases.pairs(docs)))
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_with_a_hot_edge(spark, monkeypatch):
    """A passage whose surroundings all differ, in more texts than a chunk tells others of."""
    import random

    from leaksieve.llm import exchange

    monkeypatch.setattr(exchange, "MOST_OUTER", 4)
    rng = random.Random(5)
    passage = cases.prose(rng, "en", 60)[:260]
    rows = [(k, cases.prose(rng, "en", rng.randint(1, 50)) + passage + cases.prose(rng, "fr", rng.randint(1, 50))) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    cases.same(repeats.remove_repeats(table).collect(), cases.repeats(rows))


# --- 8: packing


def check_packing(rows, length=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_packing(docs, no_docs):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER, packing.PackOptions(with_ids=True)).collect()
    check_packing(rows)
    want = []
    for key, text in cases.pairs(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            want.append((key, piece, at, len(part) // 4, zlib.crc32(part), bytearray(part)))
    cases.same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytearray(r.ids)) for r in rows], want)
    assert packing.pack_documents(no_docs, TOKENIZER).count() == 0


def test_partitions_exchange(spark):
    import random

    rng = random.Random(2)
    sizes = [rng.choice([300, 700, 701, 1023, 1400]) for _ in range(400)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "_row bigint, length bigint")
    options = packing.PackOptions(per_part=40)
    packed = packing.pack(pieces, options).join(pieces, "_row").collect()
    assert len(packed) == 400
    alone = packing._pack(pieces, 400, 0, options)
    assert check_packing(packed) <= packing._bins(alone)


def test_bounds_hold():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 100) for _ in range(rng.randint(1, 40))])
        bins, offsets, used = packing.best_fit(lengths, 100)
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert -(-lengths.sum() // 100) <= bound <= used


# --- 9: n-gram Jaccard join


def test_links(docs, no_docs):
    cases.same(jaccard.link_report(docs).collect(), cases.linked(cases.pairs(docs)))
    assert jaccard.link_report(no_docs).count() == 0


def test_links_without_clusters(docs, monkeypatch):
    """The tree alone finds every link when no clusters are gathered first."""
    monkeypatch.setattr(jaccard, "GROUP", 1)
    cases.same(jaccard.link_report(docs).collect(), cases.linked(cases.pairs(docs)))


def test_one_of_each_stays(docs):
    left = jaccard.keep_one_of_each(docs)
    assert left.columns == docs.columns
    rows = cases.pairs(left)
    links = cases.linked(rows)
    assert len({(n, c) for _, n, c in links if n}) == sum(n > 0 for _, n, _ in links)
    assert {c for _, n, c in cases.linked(cases.pairs(docs)) if n} == {c for _, n, c in links if n}


def test_trie_walk():
    import random

    import numpy as np

    rng = random.Random(6)
    base = [np.array(sorted(rng.sample(range(40), rng.randint(5, 30))), dtype=np.uint64) for _ in range(80)]
    probes = [np.array(sorted(rng.sample(range(45), rng.randint(5, 30))), dtype=np.uint64) for _ in range(40)] + base[:5]
    got = {p for _, p in jaccard.join_block(base, probes)}
    want = {p for p, a in enumerate(probes) if any(cases.similar(set(a.tolist()), set(b.tolist())) for b in base)}
    assert got == want and want


# --- 10: secrets


def test_secrets(docs, no_docs):
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_documents(docs).collect()}
    assert got == {(k, *cases.secrets(t)[:4]) for k, t in cases.pairs(docs)}
    assert secrets.scan_documents(docs).count() == docs.count()
    assert secrets.scan_documents(no_docs).count() == 0


def test_ledger_is_incremental(spark):
    key = "ghp_" + "a1B2" * 9
    old = spark.createDataFrame([("a", f"x {key}"), ("b", "plain")], "path string, text string")
    new = old.unionByName(spark.createDataFrame([("c", f"x {key}"), ("d", "secret: abcdefgh")], "path string, text string"))
    first = secrets.scan_unseen(old).persist()
    second = secrets.scan_unseen(new, ledger=first).persist()
    assert (first.count(), second.count()) == (2, 1)  # c holds a known text
    found = secrets.path_findings(secrets.address(new, ["path"]), first.unionByName(second))
    listed = {r.path: r.spans for r in secrets.secret_digest(found, ["path"]).collect()}
    assert listed == {"a": "github:2:42", "b": "", "c": "github:2:42", "d": "assign:0:16"}
    changed = (*secrets.RULES[:3], secrets.SecretRule("github", "ghp_", "gh", version=2))
    third = secrets.scan_unseen(new, changed, first.unionByName(second))
    assert {tuple(r.rules) for r in third.collect()} == {("github@2",)}
