"""The pipeline's rows against plain versions of its five stages, one after another."""

import random
import re
import zlib

import cases
import numpy as np
import public_tokenizers

import corpus_pipeline
from leaksieve.llm import langid
from test_samples import plain_phrases


def corpus(rng):
    """Documents in two languages with copies, near copies, repeated lines, benchmark passages and junk."""
    rows = []
    for k in range(60):
        lang = "fr" if k % 3 == 0 else "en"
        rows.append((cases.prose(rng, lang, rng.randint(30, 150)), lang if k % 5 else None))
    item = cases.prose(rng, "en", 40).replace("\n", " ")
    rows += [(rows[1][0], "en"), (rows[1][0] + " end", "en"), (rows[4][0].upper(), None)]
    # the same words in other lines: near duplicates of which no line is a repeat
    rows += [(rows[k][0].replace("\n", " ") + f" {k}", "en") for k in (13, 16, 22)]
    rows += [(f"{rows[k][0]}\n{rows[2][0].splitlines()[0]}\n{item}\nnew line {k} of it", "en") for k in (7, 10)]
    rows += [("", None), ("1234 ... 5", None), (None, "en"), (" \n", None), (item, "en")]
    return [(k, text, lang, "src", len(text or "")) for k, (text, lang) in enumerate(rows)], [(1, item), (2, "no such passage at all in here, not one")]


def language(rows, samples):
    width = len(set("".join(samples.texts.values())) - {" "}) + 2
    out = []
    for key, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            continue
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        blocks = [low[k : k + langid.BLOCK] for k in range(0, len(low), langid.BLOCK)]
        costs = {n: sum(plain_phrases(b, s) for b in blocks) * np.log2(max(len(s), width)) for n, s in samples.texts.items()}
        out.append((key, text, min(sorted(costs), key=costs.get)))
    return out


def line_dedup(rows):
    gone = {r[0]: set(r[3]) for r in cases.line_report([r[:2] for r in rows], least=1)}
    out = []
    for key, text, lang in rows:
        if gone[key]:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[key])
            if not text.split():
                continue
        out.append((key, text, lang))
    return out


def near_duplicates(rows):
    linked = {r[0]: r for r in cases.linked([r[:2] for r in rows])}
    return [r for r in rows if linked[r[0]][2] == r[0]]


def decontaminated(rows, items):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, text in items:
        words = pattern.findall(text.translate(fold))
        windows |= {tuple(words[k : k + 10]) for k in range(len(words) - min(10, len(words)) + 1)}
    out = []
    for key, text, lang in rows:
        found = list(pattern.finditer(text.translate(fold)))
        words, hit = [m[0] for m in found], set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if words and len(hit) == len(words):
            continue
        keep = [True] * len(text)
        for k in sorted(hit):
            end = found[k + 1].start() if k + 1 in hit else found[k].end()
            keep[found[k].start() : end] = [False] * (end - found[k].start())
        out.append((key, "".join(c for c, x in zip(text, keep) if x), lang))
    return out


def test_run_against_plain_stages(spark, tmp_path):
    rows, items = corpus(random.Random(12))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    samples = langid.language_samples(spark.read.parquet(f"{tmp_path}/documents.parquet"))

    kept = language([r[:3] for r in rows], samples)
    assert {r[2] for r in kept} == {"en", "fr"} and len(kept) < len(rows)
    for stage in (line_dedup, near_duplicates):
        fewer = stage(kept)
        assert fewer != kept
        kept = fewer
    kept = decontaminated(kept, items)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for key, text, _ in kept:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            want.append((key, piece, at, len(part) // 4, zlib.crc32(part)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cases.same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    total = sum(w[3] for w in want)
    assert len({r.sequence_id for r in got}) == -(-total // 2048) or len({r.sequence_id for r in got}) <= -(-total // 2048) + 1
