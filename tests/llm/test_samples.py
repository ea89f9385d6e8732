"""Languages with little labelled text."""

import random

import cases

from leaksieve.llm import langid


def corpus(spark, sizes, rest=40):
    """``sizes``: for each language, how many labelled texts of how many words."""
    rng = random.Random(11)
    rows = [(cases.prose(rng, lang, words), lang) for lang, (n, words) in sizes.items() for _ in range(n)]
    rows += [(cases.prose(rng, lang, 80), None) for lang in sizes for _ in range(rest)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    want = [lang for lang in sizes for _ in range(rest)]
    return frame, want


def predicted(frame, samples):
    rows = langid.identify(frame.where("lang is null"), samples).orderBy("doc_id").collect()
    return [r.lang_pred for r in rows]


def test_a_short_language_shortens_no_other(spark):
    frame, want = corpus(spark, {"en": (60, 120), "fr": (1, 70)})
    samples = langid.draw_samples(frame, ["doc_id"])
    assert len(samples.texts["en"]) >= 20_000 and len(samples.texts["fr"]) < 1000
    assert predicted(frame, samples) == want


def test_short_rows_fill_a_sample(spark):
    frame, want = corpus(spark, {"en": (1500, 3), "fr": (60, 120)})
    samples = langid.draw_samples(frame, ["doc_id"])
    assert min(map(len, samples.texts.values())) >= 20_000 and predicted(frame, samples) == want


def test_little_text_is_learned(spark):
    frame, want = corpus(spark, {"en": (1, 30), "fr": (1, 30)})
    samples = langid.draw_samples(frame, ["doc_id"])
    assert set(samples.texts) == {"en", "fr"} and max(map(len, samples.texts.values())) < 500
    assert predicted(frame, samples) == want


def test_the_query_names_them_all(spark):
    frame, want = corpus(spark, {"en": (60, 120), "fr": (2, 40)})
    rows = langid.identify_documents(frame).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows][-len(want) :] == want


def plain_phrases(text, sample):
    """Phrases of a greedy parse; a letter that the sample lacks ends one and is no part of the next."""
    count, phrase = 0, ""
    for letter in text:
        if phrase + letter in sample:
            phrase += letter
        else:
            count += 1
            phrase = letter if letter in sample else ""
    return count + (len(text) > 0)


def test_many_languages_and_large_alphabets():
    """Fifty languages, three of them with thousands of letters: parsed as by plain search, in little memory."""
    rng = random.Random(3)
    letters = {"zh": [chr(0x4E00 + k) for k in range(2500)], "ko": [chr(0xAC00 + k) for k in range(1500)], "ja": [chr(0x3041 + k) for k in range(80)] + [chr(0x4E00 + k) for k in range(900)]}
    letters |= {f"l{k}": rng.sample([chr(0x61 + i) for i in range(26)] + [chr(0x3B1 + i) for i in range(24)] + [chr(0x430 + i) for i in range(32)], 25) for k in range(47)}
    samples = {k: langid.normalise(" ".join("".join(rng.choices(v, k=rng.randint(1, 7))) for _ in range(900))) for k, v in letters.items()}
    model = langid.CrossParser(samples)
    size = sum(x.nbytes for x in (model.base, model.owner, model.target, model.first, model.codes))
    assert size < 64e6 and model.width > 3500
    texts = [samples[rng.choice(list(samples))][k : k + 200] for k in range(0, 2000, 100)] + ["一丁 xyz α", "ꙮ"]
    counts, _ = model.parse(texts)
    for text, row in zip(texts, counts):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        assert row.tolist() == [plain_phrases(low, samples[name]) for name in model.names]


def test_the_decision_is_that_of_plain_search(spark):
    """Language and score of whole texts, against substrings and logarithms."""
    import math

    frame, _ = corpus(spark, {"en": (20, 60), "fr": (12, 60)}, rest=15)
    samples = langid.draw_samples(frame, ["doc_id"], langid.TrainOptions(chars=3000))
    width = len(set("".join(samples.texts.values())) - {" "}) + 2
    rows = langid.identify(frame, samples).collect()
    for r in rows:
        costs = {}
        for name, sample in samples.texts.items():
            low = "".join(c if c.isalpha() else " " for c in r.text.lower())
            blocks = [low[k : k + langid.BLOCK] for k in range(0, len(low), langid.BLOCK)]
            costs[name] = sum(plain_phrases(b, sample) for b in blocks) * math.log2(max(len(sample), width))
        first, second = sorted(costs.items(), key=lambda x: (x[1], x[0]))[:2]
        assert r.lang_pred == first[0] and abs(r.score - (second[1] - first[1]) / second[1]) < 1e-9


def test_samples_are_bounded_together(spark):
    rng = random.Random(5)
    rows = [(k, cases.prose(rng, "en", 60), f"x{k % 40}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts = langid.draw_samples(frame, ["doc_id"], langid.TrainOptions(total_chars=8000)).texts
    assert len(texts) == 40 and max(map(len, texts.values())) <= 201


def test_very_long_texts(spark):
    rng = random.Random(6)
    frame, _ = corpus(spark, {"en": (30, 120), "fr": (30, 120)}, rest=0)
    long = spark.createDataFrame([(-1, cases.prose(rng, "fr", 150_000), None), (-2, "é" * 400_000, None)], frame.schema)
    samples = langid.draw_samples(frame, ["doc_id"])
    got = {r.doc_id: r.lang_pred for r in langid.identify(long, samples).collect()}
    assert got == {-1: "fr", -2: "fr"}
