"""What a worker process keeps between tasks."""

import gc
import pickle
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from leaksieve.llm import arrays as ar
from leaksieve.llm import BATCH_ROWS, READ_ROWS, decontaminate, langid, lines, modest_batches, tokens
from leaksieve.llm.queries import TOKENIZER


def test_one_model_at_a_time():
    """A model serves its operator's next tasks, and goes when another operator builds its own."""
    first = tokens.tokenizer(TOKENIZER)
    assert tokens.tokenizer(TOKENIZER) is first
    seen = weakref.ref(first)
    del first
    model = langid.parser({"en": "the cat sat on the mat"})
    gc.collect()
    assert seen() is None
    assert langid.parser({"en": "the cat sat on the mat"}) is model
    seen = weakref.ref(model)
    del model
    tokens.tokenizer(TOKENIZER)
    gc.collect()
    assert seen() is None


def test_powers_go_with_a_task():
    """Tables that a long text made are not kept; hashes are the same without them."""
    before = ar.prefix_sums(ar.VALUE.view("uint8"))
    assert ar._POWERS
    assert list(ar.tidy(iter)([1, 2])) == [1, 2] and not ar._POWERS
    assert (ar.prefix_sums(ar.VALUE.view("uint8")) == before).all()


def test_words_of_a_shard():
    """Numbered part by part: the same as at once, in less than 24 bytes for each byte of text, where it took 35."""
    rng = random.Random(3)
    texts = ["", *(" ".join(f"Word{rng.randrange(900)}" for _ in range(rng.randrange(600))) for _ in range(400)), "", "word1"]
    data, offsets = ar.text_bytes(pa.array(texts))
    data = ar.lowered(data)
    begin, end, first = ar.words(data, offsets, ar.ALNUM)
    hashes = ar.fingerprints(ar.prefix_sums(data), begin, end)
    vocabulary = np.unique(hashes)[::3]
    ar.give_back()
    tracemalloc.start()
    got = decontaminate._numbered(data, offsets, vocabulary)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = begin, end, first, decontaminate._word_numbers(hashes, vocabulary)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True)) and want[3].any()
    assert len(data) > 5 * decontaminate.PART_BYTES and most < 24 * len(data)


def test_models_go_before_tasks_that_use_none():
    """Also in a worker, which gets the function pickled."""
    kept = pickle.loads(cloudpickle.dumps(ar.tidy(iter, model=True)))
    others = pickle.loads(cloudpickle.dumps(ar.tidy(iter)))
    model = langid.parser({"en": "the cat sat on the mat"})
    assert list(kept([1])) == [1] and langid.parser({"en": "the cat sat on the mat"}) is model
    seen = weakref.ref(model)
    del model
    assert list(others([1])) == [1]
    gc.collect()
    assert seen() is None


def _entry_parts(count: int) -> list[list[np.ndarray]]:
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)
    columns = [rng.integers(0, 1 << 20, count).astype(k) for k in list(lines._KINDS.values())[1:]]
    cuts = [0, count // 3, count // 3, count]
    return [[c[a:b].copy() for a, b in zip(cuts, cuts[1:])] for c in (hashes, *columns)]


def test_entries_of_a_chunk():
    """Each slot's entries in order of their words, in less than 100 bytes for each entry of 48; it took 196."""
    count, slots = 1 << 16, 48
    kept = _entry_parts(count)
    hashes, *columns = (np.concatenate(parts) for parts in kept)
    slot = ((hashes >> np.uint64(40)) * np.uint64(slots) >> np.uint64(24)).astype(int)
    order = np.lexsort((hashes.astype(np.uint32), slot))
    tracemalloc.start()
    kept = _entry_parts(count)
    tracemalloc.reset_peak()
    got = lines._pack_entries(kept, slots)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == slots and not any(kept) and most < 100 * count
    for name, kind, want in zip(lines._KINDS, lines._KINDS.values(), (hashes.astype(np.uint32), *columns), strict=True):
        for k, cell in zip(got.column("slot").to_pylist(), got.column(name)):
            assert (np.frombuffer(cell.as_buffer(), kind) == want[order][slot[order] == k]).all()
    few = lines._pack_entries([[c[:0], c[:1]] for c in (hashes, *columns)], slots)
    assert few.num_rows == 1 and few.column("slot").to_pylist() == [slot[0]]


def test_batches_of_texts_stay_small(spark):
    """Those of Arrow and of Parquet's reader, unless the session has sizes of its own."""
    names = BATCH_ROWS, READ_ROWS
    before = [spark.conf.get(k) for k in names]
    try:
        for given, want in ((("10000", "4096"), ("250", "512")), (("77", "99"), ("77", "99"))):
            for name, value in zip(names, given):
                spark.conf.set(name, value)
            modest_batches(spark, 250)
            assert [spark.conf.get(k) for k in names] == list(want)
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
