"""The words of lines in arrays, and what they cost."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from leaksieve.llm import arrays as ar
from leaksieve.llm import lines


def plain(texts):
    """The word sets of the lines with words, and where these lines are."""
    rows = []
    for row, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            words = "".join(c.lower() if c.isascii() else c for c in line).split()
            if words:
                rows.append((row, number, sorted(hash_of(w) for w in set(words))))
    return rows


def hash_of(word):
    data, offsets = ar.text_bytes(pa.array([word]))
    return int(ar.fingerprints(ar.prefix_sums(data), offsets[:1], offsets[1:])[0])


def told(texts):
    data, offsets = ar.text_bytes(pa.array(texts, pa.string()))
    hashes, line, rows, numbers = lines.line_words(data, offsets, 0, len(texts))
    return [(int(r), int(n), hashes[line == k].tolist()) for k, (r, n) in enumerate(zip(rows, numbers))]


@pytest.mark.parametrize("seed", range(30))
def test_like_plain_python(seed):
    """Words and lines end with a text, blank and null texts have none, and repeated words count once."""
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("aAbé \n\t") for _ in range(rng.randrange(14))) for _ in range(9)]
    assert told(texts) == plain(texts)


@pytest.mark.parametrize("count", [5, 3000])
def test_hashes_that_look_alike(count):
    """Those of a line that differ in their last bits alone are in order and apart too."""
    hashes = np.array([7, 6, 5, 7, 5] * count, np.uint64)
    line = np.repeat(np.arange(count), 5)
    assert lines._by_line(line, hashes).tolist() == [5, 5, 6, 7, 7] * count


def test_stable_order():
    keys = np.array([3, 1, 3, 0, 1], np.uint64)
    for bits in (2, 62):
        assert ar.stable_order(keys, bits).tolist() == [3, 1, 4, 0, 2]


def test_cost_of_a_byte():
    """A line's words take less than 6.5 times as long as looking up each byte in a table; they took 7.3 to 9.7 times as long."""
    rng = random.Random(5)
    texts = ["\n".join(" ".join(f"word{rng.randrange(5000)}" for _ in range(40)) for _ in range(8)) for _ in range(1000)]
    data, offsets = ar.text_bytes(pa.array(texts))

    def best(run):
        took = []
        for _ in range(7):
            began = time.process_time()
            for low, high in ar.chunks(offsets, lines.CHUNK_BYTES):
                run(low, high)
            took.append(time.process_time() - began)
        return min(took)

    table = best(lambda low, high: ar.VALUE[data[offsets[low] : offsets[high]]])
    assert best(lambda low, high: lines.line_words(data, offsets, low, high)) < 6.5 * table
