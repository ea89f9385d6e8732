"""Token ids of whole texts from a published tokenizer, a word at a time.

Where the tokenizer's first step never joins what blanks part, the ids of a text are those of its blank-separated
words one after another. Each task keeps the words it has seen; new ones go to the tokenizer together, words of
ASCII letters to tiktoken with the file's own merges where these are plain. Whether both hold is tried on a probe when the
file is opened; otherwise, and for texts with the name of a special token, the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

from leaksieve.llm import arrays as ar

# Trailing marks that the tokenizer parts from an ASCII letter or digit before them. No apostrophe:
# with one, a mark and the letters after it may be one token.
MARKS = b".,!?;:|#*$%&()-"
_MARK = np.zeros(256, dtype=bool)
_MARK[list(MARKS)] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
MOST_WORDS = 300_000  # kept words; the older half goes beyond it


# Words and marks of many kinds, to see whether a file's tokenizer takes texts apart at blanks.
PROBE = (
    "Hello, world! It's 3.5% of a-b (c); d's é, ñandú x's 'tis 12 |a| #b $c don't STOP.\nTwo  lines\tand a tab, 漢字 かな 🙂? "
    "naïve co-operation e.g. i.e. (see p. 10) \"quoted\" 'single' we'll they're I'd you've a_b c/d http://x.yz/?q=1&r=2 ... --- *** <b>bold</b>"
)


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.special = [t["content"].encode() for t in form.get("added_tokens", ())]
        self.known: dict[bytes, bytes] = {}
        self.merges = self.final = None
        self.by_words = False
        self._plain_merges(form)
        whole = self._alone(PROBE.encode())
        self.by_words = all(not set(t).intersection(b" \t\n\x0b\x0c\r") for t in self.special) and self.encode([PROBE.encode()]) == [whole]
        self.known.clear()

    def _plain_merges(self, form: dict) -> None:
        """For words of ``a`` to ``z``: merges over bytes, the last letter of a word as its capital."""
        model = form["model"]
        entries, end = model.get("vocab", {}), model.get("end_of_word_suffix")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
        if any(model.get(k) != v for k, v in plain.items()) or any(m not in entries for m in merged):
            return
        order = [entries[m] for m in merged]
        if order != sorted(order) or set(entries) - set(merged) - {c + e for c in {x.removesuffix(end) for x in entries if len(x.removesuffix(end)) == 1} for e in ("", end)}:
            return

        def spelled(entry: str) -> bytes | None:
            body, last = entry.removesuffix(end), entry.endswith(end)
            if not (body.isascii() and body.isalpha() and body.islower()):
                return None
            return (body[:-1] + body[-1].upper()).encode() if last else body.encode()

        ranks = {b: n for entry, n in entries.items() if (b := spelled(entry))}
        first = {bytes([b]) for b in range(97, 123)} | {bytes([b]) for b in range(65, 91)}
        if not first <= set(ranks):
            return
        spare = max(entries.values()) + 1  # bytes that no such word has
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = spare
                spare += 1
        import tiktoken

        self.merges = tiktoken.Encoding("words", pat_str=r"[a-zA-Z]+", mergeable_ranks=ranks, special_tokens={})
        self.final = np.zeros(spare, dtype=bool)
        self.final[[n for b, n in ranks.items() if b[-1:].isupper()]] = True

    def _alone(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        if self.merges is not None:
            ascii_ = [w for w in words if w.isalpha()]
            if ascii_:
                text = b" ".join([w[:-1] + w[-1:].upper() for w in ascii_]).decode()
                ids = np.array(self.merges.encode_ordinary(text), dtype="<u4")
                ends = ((np.flatnonzero(self.final[ids]) + 1) * 4).tolist()
                raw = ids.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(ascii_, [0, *ends], ends))
                words = [w for w in words if not w.isalpha()]
        plain = [w for w in words if w.decode().isalpha()]
        for low in range(0, len(plain), 2000):
            part = plain[low : low + 2000]
            done = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.array(done.word_ids, dtype=np.int64))) + 1
            if len(cuts) + 1 != len(part):  # a word is more than one unit to the tokenizer
                self.known.update((w, self._alone(w)) for w in part)
                continue
            ids = np.array(done.ids, dtype="<u4").tobytes()
            ends = [*(cuts * 4).tolist(), len(ids)]
            self.known.update((w, ids[a:b]) for w, a, b in zip(part, [0, *ends], ends))
        for word in set(words).difference(plain):
            self.known[word] = self._alone(word)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_words and texts != [PROBE.encode()]:
            return [self._alone(text) for text in texts]
        lowered = [text.lower() for text in texts]  # of bytes, as the split: both touch ASCII only
        whole = {
            k: self._alone(text) for k, (text, low) in enumerate(zip(texts, lowered)) if any(t in low or t in text for t in self.special)
        }
        for k in whole:
            lowered[k] = b""
        data = np.frombuffer(b"".join(lowered), np.uint8)
        offsets = np.cumsum([0, *map(len, lowered)])
        begin, end, _ = ar.words(data, offsets, ar.NOT_BLANK)
        core = self._letters(data, begin, end)
        plain = core > begin
        # units in order: letters for tiktoken, and the marks behind them or other words whole
        rest = np.where(plain, core, begin)
        others = rest < end
        first, one = self._merged(data, begin[plain], core[plain])
        second, two = self._looked_up(data, rest[others], end[others])
        at = np.concatenate([begin[plain], rest[others]])
        order = np.argsort(at, kind="stable")
        counts = np.concatenate([one, two])
        sums = np.concatenate([[0], np.cumsum(counts[order])])
        start = np.empty(len(at), np.int64)
        start[order] = sums[:-1]
        out = np.empty(sums[-1], "<u4")
        out[np.repeat(start[: len(one)] - np.cumsum(one) + one, one) + np.arange(len(first))] = first
        out[np.repeat(start[len(one) :] - np.cumsum(two) + two, two) + np.arange(len(second))] = second
        raw, ends = out.tobytes(), (sums[np.searchsorted(at[order], offsets)] * 4).tolist()
        return [whole[k] if k in whole else raw[a:b] for k, (a, b) in enumerate(zip(ends, ends[1:]))]

    def _letters(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where words of ASCII letters end, before their trailing marks; for other words their begin."""
        if self.merges is None or not len(begin):
            return begin
        last = np.where(_MARK[data], -1, np.arange(len(data)))
        np.maximum.accumulate(last, out=last)
        core = np.maximum(last[end - 1] + 1, begin)
        strange = np.concatenate([[0], np.cumsum(~_LETTER[data])])
        return np.where(strange[core] == strange[begin], core, begin)

    def _merged(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has."""
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        size = end - begin
        to = np.cumsum(size + 1) - 1  # each with a blank behind it
        text = np.full(to[-1], 32, np.uint8)
        place = np.arange(size.sum())
        word = np.repeat(np.arange(len(size)), size)
        text[place + word] = data[place + (begin - np.cumsum(size) + size)[word]]
        text[to - 1] -= 32  # the last letter as its capital
        ids = self.merges.encode_to_numpy(text.tobytes().decode())
        return ids, np.diff(np.flatnonzero(self.final[ids]), prepend=-1)

    def _looked_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any other words and marks, and how many each has; Arrow finds the different ones."""
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        edges = np.concatenate([[0], np.cumsum(end - begin)])
        kept = data[np.arange(edges[-1]) + np.repeat(begin - edges[:-1], end - begin)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(kept)])
        words = words.dictionary_encode()
        kinds = words.dictionary.to_pylist()
        self._know(kinds)
        found = [self.known[w] for w in kinds]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        raw, _ = ar.text_bytes(ids)
        return np.frombuffer(raw.tobytes(), "<u4"), np.array([len(x) // 4 for x in found], np.int64)[words.indices.to_numpy()]

    def _know(self, words: list[bytes]) -> None:
        """See to it that ``known`` has these words."""
        if len(self.known) > MOST_WORDS:
            self.known = dict(islice(self.known.items(), MOST_WORDS // 2, None))
        new = [w for w in words if w not in self.known]
        parts = {}
        for word in new:
            core = word.rstrip(MARKS)
            if core and len(core) < len(word) and core[-1:].isalnum():
                parts[word] = core, word[len(core) :]
        wanted = {p for word in new for p in parts.get(word, (word,))}
        self._learn([w for w in wanted if w not in self.known])
        for word, (core, marks) in parts.items():
            self.known[word] = self.known[core] + self.known[marks]


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    return ar.held(("tokenizer", path), lambda: WordTokenizer(path))
