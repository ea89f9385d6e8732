"""Main text of web pages by wrappers: union-free expressions inferred from the pages of each host.

A page is a stream of tags and texts. Neighbouring repeats in it fold into repeated groups; the distinct folded
streams of a host are aligned one after another, and what only some of them have becomes optional. The
result, a wrapper, is a sequence of tags, text slots, optional and repeated parts. A slot whose text is the same
on nearly all pages that have it is part of the template: each slot counts for its most frequent text and against it, so a page
or two with another text change nothing. A page is aligned with its host's wrapper: blocks of template
text go, others stay if they lie where article text may be. Parts that the wrapper lacks are slots of that page.
Nothing inside a main element is template, nor is a heading that stands before text of the page in its parent.

Streams are aligned at what only occurs once in both: first equal texts, then tags, so long pages cost little more than
their length. What lies between such anchors is compared symbol by symbol.

Where article text may be, elements and their names say. Words in names are hints: a part they mark is in again if it holds a
main element or the heading, and more text than is left without it, or if nothing but template is left
without it. Words that also name containers of articles need no more than another word for content, or nearly all text. A
page of which all is template keeps what the names allow, as do hosts without two different pages.

Only folded streams are gathered by host, reduced before they are shuffled, so a host with most pages costs
no more than others. A wrapper is inferred from all distinct streams of its host: the ``most_streams`` most frequent ones first, the
others in groups of about as many, whose wrappers are then aligned, as many at once, until one is left.

Defined cases: a null or empty page has the empty text; a null or odd url is the host ``''``; every
row is extracted on its own, so repeated rows and ids need no care; extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.session import materialise

TEXT = "#"
# elements that hold no article text
OUTSIDE = frozenset(
    "head nav footer aside script style noscript template iframe button select textarea svg canvas audio video"
    " object menu dialog math map datalist".split()
)
# elements that mark their contents no more than a word does
HINTS = frozenset(("form", "header"))
# contents that are no markup
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
# those of the words below that also name containers of articles, and words for content beside them
WEAK = frozenset(
    "search share sharing social related header masthead banner alert notice notices popup modal overlay toolbar"
    " subscribe subscription".split()
)
CONTENT = frozenset("content contents article post entry story text body page container wrapper".split())
# words of class, id and role names that mark a part as not article
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent gdpr popup modal"
    " overlay newsletter subscribe subscription signup login search share sharing social related recommended"
    " recommendations comment comments respond reply replies disqus pagination pager toolbar complementary contentinfo"
    " alert disclaimer".split()
)

# A quote that is not closed before a blank, a slash or the tag's end is no quote: the tag ends at the next bracket.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)/?>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(frozen=True)
class WrapperOptions:
    #: streams, or wrappers, that one task aligns at once
    most_streams: int = 64
    #: longest group that folds
    longest_group: int = 12
    #: different pages that make equal text a template
    least_pages: int = 2
    #: how far a slot's most frequent text has to be ahead of all others, as a share of its pages
    lead: float = 0.8


#: different pages are counted by the least and greatest hash in each bucket
BUCKETS = 16
SMALL = 1 << 10  # pairs of places between anchors that are compared one by one


@dataclass
class Stream:
    """Symbols of a page with, for texts, their content."""

    symbols: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)

    def add(self, symbol: str, text: str | None = None) -> None:
        self.symbols.append(symbol)
        self.texts.append(text)


def tokenise(page: str) -> Stream:
    """Tags as ``name.classes`` and ``/name``, texts as ``#``; comments and raw contents go."""
    out, at, size = Stream(), 0, len(page)

    def text(low: int, high: int) -> None:
        if low < high and not page[low:high].isspace():
            out.add(TEXT, page[low:high])
        elif low < high and out.symbols and out.symbols[-1] == TEXT:
            out.texts[-1] += " "
        elif low < high:
            out.add("_", page[low:high])  # blanks between tags: no part of the structure

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(at, size)
            break
        text(at, found.start())
        at = found.end()
        closes, name, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if closes:
            if name not in VOID:
                out.add("/" + name)
            continue
        names = []
        for attribute in _NAMED.finditer(attributes):
            value = attribute[2] or attribute[3] or attribute[4] or ""
            names += re.findall(r"[a-z]+", value.lower())
        out.add(name + "".join("." + n for n in names))
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else size
    return out


def fold(symbols: list[str], longest: int) -> tuple[list[str], list[int], list[bool]]:
    """Fold neighbouring repeats: the folded symbols, where each symbol went, and which are in a repeated group."""
    items = [(s, [i], False) for i, s in enumerate(symbols) if s != "_"]
    for size in range(1, longest + 1):
        out: list[tuple[str, list[int], bool]] = []
        at = 0
        while at < len(items):
            if len(out) >= size and at + size <= len(items):
                if all(out[k - size][0] == items[at + k][0] for k in range(size)):
                    for k in range(size):
                        symbol, where, _ = out[k - size]
                        where.extend(items[at + k][1])
                        out[k - size] = (symbol, where, True)
                    at += size
                    continue
            symbol, where, repeated = items[at]
            out.append((symbol, where, repeated))
            at += 1
        items = out
    places = [-1] * len(symbols)
    for place, (_, where, _) in enumerate(items):
        for i in where:
            places[i] = place
    return [s for s, _, _ in items], places, [r for _, _, r in items]


@dataclass
class _Part:
    """An element of a stream."""

    up: int
    name: str
    hard: bool
    hint: bool
    main: bool
    weak: bool = False
    content: bool = False
    lead: bool = False
    lifted: bool = False
    size: int = 0
    #: size without template
    own: int = 0


def _parts(symbols: list[str]) -> tuple[list[_Part], list[int]]:
    """The elements, and the innermost one of each symbol; -1 is none."""
    parts: list[_Part] = []
    stack: list[int] = []
    where = []
    for symbol in symbols:
        name, _, names = symbol.partition(".")
        if name.startswith("/"):
            name = name[1:]
            at = next((k for k in reversed(range(len(stack))) if parts[stack[k]].name == name), None)
            # a stray end of an inline element or paragraph never closes the parts around it
            loose = name in INLINE or name == "p"
            if at is not None and (not loose or all(parts[k].name in INLINE or parts[k].name == "p" for k in stack[at:])):
                del stack[at:]
        elif name not in (TEXT, "_") and name not in VOID:
            if name not in INLINE:  # a block ends an open paragraph
                while stack and (parts[stack[-1]].name in INLINE or parts[stack[-1]].name == "p"):
                    stack.pop()
            words = set(names.split(".")) if names else set()
            up = stack[-1] if stack else -1
            main = name in MAIN or bool(words & {"main", "articlebody"})
            hint = name not in ("html", "body") and bool(words & MARKS) or name in HINTS
            if name == "header" and not words & MARKS:  # a header inside a main element is part of it
                at = up
                while at >= 0 and not parts[at].main:
                    at = parts[at].up
                hint = at < 0
            stack.append(len(parts))
            parts.append(_Part(up, name, name in OUTSIDE, hint, main, words & MARKS <= WEAK, bool(words & CONTENT)))
        where.append(stack[-1] if stack else -1)
    return parts, where


def article_slots(symbols: list[str], sizes: list[int] | None = None, template: list[bool] | None = None) -> list[int]:
    """For each symbol: 2 if it lies in a main element, 1 in another place that may hold text, 0 outside the article.

    ``sizes`` are the lengths of the texts, ``template`` says which are part of the host's template.
    """
    parts, where = _parts(symbols)
    texts = [(k, where[k], sizes[k] if sizes else 1, bool(template and template[k])) for k, s in enumerate(symbols) if s == TEXT]
    hard = []
    for part in parts:
        hard.append(part.hard or part.up >= 0 and hard[part.up])
    for k, part in enumerate(parts):
        if (part.main or part.name == "h1") and not hard[k]:
            at = k
            while at >= 0 and not parts[at].lead:
                parts[at].lead = True
                at = parts[at].up
    for _, at, size, fixed in texts:
        if at >= 0 and not hard[at]:
            while at >= 0:
                parts[at].size += size
                parts[at].own += 0 if fixed else size
                at = parts[at].up
    while True:
        marks, outermost = [], []
        for k, part in enumerate(parts):
            outer = marks[part.up] if part.up >= 0 else 1
            out = part.hint and not part.lifted
            marks.append(0 if hard[k] or out or not outer else 2 if part.main else outer)
            if out and outer and not hard[k]:
                outermost.append(part)
        left = [(size, fixed) for _, at, size, fixed in texts if at < 0 or marks[at]]
        total, only_template = sum(size for size, _ in left), all(fixed for _, fixed in left)
        lifted = [
            x
            for x in outermost
            if (x.lead or x.weak and x.content) and x.size > total
            or x.weak and x.size > 10 * total
            or only_template and x.own > total
        ]
        if not lifted:
            return [marks[at] if at >= 0 else 1 for at in where]
        most = max(x.size for x in lifted)  # one at a time: what it holds counts for the others
        next(x for x in lifted if x.size == most).lifted = True


def _keys(symbols: list[str], marks: list[int]) -> list[tuple[str, int]]:
    """What aligns: equal symbols in places of one kind."""
    return list(zip(symbols, marks))


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs by their first number, most whose second numbers rise as well."""
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _single(keys: list, low: int, high: int) -> dict:
    """Where the keys are that occur once in a stretch."""
    places: dict = {}
    for k in range(low, high):
        places[keys[k]] = -1 if keys[k] in places else k
    return places


def align(one: list[tuple], two: list[tuple], one_hash: list, two_hash: list) -> list[tuple[int, int]]:
    """Pairs of places that match, in order. Hashes are those of texts, where they are known."""
    strong = [list(zip(keys, hashes)) for keys, hashes in ((one, one_hash), (two, two_hash))]
    out, todo = [], [(0, len(one), 0, len(two), 0)]
    while todo:
        a, b, c, d, level = todo.pop()
        while a < b and c < d and one[a] == two[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= SMALL:
            for x, y, n in SequenceMatcher(None, one[a:b], two[c:d], autojunk=False).get_matching_blocks():
                out += [(a + x + k, c + y + k) for k in range(n)]
            continue
        keys = strong if level == 0 else (one, two)
        here, there = _single(keys[0], a, b), _single(keys[1], c, d)
        # texts without a hash are no anchors, nor are tags while there are texts
        anchors = [
            (i, j)
            for key, i in here.items()
            if i >= 0 and (j := there.get(key, -1)) >= 0 and (level or one[i][0] == TEXT and one_hash[i])
        ]
        anchors = _longest_rising(sorted(anchors))
        if not anchors:
            if level == 0:
                todo.append((a, b, c, d, 1))
            continue
        for i, j in anchors:
            out.append((i, j))
            todo.append((a, i, c, j, level))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d, level))
    return sorted(out)


def generalise(wrapper: dict, other: dict) -> dict:
    """Align a wrapper with that of one more folded stream.

    Both sides of a mismatch stay, one after another, so tags of the result need not pair. Marks are therefore those
    that symbols have in their own streams. Of two texts for a slot the more frequent one stays, and what it leads by.
    """
    out: dict[str, list] = {name: [] for name in wrapper}
    one, two = (_keys(w["symbols"], w["marks"]) for w in (wrapper, other))
    a = c = 0
    for i, j in [*align(one, two, wrapper["text"], other["text"]), (len(one), len(two))]:
        for name in out:
            out[name] += wrapper[name][a:i] + other[name][c:j]
        if gap := i - a + j - c:
            out["optional"][-gap:] = [True] * gap
        a, c = i + 1, j + 1
        if i == len(one):
            break
        for name in ("symbols", "marks"):
            out[name].append(wrapper[name][i])
        out["optional"].append(wrapper["optional"][i] or other["optional"][j])
        out["repeated"].append(wrapper["repeated"][i] or other["repeated"][j])
        for name in ("pages", "different"):
            out[name].append(wrapper[name][i] + other[name][j])
        (x, m), (y, n) = ((w["text"][k], w["ahead"][k]) for w, k in ((wrapper, i), (other, j)))
        out["text"].append(x if m >= n else y)
        out["ahead"].append(m + n if x == y else max(m, n))
    return out


def merge(streams: list[tuple]) -> dict:
    """What folded streams have in common, in their order.

    A stream is ``symbols, repeated`` and, if known, ``marks``, each symbol's most frequent text, as a hash, the pages it
    leads by, and the numbers of pages and of different pages.
    """
    wrapper: dict | None = None
    for symbols, repeated, *known in streams:
        marks, text, ahead, pages, different = known or (article_slots(symbols), [0] * len(symbols), [0] * len(symbols), 0, 0)
        one = {"symbols": symbols, "marks": marks, "optional": [False] * len(symbols), "repeated": repeated, "text": text, "ahead": ahead}
        one |= {"pages": [pages] * len(symbols), "different": [different] * len(symbols)}
        wrapper = generalise(wrapper, one) if wrapper else one
    return wrapper


def settle(wrapper: dict, options: WrapperOptions = WrapperOptions()) -> dict:
    """Add ``fixed``: the hash of each text that is part of the template."""
    wrapper["fixed"] = [
        text if s == TEXT and mark != 2 and different >= options.least_pages and ahead >= options.lead * pages else None
        for s, mark, text, ahead, pages, different in zip(
            *(wrapper[name] for name in ("symbols", "marks", "text", "ahead", "pages", "different"))
        )
    ]
    return wrapper


def infer(streams: list[tuple], options: WrapperOptions = WrapperOptions()) -> dict:
    """The wrapper of folded streams, see :func:`merge` and :func:`settle`."""
    return settle(merge(streams), options)


def expression(wrapper: dict) -> str:
    """The wrapper as an expression: ``( )?`` around optional, ``( )+`` around repeated stretches."""
    out, open_as = [], ""
    for symbol, optional, repeated in zip(wrapper["symbols"], wrapper["optional"], wrapper["repeated"]):
        wanted = "+" * repeated + "?" * optional
        if wanted != open_as:
            out += [")" + open_as] * bool(open_as) + ["("] * bool(wanted)
            open_as = wanted
        out.append(symbol)
    return " ".join(out + [")" + open_as] * bool(open_as))


def _fixed(symbols: list[str], marks: list[int], wrapper: dict, hashes: list[int] | None = None) -> list[int | None]:
    """For each symbol of a folded stream, the hash of the wrapper's template text it aligns with."""
    out: list[int | None] = [None] * len(symbols)
    one, two = _keys(wrapper["symbols"], wrapper["marks"]), _keys(symbols, marks)
    for i, j in align(one, two, wrapper["fixed"], hashes or [None] * len(symbols)):
        out[j] = wrapper["fixed"][i]
    return out


def _blocks(symbols: list[str]) -> Iterator[tuple[str, list[int]]]:
    """The texts between tags that are not inline, and the tag before them."""
    before, block = "", []
    for k, symbol in enumerate(symbols):
        name = symbol.partition(".")[0]
        if symbol == TEXT:
            block.append(k)
        elif name.lstrip("/") not in INLINE:
            if block:
                yield before, block
            before, block = name, []
    if block:
        yield before, block


def _kept(symbols, wrapper, marks=None, sizes=None, hashes=None, fixed=None) -> list[bool]:
    """Which texts of a folded stream stay. Without ``hashes`` of its texts none counts as template."""
    marks = marks or article_slots(symbols, sizes)
    texts = [k for k, s in enumerate(symbols) if s == TEXT]
    template = [False] * len(symbols)
    if hashes:
        fixed = fixed or _fixed(symbols, marks, wrapper, hashes)
        blocks = list(_blocks(symbols))
        same = [before != "h1" and all(fixed[k] is not None and fixed[k] == hashes[k] for k in block) for before, block in blocks]
        if any(same):
            parts, where = _parts(symbols)
            for n, (before, block) in enumerate(blocks):
                if same[n] and not (before in HEADINGS and n + 1 < len(blocks) and not same[n + 1] and _follows(parts, where, block, blocks[n + 1][1])):
                    for k in block:
                        template[k] = True
        if any(template) and all(template[k] for k in texts if marks[k]):
            marks = article_slots(symbols, sizes, template)
    least = 2 if any(marks[k] == 2 for k in texts) else 1
    inside = [s == TEXT and m >= least for s, m in zip(symbols, marks)]
    keep = [k and not t for k, t in zip(inside, template)]
    return keep if any(keep) else inside


def _follows(parts: list[_Part], where: list[int], heading: list[int], block: list[int]) -> bool:
    """Whether a block lies in the parent of the heading before it, other than the whole page."""
    at = where[heading[0]]
    while at >= 0 and parts[at].name not in HEADINGS:
        at = parts[at].up
    up = parts[at].up if at >= 0 else -1
    if up < 0 or parts[up].name in ("body", "html"):
        return False
    at = where[block[0]]
    while at >= 0 and at != up:
        at = parts[at].up
    return at == up


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class _Folded:
    """A page's folded stream with the length and hash of each symbol's texts."""

    stream: Stream
    symbols: list[str]
    places: list[int]
    repeated: list[bool]
    sizes: list[int]
    hashes: list[int]
    marks: list[int]


def _folded(page: str, options: WrapperOptions) -> _Folded:
    stream = tokenise(page)
    symbols, places, repeated = fold(stream.symbols, options.longest_group)
    texts: dict[int, list[str]] = {}
    for place, symbol, text in zip(places, stream.symbols, stream.texts):
        if symbol == TEXT:
            texts.setdefault(place, []).append(text)
    sizes = [sum(map(len, texts.get(k, ()))) for k in range(len(symbols))]
    hashes = [_hash("\n".join(texts[k])) if k in texts else 0 for k in range(len(symbols))]
    return _Folded(stream, symbols, places, repeated, sizes, hashes, article_slots(symbols, sizes))


def main_text(stream: Stream, keep: list[bool], places: list[int]) -> str:
    """Blocks of the kept texts, one line each."""
    blocks, block = [], []

    def close() -> None:
        line = " ".join(html.unescape("".join(block)).split())
        if line:
            blocks.append(line)
        block.clear()

    for symbol, text, place in zip(stream.symbols, stream.texts, places):
        if symbol == "_":
            block.append(" ")
        elif symbol == TEXT:
            if keep[place]:
                block.append(text)
        elif symbol.partition(".")[0].lstrip("/") not in INLINE:
            close()
        elif symbol == "br":
            block.append(" ")
    close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _vote(texts: list[int], ahead: list[int], own: list[int], weights: list[int]) -> tuple[list[int], list[int]]:
    """Each slot's text and what it leads by, with more votes: the same text adds, another takes away."""
    out, left = [], []
    for x, m, y, n in zip(texts, ahead, own, weights):
        out.append(x if x == y or m >= n else y)
        left.append(m + n if x == y else abs(m - n))
    return out, left


def folded_streams(pages: DataFrame, options: WrapperOptions = WrapperOptions()) -> DataFrame:
    """``host, stream, n, texts, ahead, lows, highs``: the distinct folded streams of each host in each task, how many pages have
    them, the most frequent text of each symbol and the pages it leads by, and the least and greatest hash of whole pages in
    each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], list] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            hosts, streams = zip(*found) if found else ((), ())
            columns = list(zip(*found.values())) if found else [()] * 5
            kinds = (pa.int64(), *[pa.list_(pa.int64())] * 4)
            arrays = [pa.array(hosts, pa.string()), pa.array(streams, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            return pa.RecordBatch.from_arrays(arrays, names=["host", "stream", "n", "texts", "ahead", "lows", "highs"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = _folded(page or "", options)
                key = host, json.dumps([one.symbols, [int(r) for r in one.repeated], one.marks], separators=(",", ":"))
                seen = [None] * BUCKETS
                whole = _hash(" ".join(map(str, one.hashes)))
                seen[whole % BUCKETS] = whole
                votes = [1] * len(one.symbols)
                if key not in found:
                    found[key] = [1, one.hashes, votes, seen, seen]
                    held += 2 * len(votes) + len(key[1]) // 8
                else:
                    n, texts, ahead, low, high = found[key]
                    texts, ahead = _vote(texts, ahead, one.hashes, votes)
                    low = [x if y is None else y if x is None else min(x, y) for x, y in zip(low, seen)]
                    high = [x if y is None else y if x is None else max(x, y) for x, y in zip(high, seen)]
                    found[key] = [n + 1, texts, ahead, low, high]
            if held > 1 << 18:
                yield rows()
                found.clear()
                held = 0
        yield rows()

    kind = "host string, stream string, n bigint, texts array<bigint>, ahead array<bigint>, lows array<bigint>, highs array<bigint>"
    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, kind)


def _grouped_streams(found: DataFrame, most: int) -> DataFrame:
    """``id, host, part, stream, pages``: a host's most frequent streams are part 0, the others are dealt out to parts of about as many."""
    counted = materialise(found.groupBy("host", "stream").agg(F.sum("n").alias("pages")), "counted")
    order = Window.partitionBy("host").orderBy(F.desc("pages"), "stream")
    first = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("host", "stream", F.lit(0).alias("part"))
    more = counted.groupBy("host").agg(F.ceil((F.count(F.lit(1)) - most) / most).alias("more")).where("more > 0")
    dealt = F.pmod(F.xxhash64("stream"), F.greatest(F.coalesce("more", F.lit(1)), F.lit(1))).cast("int") + 1
    all_ = counted.join(first, ["host", "stream"], "left").join(more, "host", "left")
    all_ = all_.select(F.monotonically_increasing_id().alias("id"), "host", F.coalesce("part", dealt).alias("part"), "stream", "pages")
    return materialise(all_, "few")


def infer_wrappers(pages: DataFrame, options: WrapperOptions = WrapperOptions()) -> DataFrame:
    """``host, wrapper, expression``."""
    found = materialise(folded_streams(pages, options), "streams")
    few = _grouped_streams(found, options.most_streams)
    some = found.join(few.select("host", "stream", "id"), ["host", "stream"])
    votes = some.select("id", F.posexplode(F.arrays_zip("texts", "ahead")).alias("pos", "one"))
    votes = votes.groupBy("id", "pos", F.col("one.texts").alias("text")).agg(F.sum("one.ahead").alias("ahead"))
    votes = votes.groupBy("id", "pos").agg(F.max(F.struct("ahead", "text")).alias("v"))
    votes = votes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "v.text", "v.ahead"))).alias("votes"))
    seen = some.select("id", F.posexplode(F.arrays_zip("lows", "highs")).alias("pos", "one"))
    seen = seen.groupBy("id", "pos").agg(F.min("one.lows").alias("low"), F.max("one.highs").alias("high"))
    different = F.sum(F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2)).alias("different")
    seen = seen.groupBy("id").agg(different)
    by_part = few.join(votes, "id", "left").join(seen, "id")
    one = F.struct((-F.col("pages")).alias("less"), "stream", "pages", "different", "votes")
    by_part = by_part.groupBy("host", "part").agg(F.sort_array(F.collect_list(one)).alias("streams"))

    def rows(batch: pa.RecordBatch, wrappers: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(wrappers, pa.string())], names=["host", "part", "wrapper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = []
            for streams in batch.column(2).to_pylist():
                known = []
                for one in streams:
                    symbols, repeated, marks = json.loads(one["stream"])
                    votes = one["votes"] or []
                    texts, ahead = [v["text"] for v in votes], [v["ahead"] for v in votes]
                    known.append((symbols, [bool(r) for r in repeated], marks, texts, ahead, one["pages"], one["different"]))
                wrappers.append(json.dumps(merge(known), separators=(",", ":")))
            yield rows(batch, wrappers)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = []
            for parts in batch.column(2).to_pylist():
                whole = json.loads(parts[0]["wrapper"])
                for part in parts[1:]:
                    whole = generalise(whole, json.loads(part["wrapper"]))
                wrappers.append(json.dumps(whole, separators=(",", ":")))
            yield rows(batch, wrappers)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers, shown = [], []
            for wrapper in batch.column(1).to_pylist():
                wrapper = settle(json.loads(wrapper), options)
                shown.append(expression(wrapper))
                wrapper = {name: wrapper[name] for name in ("symbols", "marks", "fixed")}
                wrappers.append(json.dumps(wrapper, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(wrappers, pa.string()), pa.array(shown, pa.string())],
                names=["host", "wrapper", "expression"],
            )

    made = by_part.mapInArrow(run, "host string, part int, wrapper string")
    parts = few.agg(F.max("part")).first()[0] or 0  # the last part's number
    while parts > 0:
        made = materialise(made, "parts")
        whole = F.sort_array(F.collect_list(F.struct("part", "wrapper"))).alias("parts")
        made = made.groupBy("host", F.floor(F.col("part") / options.most_streams).cast("int").alias("part")).agg(whole)
        made = made.mapInArrow(again, "host string, part int, wrapper string")
        parts //= options.most_streams
    return made.select("host", "wrapper").mapInArrow(last, "host string, wrapper string, expression string")


def extract(pages: DataFrame, wrappers: DataFrame, options: WrapperOptions = WrapperOptions()) -> DataFrame:
    """``page_id, url, text`` by each host's wrapper."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[int | None]] = {}
        read: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one = _folded(page or "", options)
                if wrapper is None:
                    keep = _kept(one.symbols, {}, one.marks, one.sizes)
                else:
                    if wrapper not in read:
                        if len(read) > 100:
                            read.clear()
                        read[wrapper] = made = json.loads(wrapper)
                        made["some"] = frozenset(x for x in made["fixed"] if x is not None)
                    made = read[wrapper]
                    # only texts of the template are anchors, so pages that have the same of them align alike
                    hashes = tuple(x if x in made["some"] else None for x in one.hashes)
                    key = wrapper, " ".join(one.symbols), tuple(one.marks), hashes
                    if key not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[key] = _fixed(one.symbols, one.marks, made, hashes)
                    keep = _kept(one.symbols, {}, one.marks, one.sizes, one.hashes, known[key])
                texts.append(main_text(one.stream, keep, one.places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(wrappers.select("host", "wrapper"), "host", "left").select("page_id", "url", "html", "wrapper")
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def extract_pages(pages: DataFrame, options: WrapperOptions = WrapperOptions()) -> DataFrame:
    """``page_id, url, text, n_chars``. Wrappers are stored before pages meet them, so a host with most pages can be split."""
    wrappers = materialise(infer_wrappers(pages, options), "wrappers")
    texts = extract(pages, wrappers, options)
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
