"""Rule patterns: flag hoisting, Python-to-Java dialect, required literals, keyword gate.

Rule files are written for Python's ``re``; Spark runs ``java.util.regex``. Everything in this
module works on a few hundred short pattern strings on the driver, but for ``python_search`` and
``python_span``: patterns that could overflow the JVM's stack are run by Python's engine, in Arrow
batches and on texts whose gate opened.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.functions.text import sql_literal

try:  # the parse tree of ``re`` is only used to speed scans up; without it rules run ungated
    from re import _constants as _sc
    from re import _parser as _sp
except ImportError:  # pragma: no cover
    _sc = _sp = None

# Inline flags that are moved to the front of a pattern, in this order.
MODIFIERS = ("(?i)", "(?m)", "(?s)", "(?x)", "(?g)", "(?u)", "(?A)", "(?L)", "(?U)")

_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "lower": r"\p{Lower}",
    "upper": r"\p{Upper}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}",
    "word": r"\w", "blank": r"\p{Blank}", "print": r"\p{Print}", "graph": r"\p{Graph}",
    "cntrl": r"\p{Cntrl}", "ascii": r"\p{ASCII}",
}
_POSIX_PY = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z",
    "space": r"\s", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "word": r"\w",
    "blank": r" \t", "print": " -~", "graph": "!-~", "cntrl": r"\x00-\x1f\x7f", "ascii": r"\x00-\x7f",
}


def hoist_flags(pattern: str) -> str:
    """Move an inline flag that stands later than the start to the front of the pattern."""
    for flag in MODIFIERS:
        if pattern.find(flag) > 0:
            pattern = flag + pattern.replace(flag, "")
    return pattern


def hoist_inline_flags(pattern: Column) -> Column:
    """Column form of :func:`hoist_flags`; a fold, so the expression stays linear in the flags."""
    return F.aggregate(
        F.array(*[F.lit(m) for m in MODIFIERS]),
        pattern,
        lambda acc, flag: F.when(
            F.position(flag, acc) > 1, F.concat(flag, F.replace(acc, flag, F.lit("")))
        ).otherwise(acc),
    )


class UnsupportedPattern(ValueError):
    """The pattern has no equivalent in the JVM's regex engine."""


def python_form(pattern: str) -> str:
    """The pattern as Python's ``re`` accepts it: ``\\z`` and POSIX classes are honoured."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(r"\Z" if pattern[i + 1] == "z" and not in_class else pattern[i : i + 2])
            i += 2
            continue
        if in_class and c == "[" and (m := re.match(r"\[:(\w+):\]", pattern[i:])) and m[1] in _POSIX_PY:
            out.append(_POSIX_PY[m[1]])
            i += m.end()
            continue
        if c == "[" and not in_class:
            in_class = True
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            if pattern[j : j + 1] == "]":
                j += 1
            out.append(pattern[i:j])
            i = j
            continue
        if c == "]":
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def java_form(pattern: str, unicode_classes: bool = True) -> str:
    """Rewrite a Python pattern for ``java.util.regex`` keeping its meaning.

    ``(?d)`` makes ``.``, ``^`` and ``$`` see only ``\\n``; ``U``/``u`` give the Unicode meaning
    of ``\\w \\b \\d \\s`` and of case folding that ``re`` has on text.
    """
    out: list[str] = []
    names: dict[str, str] = {}
    i, in_class, class_start = 0, False, -1
    shorthand = False
    verbose = bool(re.search(r"\(\?[a-zA-Z]*x", pattern))
    n = len(pattern)

    def group_name(name: str) -> str:
        return names.setdefault(name, "".join(ch for ch in name if ch.isalnum()) + f"g{len(names)}")

    while i < n:
        c = pattern[i]
        rest = pattern[i:]
        if c == "\\":
            if i + 1 >= n:
                raise UnsupportedPattern("trailing backslash")
            e = pattern[i + 1]
            if e in "wWbBdDsS":
                shorthand = True
            if e == "b" and in_class:
                out.append(r"\x08")
            elif e == "Z":
                out.append(r"\z")
            elif e == "v":
                out.append(r"\x0B")
            elif e == "U":
                out.append(r"\x{%s}" % pattern[i + 2 : i + 10])
                i += 8
            elif m := re.match(r"0[0-7]{0,2}|[0-3][0-7]{2}" + ("|[0-7]{1,3}" if in_class else ""), pattern[i + 1 :]):
                out.append(r"\x{%x}" % int(m[0], 8))
                i += m.end() - 1
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if c == "]" and i > class_start:
                in_class = False
                out.append(c)
            elif c == "[":
                m = re.match(r"\[:(\w+):\]", rest)
                if m and m[1] in _POSIX:
                    out.append(_POSIX[m[1]])
                    i += m.end()
                    continue
                out.append(r"\[")
            elif c == "]":
                out.append(r"\]")
            elif c == "&" and rest.startswith("&&"):
                out.append(r"\&")
            elif verbose and (c.isspace() or c == "#"):
                out.append("\\x%02X" % ord(c))
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            class_start = i
            continue
        if c == "(" and rest.startswith("(?"):
            if m := re.match(r"\(\?P<(\w+)>", rest):
                out.append(f"(?<{group_name(m[1])}>")
                i += m.end()
                continue
            if m := re.match(r"\(\?P=(\w+)\)", rest):
                out.append(f"\\k<{group_name(m[1])}>")
                i += m.end()
                continue
            if rest.startswith("(?#"):
                i = pattern.index(")", i) + 1
                continue
            if rest.startswith("(?("):
                raise UnsupportedPattern("conditional group")
        if c == "{":
            m = _QUANTIFIER.match(rest)
            if m and (m[1] or m[3]):
                out.append("{%s%s%s}" % (m[1] or "0", m[2], m[3]))
                i += m.end()
                continue
            out.append(r"\{")
            i += 1
            continue
        out.append(c)
        i += 1
    body = "".join(out)
    flags = "d"
    if unicode_classes and not re.search(r"\(\?[a-z]*a", pattern):
        if shorthand:
            flags += "U"
        elif re.search(r"\(\?[a-z]*i", pattern):
            flags += "u"
    body = re.sub(r"\(\?a\)", "", body)
    return f"(?{flags}){body}"


def tail_form(java_pattern: str) -> str:
    """Pattern whose last group holds everything after the first match."""
    newline = "\n" if re.search(r"\(\?[a-zA-Z]*x", java_pattern) else ""
    return f"(?:{java_pattern}{newline})((?s:.*))"


# --- literals every match must contain ---------------------------------------------------------

_MAX_SET = 48


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda s: (min(map(_rareness, s)), -len(s)))


def _rareness(literal: str) -> int:
    """How seldom a literal should turn up in a text."""
    return sum(30 + _rarity(c) for c in set(literal[:8]))


def _char_set(items) -> frozenset[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is _sc.LITERAL:
            codes = [arg]
        elif op is _sc.RANGE and arg[1] - arg[0] < 8:
            codes = range(arg[0], arg[1] + 1)
        else:
            return None
        if any(code > 127 for code in codes):
            return None
        chars.update(chr(code).lower() for code in codes)
    return frozenset(chars) if len(chars) <= 4 else None


@dataclass
class _Facts:
    """What is known of the strings a part of a pattern matches."""

    exact: frozenset[str] | None = None  # all of them
    head: frozenset[str] | None = None  # each begins with one of these
    need: frozenset[str] | None = None  # each contains one of these

    def starts(self) -> frozenset[str] | None:
        return self.exact if self.exact is not None else self.head


def _cross(a: frozenset[str], b: frozenset[str] | None) -> frozenset[str] | None:
    if b is None or len(a) * len(b) > _MAX_SET:
        return None
    return frozenset(x + y for x in a for y in b)


def _walk(seq) -> _Facts:
    current: frozenset[str] = frozenset([""])
    head, need = None, None

    def flush(strings: frozenset[str] | None) -> None:
        nonlocal need
        if strings and "" not in strings:
            need = _better(need, strings)

    for op, arg in seq:
        item = _node(op, arg)
        grown = _cross(current, item.exact)
        if grown is not None:
            current = grown
            continue
        flush(current)
        ahead = _cross(current, item.starts())
        flush(ahead)
        flush(item.exact)
        if head is None:
            head = ahead or current
        need = _better(need, item.need)
        current = frozenset([""])
    flush(current)
    return _Facts(current if head is None else None, current if head is None else head, need)


def _node(op, arg) -> _Facts:
    if op is _sc.LITERAL:
        return _Facts(frozenset([chr(arg).lower()])) if arg < 128 else _Facts()
    if op is _sc.IN:
        return _Facts(_char_set(arg))
    if op in (_sc.AT, _sc.ASSERT, _sc.ASSERT_NOT):
        return _Facts(frozenset([""]))
    if op is _sc.SUBPATTERN:
        return _walk(arg[3])
    if op is getattr(_sc, "ATOMIC_GROUP", None):
        return _walk(arg)
    if op is _sc.BRANCH:
        parts = [_walk(branch) for branch in arg[1]]
        return _Facts(
            _union(p.exact for p in parts),
            _union(p.starts() for p in parts),
            _union(_better(p.need, p.exact if p.exact and "" not in p.exact else None) for p in parts),
        )
    if op in (_sc.MAX_REPEAT, _sc.MIN_REPEAT, getattr(_sc, "POSSESSIVE_REPEAT", None)):
        low, high, body = arg
        part = _walk(body)
        if low == 0:
            return _Facts(part.exact | {""} if high == 1 and part.exact is not None else None)
        if part.exact is not None and low == high and len(part.exact) == 1 and low <= 32:
            return _Facts(frozenset([next(iter(part.exact)) * low]))
        return _Facts(None, part.starts(), part.need)
    return _Facts()


def _union(sets) -> frozenset[str] | None:
    out: set[str] = set()
    for s in sets:
        if not s:
            return None
        out |= s
    return frozenset(out) if 0 < len(out) <= _MAX_SET else None


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII strings of which every match contains at least one, in some letter case.

    ``None`` when the pattern promises nothing. Read off the parse tree of the pattern itself, so
    unlike declared keywords a rule can never lose a match by it.
    """
    if _sp is None:
        return None
    try:
        facts = _walk(_sp.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None
    need = facts.need
    for strings in (facts.exact, facts.head):
        if strings and "" not in strings:
            need = _better(need, strings)
    if need is None:
        return None
    short = {_shorten(x) for x in need}
    return frozenset(x for x in short if not any(y != x and y in x for y in short))


def _shorten(literal: str) -> str:
    """At most eight characters of the literal, around its rarest one."""
    at = _anchor(literal)
    start = max(0, min(at - 3, len(literal) - 8))
    return literal[start : start + 8]


# --- patterns that the JVM's engine cannot run on every text -----------------------------------

_DEEP = 64  # repeats of a group that the JVM may nest without harm
_CLOSED = re.compile(r"[*+]|\{(\d*)(,?)(\d*)\}")


def may_nest(pattern: str) -> bool:
    """Whether a long text can make the JVM's engine call itself once for each repeat of a group.

    That is so for a group with alternatives or with repeats of its own inside, repeated without a small
    bound. Read off the text of the pattern; in doubt the answer is yes.
    """
    inside: list[bool] = []  # of each open group: does its body vary?
    at, verbose = 0, "(?x" in pattern
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if c == "[":
            at += 1 + (pattern[at + 1 : at + 2] == "^")
            at += pattern[at : at + 1] == "]"
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
        elif c == "(":
            inside.append(False)
            if pattern[at + 1 : at + 2] == "?":  # what follows is no quantifier
                at += 1
        elif c == ")" and inside:
            varies = inside.pop()
            found = _CLOSED.match(pattern, at + 1)
            if found:
                most = found[3] if found[2] else found[1]
                if (varies or verbose) and (found[0] in "*+" or not most or int(most) > _DEEP):
                    return True
            if inside:
                inside[-1] = inside[-1] or varies or bool(found) or pattern[at + 1 : at + 2] == "?"
        elif inside and (c in "|*+?" or c == "{" and (found := _QUANTIFIER.match(pattern, at)) and found[2]):
            inside[-1] = True
        at += 1
    return False


_SPAN = T.StructType(
    [T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]
)


@cache
def _compiled(pattern: str) -> re.Pattern:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        return re.compile(pattern)


@F.pandas_udf(T.BooleanType())
def python_search(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether a pattern, in Python's form, is found; null texts are not searched."""
    return pd.Series([None if t is None else _compiled(p).search(t) is not None for t, p in zip(texts, patterns)], dtype=object)


@F.pandas_udf(_SPAN)
def python_span(texts: pd.Series, patterns: pd.Series, groups: pd.Series) -> pd.DataFrame:
    """Begin, end and text of a group in the first match, in characters; nulls where there is none."""
    out = []
    for text, pattern, group in zip(texts, patterns, groups):
        found = _compiled(pattern).search(text) if text is not None and pattern is not None else None
        known = found is not None and group <= found.re.groups and found.start(int(group)) >= 0
        out.append((*found.span(int(group)), found[int(group)]) if known else (None, None, None))
    frame = pd.DataFrame(out, columns=["begin", "end", "text"])
    return frame.astype({"begin": "Int32", "end": "Int32"})


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def register_python_search(spark: SparkSession) -> None:
    """Make the two functions known to SQL expressions, where patterns that need them are used.

    Batches of texts are kept small, unless the session has a size of its own: several workers of each core hold one, as Arrow data
    and as strings, and at Spark's default of 64 MB their memory grows with the tasks' input until all batches are full.
    """
    if spark.conf.get(BATCH_BYTES, None) in (None, str(64 << 20), f"{64 << 20}b", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    spark.udf.register("leaksieve_search", python_search)
    spark.udf.register("leaksieve_span", python_span)


# --- one pass over a text that finds all required literals -------------------------------------

# Characters from common to rare in text, markup and code; any other counts as rarer.
_BY_FREQUENCY = " etaonirslhdcu.mpf-gwy/:\"=<>bv0123456789,k'()x_jqz"
# Non-ASCII characters that equal an ASCII letter when case is ignored, and those letters.
_FOLDED = ("ſıİK", "siik")


def _rarity(c: str) -> int:
    i = _BY_FREQUENCY.find(c)
    return len(_BY_FREQUENCY) if i < 0 else i


def _anchor(literal: str) -> int:
    return max(range(len(literal)), key=lambda j: (_rarity(literal[j]), -j))


def _any_case(c: str) -> str:
    if c.isalpha():
        return f"[{c}{c.upper()}]"
    return c if c.isalnum() else "\\" + c


def _any_of(chars: Iterable[str]) -> str:
    return "[" + "".join(h[1:-1] if h[0] == "[" else h for h in map(_any_case, chars)) + "]"


def _dispatch(alternatives: Mapping[str, str]) -> str:
    """Alternatives keyed by their first character, as a tree of look-aheads."""
    keys = list(alternatives)
    if len(keys) <= 2:
        return "|".join(alternatives[k] for k in keys)
    cut = max(1, len(keys) // 3)
    parts = ({k: alternatives[k] for k in ks} for ks in (keys[:cut], keys[cut:]))
    return "|".join(f"(?={_any_of(part)})(?:{_dispatch(part)})" for part in parts)


def ascii_folded(text: Column) -> Column:
    """The text with every character that equals an ASCII letter, case ignored, turned into it.

    Such characters are rare: a text of as many bytes as characters has none, others are searched.
    """
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _FOLDED[0]])
    return F.when((F.octet_length(text) > F.length(text)) & odd, F.translate(text, *_FOLDED)).otherwise(text)


@dataclass(frozen=True)
class Gate:
    """One regex over the text, the literals each of its labels stands for, and each rule's literals."""

    pattern: str | None
    by_label: Mapping[str, tuple[str, ...]]
    by_rule: Mapping[int, tuple[str, ...]]

    def found(self, text: Column) -> Column:
        """Literals that occur in the text."""
        table = F.from_json(F.lit(json.dumps(self.by_label)), "map<string,array<string>>")

        def literals(folded: Column) -> Column:
            labels = F.array_distinct(F.regexp_extract_all(folded, F.lit(self.pattern), F.lit(1)))
            return F.flatten(F.transform(labels, lambda x: F.element_at(table, F.lower(x))))

        def confirmed(folded: Column) -> Column:
            # one-element arrays bind a value once for all candidates
            low = F.array(F.lower(folded))
            return F.transform(low, lambda t: F.filter(literals(folded), lambda x: F.contains(t, x)))[0]

        return F.transform(F.array(ascii_folded(text)), confirmed)[0]

    def opens(self, key: int, found: str) -> str | None:
        """SQL for whether the rule has to be tried, or ``None`` when it always has to be."""
        literals = [sql_literal(x) for x in self.by_rule.get(key, ())]
        if not literals:
            return None
        if len(literals) == 1:
            return f"array_contains({found}, {literals[0]})"
        return f"arrays_overlap({found}, array({', '.join(literals)}))"


def build_gate(required: Mapping[int, Iterable[str] | None]) -> Gate:
    """Build the gate for rules keyed by number.

    The regex engine tests one character class at most positions: each literal is looked up from
    its rarest character, forwards for the rest and backwards for the start. The label of a
    literal is its text from that character on. Matches are zero-width, so overlapping literals
    are all seen; where several end up at one position the longest label wins, hence a label
    stands for every literal whose own label it begins with.
    """
    literals = sorted({x for xs in required.values() if xs for x in xs})
    if not literals:
        return Gate(None, {}, {})
    label: dict[str, str] = {}
    by_anchor: dict[str, dict[str, list[str]]] = {}
    for lit in literals:
        at = _anchor(lit)
        label[lit] = lit[at:]
        by_anchor.setdefault(lit[at], {}).setdefault(lit[at + 1 :], []).append(lit[:at])
    alternatives = {}
    for anchor in sorted(by_anchor, key=_rarity):
        head = _any_case(anchor)
        tails = []
        for rest in sorted(by_anchor[anchor], key=len, reverse=True):
            tail = "".join(map(_any_case, rest))
            starts = by_anchor[anchor][rest]
            if "" not in starts:
                behind = "|".join("".join(map(_any_case, s)) for s in starts)
                tail += f"(?<=(?:{behind}){head}{tail})"
            tails.append(tail)
        alternatives[anchor] = f"{head}(?:{'|'.join(tails)})"
    pattern = f"(?={_any_of(alternatives)})(?=({_dispatch(alternatives)}))"
    by_label = {u: tuple(x for x in literals if u.startswith(label[x])) for u in set(label.values())}
    return Gate(pattern, by_label, {key: tuple(sorted(xs)) for key, xs in required.items() if xs})
