"""The scan of one text in plain Python, to check the Spark operators against."""

import re

from leaksieve.functions.regex import hoist_flags, python_form


def find(pattern, text):
    pattern = python_form(hoist_flags(pattern))
    try:
        return re.search(pattern, text)
    except re.error:
        try:
            return re.search(pattern.replace("(?i)", ""), text, re.I)
        except re.error:
            return None


def window(text, begin, end, middle, chars):
    return text[max(begin - chars, 0) : begin] + middle + text[end : end + chars]


def scan(rules, text):
    """(rule number, secret, line, sanitized, mocked, begin) of the first accepted rule."""
    for i, rule in enumerate(rules):
        m = find(rule.regex, text)
        if not m or any(find(r, text) for a in rule.allowlists if a.applied for r in a.regexes):
            continue
        begin, end = m.span()
        mock = "<REDACTED>" if rule.example is None else rule.example
        mocked = text.replace(m[0], mock)
        if len(mocked) > 10000 or m[0].lower() in mocked.lower():
            mocked = window(text, begin, end, mock or "<REDACTED>", 2000 if mock else 20)
        sanitized = window(text, begin, end, "<REDACTED>", 20)
        return i, m[0], text[:begin].count("\n") + 1, sanitized, mocked, begin
    return None
