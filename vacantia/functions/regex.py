"""Python-flavoured rule patterns as Spark predicates.

Profiles are written for Python's ``re`` with IGNORECASE. Spark runs Java patterns, so every
pattern gets the flags that give the same meaning: ``i``/``u`` Unicode case folding, ``U``
Unicode classes for ``\\s \\d \\w \\b``, ``d`` so that only ``\\n`` ends a line.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

FLAGS = "(?iuUd)"

_NAMED_GROUP = re.compile(r"\(\?P<[^>]+>")
_WORD = re.compile(r"[A-Za-z0-9 ,;:_@/'\"<>=%&~`!#-]+")
_GLOBAL_FLAGS = re.compile(r"\(\?[aiLmsux]+\)")
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_BACK_REFERENCE = re.compile(r"(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=")


class PatternError(ValueError):
    """A rule pattern that cannot be used."""


def java_pattern(pattern: str) -> str:
    """Rewrite one Python pattern to Java syntax, without flags."""
    if _GLOBAL_FLAGS.search(pattern):
        raise PatternError(f"inline flags are not supported: {pattern!r}")
    if "(?P=" in pattern:
        raise PatternError(f"named back references are not supported: {pattern!r}")
    pattern = _NAMED_GROUP.sub("(", pattern)
    out, in_class, at = [], False, 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\" and at + 1 < len(pattern):
            pair = pattern[at:at + 2]
            out.append(r"\z" if pair == r"\Z" and not in_class else pair)
            at += 2
            continue
        if in_class:
            # Java reads a nested '[' or '&&' as set algebra; Python reads them as characters.
            if ch == "[" or ch == "&":
                out.append("\\")
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            out.append(ch)
            at += 1
            if pattern[at:at + 1] == "^":
                out.append("^")
                at += 1
            if pattern[at:at + 1] == "]":
                out.append("\\]")
                at += 1
            continue
        elif ch == "{":
            # A brace that bounds nothing is a character in Python; an open lower bound is 0.
            bounds = _QUANTIFIER.match(pattern, at)
            if bounds is None or bounds.group(0) == "{}":
                out.append("\\{")
                at += 1
            else:
                out.append(f"{{{bounds.group(1) or 0}{bounds.group(2)}{bounds.group(3)}}}")
                at = bounds.end()
            continue
        out.append(ch)
        at += 1
    return "".join(out)


def any_of(patterns: Sequence[str]) -> str:
    """One Java pattern that finds any of ``patterns``."""
    return FLAGS + "|".join(f"(?:{java_pattern(p)})" for p in patterns)


def folded(col: Column) -> Column:
    """Text in which ASCII letters are lower case, so that a plain word is found by ``contains``.

    The three letters that Python's IGNORECASE equates with ``s`` and ``i`` are mapped too.
    """
    return F.lower(F.translate(F.coalesce(col, F.lit("")), "\u017f\u0131\u0130", "sii"))


def plain_words(pattern: str) -> list[str] | None:
    """The words of a pattern that is nothing but ASCII words separated by ``|``; None for any other pattern."""
    words = pattern.split("|")
    return [w.lower() for w in words] if all(_WORD.fullmatch(w) for w in words) else None


def any_match(patterns: Sequence[str] | None, col: Column, folded_col: Column | None = None) -> Column:
    """True when any pattern is found in ``col``; null text counts as empty, no patterns as false.

    With ``folded_col`` (``folded(col)``, computed once for all rules) plain words are searched there
    without a regular expression, which is many times faster on long texts.
    """
    if not patterns:
        return F.lit(False)
    text = F.coalesce(col, F.lit(""))
    tests, single, combined = [], [], []
    for pattern in patterns:
        words = plain_words(pattern) if folded_col is not None else None
        if words is not None:
            tests.extend(folded_col.contains(word) for word in words)
        else:
            # Numbered references must keep their own group numbering, so those run on their own.
            (single if _BACK_REFERENCE.search(pattern) else combined).append(pattern)
    if combined:
        tests.append(text.rlike(any_of(combined)))
    tests.extend(text.rlike(FLAGS + java_pattern(p)) for p in single)
    return reduce(or_, tests)
