"""Texts that whatever matches an expression must hold."""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser as parser

#: Least length of such a text.
LEAST = 2
#: Alternatives of one expression at most.
MOST = 64
#: What the two dialects read differently, or what changes the meaning of letters around it.
_FOREIGN = re.compile(r"\\[A-CE-RT-VX-Zace-mopqu-vy-z]|&&|\(\?[a-zA-Z-]|\[[^\]]*\[")


def required(pattern: str, fixed: bool = False, fold: bool = False) -> tuple[str, ...] | None:
    """Texts of which any match of the pattern holds one (with ``fold`` in lower case); None if none are known.

    The pattern is parsed as one of Python's; wherever Java's could mean
    something else nothing is said of it.
    """
    if fixed:
        return _worth({pattern}, fold)
    if _FOREIGN.search(pattern):
        return None
    try:
        parsed = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return _worth(_of(parsed, fold), fold)


def _worth(found: set[str] | None, fold: bool) -> tuple[str, ...] | None:
    if not found or len(found) > MOST:
        return None
    if fold:
        # What isn't ASCII folds by other rules; the longest part without it must be there as well.
        found = {max(re.split(r"[^\x00-\x7f]+", x), key=len).lower() for x in found}
    return tuple(sorted(found)) if min(map(len, found)) >= LEAST else None


def _of(items, fold: bool) -> set[str] | None:
    """The best set for a sequence: that whose shortest text is longest."""
    best: set[str] | None = None
    run = ""

    def better(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for kind, what in items:
        if kind is kinds.LITERAL:
            run += chr(what)
            continue
        if kind is kinds.AT:  # stands for no character
            continue
        if run:
            better({run})
            run = ""
        if kind is kinds.SUBPATTERN:
            better(_of(what[3], fold))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and what[0] >= 1:
            better(_of(what[2], fold))
        elif kind is kinds.ATOMIC_GROUP:
            better(_of(what, fold))
        elif kind is kinds.BRANCH:
            each = [_of(branch, fold) for branch in what[1]]
            if all(each):
                better(set().union(*each))
    if run:
        better({run})
    return best
