"""All occurrences of many words in one pass over a text.

One expression with every word in it, grouped by first letter, is tried at each place of the text; what it
finds is a small array, and conditions on words are then tests on that array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[a-z0-9_]"


class Words:
    """Lower-case words to look for; ``whole`` ones must not be part of a longer one on a side where they have a letter or digit."""

    def __init__(self, words: Iterable[str], whole: bool = False) -> None:
        self.words, self.whole = sorted(set(words)), whole

    def _ends(self, w: str) -> str:
        return f"(?!{_WORD})" if self.whole and w[-1].isalnum() else ""

    def pattern(self) -> str:
        """Looks ahead, so that words which overlap are all found; of those that begin together the longest."""
        groups: dict[tuple[str, str], list[str]] = {}
        for w in sorted(self.words, key=len, reverse=True):
            before = f"(?<!{_WORD})" if self.whole and w[0].isalnum() else ""
            groups.setdefault((before, w[0]), []).append(re.escape(w[1:]) + self._ends(w))
        return "(?=(" + "|".join(f"{re.escape(first)}{before and '(?<!' + _WORD + re.escape(first) + ')'}(?:{'|'.join(rest)})" for (before, first), rest in groups.items()) + "))"

    def found(self, low: Column) -> Column:
        """Array of the words in a lower-case text."""
        return F.array_distinct(F.regexp_extract_all(low, F.lit(self.pattern()), F.lit(1)))

    def has(self, found: Column, w: str) -> Column:
        """Whether a word is there: itself, or as the beginning of a longer one that was found in its place."""
        ends = lambda x: not (self.whole and w[-1].isalnum() and re.match(_WORD, x[len(w)]))
        longer = [x for x in self.words if x != w and x.startswith(w) and ends(x)]
        return F.arrays_overlap(found, F.array(*map(F.lit, [w, *longer])))


def on(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def needed_literals(pattern: str) -> list[list[str]]:
    """Lower-case literals that every match of a pattern holds: one of each list.

    Reads literals, escapes, classes, groups and quantifiers as the signatures use them; what it cannot tell it leaves out.
    """
    branches = _split(pattern)
    if len(branches) > 1:
        best = [max((x for own in needed_literals(b) if len(own) == 1 for x in own), key=len, default="") for b in branches]
        return [best] if all(best) else []
    out: list[list[str]] = []
    run, i = "", 0

    def flush() -> None:
        nonlocal run
        if len(run) > 1:
            out.append([run.lower()])
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "(":
            flush()
            end = _closing(pattern, i)
            inner = re.sub(r"^\?:", "", pattern[i + 1 : end])
            i = end + 1
            if pattern[i : i + 1] not in ("*", "?", "{"):
                out += needed_literals(inner)
            continue
        literal = c
        if c == "\\":
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else ""
            i += 1
        elif c == "[":
            literal, i = "", pattern.index("]", i + 2)
        elif c in ".^$*+?{}":
            literal = ""
            if c == "{":
                i = pattern.index("}", i)
        i += 1
        if literal and pattern[i : i + 1] not in ("*", "?", "{"):
            run += literal
            if pattern[i : i + 1] == "+":
                flush()
        else:
            flush()
    flush()
    return out


def _closing(pattern: str, i: int) -> int:
    depth = 0
    while True:
        c = pattern[i]
        i += 1 + (c == "\\")
        depth += (c == "(") - (c == ")")
        if not depth:
            return i - 1


def _split(pattern: str) -> list[str]:
    """Alternatives outside of groups and classes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]
