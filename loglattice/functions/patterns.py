"""Pattern sets: ids in the order given, flags, and one alternation for one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Flags that change what matches, and so belong to a cache key (fixed values).
MATCHING_FLAGS = ("-i", "--ignore-case", "--case-sensitive", "-w", "-x", "-F", "-P")
#: Flags that a search with offsets can't honour; they are left out.
DROPPED_FLAGS = ("--byte-offset", "--only-matching")
_INLINE_FOLD = re.compile(r"^\(\?[a-zA-Z]*i[a-zA-Z]*[):-]")


@dataclass(frozen=True)
class PatternSet:
    patterns: tuple[str, ...]
    flags: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, *patterns: str, flags: tuple[str, ...] = ()) -> PatternSet:
        if not patterns:
            raise ValueError("no pattern")
        return cls(tuple(patterns), tuple(f for f in flags if f not in DROPPED_FLAGS))

    @property
    def ids(self) -> tuple[str, ...]:
        return tuple(f"p{k}" for k in range(1, len(self.patterns) + 1))

    @property
    def fold(self) -> bool:
        """Whether case is ignored: the last flag that speaks of it decides.  ``-P`` needs nothing: patterns are Perl-like anyway."""
        said = [f for f in self.flags if f in ("-i", "--ignore-case", "--case-sensitive")]
        return bool(said) and said[-1] != "--case-sensitive"

    def regex(self, k: int) -> str:
        """Pattern ``k`` (from 0) as a Java regular expression in which only line feeds end lines."""
        p = self.patterns[k]
        if "-F" in self.flags:
            p = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", p)
        if "-w" in self.flags:
            p = rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"
        if "-x" in self.flags:
            p = f"^(?:{p})$"
        inline = _INLINE_FOLD.match(p)
        return ("(?d)" if inline or not self.fold else "(?diu)") + p

    @property
    def combined(self) -> str:
        """Any of the patterns, the first that fits at a place."""
        return "|".join(f"(?:{self.regex(k)})" for k in range(len(self.patterns)))

    def check(self, spark: SparkSession) -> None:
        """Raise for a pattern that doesn't compile, before any task runs."""
        for k, p in enumerate(self.patterns):
            try:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(self.regex(k))
            except Exception as e:
                raise ValueError(f"pattern {self.ids[k]} isn't a regular expression: {p!r}") from e
