"""Quality rules on repetition inside a text, from its suffix array.

The words of many texts are sorted at once: words are ranked within their own
text, and ranks are doubled in length (1, 2, 4, ... words), each time only for
suffixes that still tie.  The rank tables of all lengths give the longest
common prefix of neighbours in the sorted order.  The deepest interval of
common prefixes that a position lies in is as deep as the larger of its two
neighbours' prefixes; so the union of all maximal repeats of at least
``min_words`` words is the union of those spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MIN_WORDS = 8
#: A text fails if maximal repeats cover more than this share of its words,
MAX_COVERED = 0.2
#: or if the longest repeat has more than this share of them.  Both lie below
#: what the base rule implies: words in long repeats are also in repeated
#: triples, so a limit of 0.5 or more on the first could never decide.
MAX_LONGEST = 0.1


def suffix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... codes until all differ; a rank is the first place of its group.

    ``codes`` ends each text with a code of its own, so no two suffixes are equal.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.ones(n, bool)
    first[1:] = codes[order[1:]] != codes[order[:-1]]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    out, h = [rank], 1
    alone = first & np.append(first[1:], True)
    tied = order[~alone]
    while len(tied):
        rank = out[-1]
        own, ahead = rank[tied], rank[np.minimum(tied + h, n - 1)]
        again = np.lexsort((ahead, own))
        tied, own, ahead = tied[again], own[again], ahead[again]
        group = np.ones(len(tied), bool)
        group[1:] = own[1:] != own[:-1]
        start = np.maximum.accumulate(np.where(group, np.arange(len(tied)), 0))
        split = group.copy()
        split[1:] |= ahead[1:] != ahead[:-1]
        inner = np.maximum.accumulate(np.where(split, np.arange(len(tied)), 0))
        rank = rank.copy()
        rank[tied] = own + inner - start
        out.append(rank)
        tied = tied[~(split & np.append(split[1:], True))]
        h *= 2
    return out


def neighbour_prefixes(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the common prefix of each suffix with the one before it (0 for the first)."""
    last = ranks[-1]
    order = np.empty(len(last), np.int64)
    order[last] = np.arange(len(last))
    left, right = order[:-1].copy(), order[1:].copy()
    length = np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = np.flatnonzero((left < len(last)) & (right < len(last)))
        same = same[ranks[k][left[same]] == ranks[k][right[same]]]
        for x in (left, right, length):
            x[same] += 1 << k
    return order, np.concatenate([[0], length])


def repeats(codes: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeat that starts there."""
    if not len(codes):
        return np.empty(0, np.int64)
    order, shared = neighbour_prefixes(suffix_ranks(codes))
    out = np.empty(len(codes), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def _covered(length: np.ndarray, least: int) -> np.ndarray:
    """Whether a position lies in a repeat of at least ``least``."""
    at = np.arange(len(length))
    return np.maximum.accumulate(np.where(length >= least, at + length, 0)) > at if len(length) else np.empty(0, bool)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, each text ended by a code of its own, and the number of words of each."""
    split = [t.split() for t in texts]
    many = np.fromiter(map(len, split), np.int64, len(split))
    words = pa.array([w for t in split for w in t], pa.binary()).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(words.dictionary) + 1
    owner = np.repeat(np.arange(len(texts)), many)
    # A word of another text is another word; the end of text i comes after its words.
    codes = np.insert(owner * width + codes, np.cumsum(many), np.arange(len(texts)) * width + width - 1)
    return codes, many


def check_repetition(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_covered: float = MAX_COVERED,
    max_longest: float = MAX_LONGEST,
) -> DataFrame:
    """One row for each document: counts, repeats and the verdict ``kept``.

    A null or empty text has no word and fails.  Every text is measured whole;
    a very long one needs memory in proportion to its words.  Repeated rows
    give repeated rows, equal texts equal values.  Other columns are left out.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            raw = [t.encode("utf-8", "replace") for t in texts]
            codes, many = word_codes(raw)
            length = repeats(codes)
            ends = np.cumsum(many + 1)  # behind each text's end code
            starts = ends - many - 1

            def total(x: np.ndarray) -> np.ndarray:
                run = np.concatenate([[0], np.cumsum(x)])
                return run[ends] - run[starts]

            three = total(_covered(np.where(length >= 3, 3, 0), 3))
            covered = total(_covered(length, min_words))
            longest = np.maximum.reduceat(length, starts) if len(texts) else many
            lines = [[line for line in t.split(b"\n") if line.strip(SPACES)] for t in raw]
            dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
            symbols = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64)
            chars = np.array([len(t) - (len(b) - len(b.translate(None, SPACES))) for t, b in zip(texts, raw)], np.int64)
            failed = (many < 50) | (100 * three > 50 * many)
            bad = (covered > max_covered * many) | ((longest >= min_words) & (longest > max_longest * many))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (many, chars, symbols, dup, three, covered, longest, failed, ~failed & ~bad))], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return source.mapInArrow(measure, ", ".join(f"{n} long" for n in names[:8]) + ", base_failed boolean, kept boolean")


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_repetition(documents(spark, sf_dir))
