"""Which of many patterns a line can match, by texts that their matches must hold.

One automaton for all these texts runs over the bytes of a batch of lines at
once.  Only lines that hold one go on, with the patterns it stands for; so the
cost hangs little on the number of patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.literals import required
from ..functions.patterns import PatternSet

#: Bytes of lines that the automaton runs over at once.
PIECE = 1 << 20


def texts_of(patterns: PatternSet) -> list[tuple[str, ...] | None]:
    """The texts of each pattern, None where nothing is known of it."""
    fixed = "-F" in patterns.flags
    return [required(p, fixed, patterns.fold) for p in patterns.patterns]


def candidates(lines: DataFrame, patterns: PatternSet, name: str = "__patterns") -> DataFrame:
    """The ``lines`` that some pattern can match, with the numbers (from 0, rising) of all that can."""
    texts, fold = texts_of(patterns), patterns.fold
    always = [k for k, t in enumerate(texts) if t is None]
    owners: dict[bytes, list[int]] = {}
    for k, some in enumerate(texts):
        for t in some or ():
            owners.setdefault(t.encode(), []).append(k)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, text in enumerate(owners):
            automaton.add_word(text.decode("latin-1"), k)
        if owners:
            automaton.make_automaton()
        held = [np.array(o) for o in owners.values()]
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("line")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(size) - size) // PIECE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield from _marked(batch.slice(a, b - a), size[a:b], automaton if owners else None, held)

    def _marked(part: pa.RecordBatch, size: np.ndarray, automaton, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, ends = part.num_rows, np.cumsum(size)
        rows, which = [np.repeat(np.arange(n), len(always))], [np.tile(np.array(always, np.int64), n)]
        data = b"".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("line").cast(pa.binary()))
        if automaton is not None and data:
            if fold:
                # Letters that aren't ASCII may fold to some that are.
                high = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) >= 128)])
                odd = np.flatnonzero(high[ends] > high[ends - size])
                rows.append(np.repeat(odd, len(texts)))
                which.append(np.tile(np.arange(len(texts)), len(odd)))
                data = data.lower()
            found = list(automaton.iter(data.decode("latin-1")))
            if found:
                at, text = np.array(found, np.int64).T
                pairs = np.unique(np.searchsorted(ends, at, "right") * len(held) + text)
                line, text = pairs // len(held), pairs % len(held)
                many = np.array([len(o) for o in held])[text]
                rows.append(np.repeat(line, many))
                which.append(np.concatenate([held[t] for t in text.tolist()]))
        pairs = np.unique(np.concatenate(rows) * len(texts) + np.concatenate(which))
        line, pattern = pairs // len(texts), pairs % len(texts)
        keep, first = np.unique(line, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(line)).astype(np.int32)), pa.array(pattern.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep)) for c in part.columns), lists], [*part.schema.names, name])

    return lines.mapInArrow(run, f"{schema}, {name} array<int>")
