"""Order-preserving packing by dynamic programming with a monotone queue.

Documents stay in ascending order of their id.  Cuts between sequences fall at
ends of documents, at ends of sentences (for a penalty) or, where both are far
apart, at places in between (for a larger one): the recurrence chooses.
With ``p`` the position of a cut, the best cost up to ``j`` is::

    best[j] = min over i with p[j] - p[i] <= length of
              best[i] + (length - (p[j] - p[i])) + penalty[j]

and ``best[i] + p[i]`` doesn't hang on ``j``: a queue with rising values gives
each minimum in constant time.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BpeEncoder, encoder, with_end
from .common import documents, slices, text_of

LENGTH = 2048
#: The penalties of cuts at ends of sentences and inside them, as shares of a sequence: 8 and 48 of 2,048.
SENTENCE_SHARE, INNER_SHARE = (1, 256), (3, 128)
#: Stops of other scripts, of three and of two bytes in UTF-8.
LONG_STOPS = [int.from_bytes(c.encode(), "big") for c in "。！？｡।॥።။។…"]
SHORT_STOPS = [int.from_bytes(c.encode(), "big") for c in "؟۔։"]
#: Ids over which one run of the recurrence goes.
RUN_IDS = 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ends:
    """Which ids of a row of ids end a sentence, by a vocabulary's bytes."""

    def __init__(self, tokens: BpeEncoder) -> None:
        vocabulary = tokens.tokenizer.get_vocab()
        byte_of = {c: b for b, c in tokens.alphabet.items()}
        n = max(vocabulary.values()) + 1
        #: Whether an id's own bytes do so: they end in a stop, quotes and brackets behind it left out, or hold a line break.
        self.alone = np.zeros(n, bool)
        #: The number of an id's bytes, and its last three as one number.
        self.size, self.tail = np.ones(n, np.int64), np.zeros(n, np.int64)
        for text, i in vocabulary.items():
            data = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
            bare = data.decode("utf-8", "ignore").rstrip("\"')]}»”’")
            self.alone[i] = b"\n" in data or bare[-1:] in (".", "!", "?")
            self.size[i], self.tail[i] = max(len(data), 1), int.from_bytes(data[-3:], "big")
        #: Whether an id's last byte is that of a longer stop.
        self.may_end = np.isin(self.tail & 0xFF, np.array([*LONG_STOPS, *SHORT_STOPS]) & 0xFF)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """A stop of several bytes may be spread over up to three ids."""
        ids = np.minimum(ids, len(self.alone) - 1)
        out = self.alone[ids]
        at = np.flatnonzero(self.may_end[ids] & ~out)
        tail, shift = self.tail[ids[at]], 8 * np.minimum(self.size[ids[at]], 3)
        for back in (1, 2):
            earlier = ids[np.maximum(at - back, 0)]
            tail |= np.where(at >= back, self.tail[earlier] << shift, 0)
            shift = np.minimum(shift + 8 * np.minimum(self.size[earlier], 3), 24)
        out[at] = np.isin(tail & 0xFFFFFF, LONG_STOPS) | np.isin(tail & 0xFFFF, SHORT_STOPS)
        return out


@functools.lru_cache(maxsize=2)
def sentence_ends(tokens: BpeEncoder) -> Ends:
    return Ends(tokens)


def candidates(ends: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a cut may fall, 0 and the end included, and their penalties; ``ends`` tells which ids end a sentence.

    In gaps of over a 32nd of a sequence there are places inside sentences,
    about four in such a stretch.  To cut each sequence as late as one may
    would cost a 32nd of a sequence and one penalty each, so the best cuts leave
    a padding of 5.5 % at most, whatever the texts.
    """
    reach = max(length // 32, 4)
    step = max(reach // 4, 1)
    n, prices = len(ends), [length * a // b for a, b in (INNER_SHARE, SENTENCE_SHARE)]
    # The dearest places first; what stands there otherwise lowers the price.
    cost = np.full(n + 1, -1, np.int32)
    stops = np.flatnonzero(ends) + 1
    places = np.sort(np.concatenate([[0], stops, doc_ends]))
    far = np.flatnonzero(np.diff(places) > reach)
    for k in far.tolist():
        cost[places[k] + step : places[k + 1] : step] = prices[0]
    cost[stops] = prices[1]
    cost[doc_ends] = cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """The cuts of least padding plus penalties, first 0, last the end."""
    places, costs, queue, came = at.tolist(), cost.tolist(), deque([(0, 0)]), [0] * len(at)
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        came[j] = i
        # best[j] + p[j] = (best[i] + p[i]) + length + penalty[j]
        value += length + costs[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [places[-1]], len(places) - 1
    while j:
        j = came[j]
        cuts.append(places[j])
    return cuts[::-1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence.

    The vocabulary's added tokens count inside texts, as in the library.

    Null texts are empty: the end id alone.  Rows with one id are ordered by
    their text and are documents of their own.  Other columns are left out,
    whatever their names.  A very long text is cut over many sequences.  Each
    range of documents is packed in one task, run by run; the last sequence of
    a run that isn't full is carried into the next, so only one short sequence
    remains for each range.  An empty table gives no piece.
    ``sequence_id`` rises with the documents and has gaps between ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        tokens = encoder(vocabulary)
        ends = sentence_ends(tokens)
        keys: list[int | None] = []  # of the documents that the held ids belong to
        sizes = np.empty(0, np.int64)
        skip = 0  # ids of the first of them that are packed already
        held = np.empty(0, np.uint32)

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal keys, sizes, skip, held, sequence
            doc_ends = np.cumsum(sizes) - skip
            cuts = best_cuts(*candidates(ends.of(held), doc_ends, length), length)
            if not last:
                # What ended only because the run ended stays for the next run.
                cuts.pop()
            if len(cuts) < 2:
                return None
            cuts = np.array(cuts)
            done = cuts[-1]
            starts = np.union1d(cuts[:-1], np.concatenate([[0], doc_ends[doc_ends < done]]))
            size = np.diff(starts, append=done)
            doc = np.searchsorted(doc_ends, starts, "right")
            seq = np.searchsorted(cuts, starts, "right") - 1
            view = memoryview(held[:done].astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), size.tolist())]
            begin = doc_ends[doc] - sizes[doc]
            out = pa.RecordBatch.from_arrays(
                [pa.array([keys[d] for d in doc.tolist()], pa.int64()), *(pa.array(x.astype(np.int64)) for x in (starts - begin, size, np.array(crc), sizes[doc], sequence + seq, starts - cuts[seq]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts) - 1
            first = int(np.searchsorted(doc_ends, done, "right"))
            skip = int(done - (doc_ends[first] - sizes[first])) if first < len(sizes) else 0
            keys, sizes, held = keys[first:], sizes[first:], held[done:]
            return out

        for batch in slices(batches, "text", 4 << 20):
            ids, bounds = with_end(*tokens.encode(batch.column("text")), end_id)
            keys = keys + batch.column("id").to_pylist()
            sizes = np.concatenate([sizes, np.diff(bounds)])
            held = np.concatenate([held, ids])
            if len(held) >= RUN_IDS and (out := emit(False)) is not None:
                yield out
        if len(held) and (out := emit(True)) is not None:
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return ordered.mapInArrow(run, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
