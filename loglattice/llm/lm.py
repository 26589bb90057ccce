"""Language-model scores from an Elias-Fano n-gram trie of ``ORDER`` levels.

Counting, smoothing and look-up go over *blocks* of documents, each with a
dictionary of its own words, so that what is shuffled are a block's distinct
words and distinct n-grams, not every token:

1. Documents become blocks: local word codes, local words, training counts.
2. Local words meet in one shuffle, sorted by a hash of 64 bits, which Spark does
   without comparing words; they are counted and get dense numbers as they stream
   by, and go back to their blocks.  That is the level of unigrams.
3. For each further order, blocks send their distinct n-grams to buckets, as
   pairs of a context (the node of the n-gram without its last word) and a word,
   with training counts.  A bucket builds its part of the level from all
   training pairs, writes it to a file, maps it, and answers every block's
   pairs from the packed form: probability, back-off weight, and the node,
   which is the context of the next order.
4. Blocks add up their documents' scores.

Pairs are dealt by context, those of very frequent contexts by both context and
word.  The probability of a word after a context is::

    p(w | context) = c(context, w) / (c(context) + kappa) + kappa / (c(context) + kappa) * p(w | shorter context)

down to the add-one unigram probability.  A level keeps the first term of each
pair and the back-off weight of each context in 8 bits.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_shared, release_shuffles, slices, text_of, write_shared
from .elias_fano import Level

ORDER = 3
BLOCK_BYTES = 8 << 20
#: Pairs of all blocks that a bucket answers, and local words that a task settles, about.
BUCKET_PAIRS = 1_000_000
#: The weight of the shorter context, for the second order and for all further ones.
KAPPA = (100.0, 10.0)
#: A node is its bucket and, in that many low bits, its place in the bucket's level.
NODE_BITS = 40
#: Quantised log10 probabilities: 24 steps for each power of ten; 0 means absent.
STEPS = 24


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-STEPS * np.log10(p)) + 1, 1, 255).astype(np.uint8)


_LEVELS = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def unquantise(q: np.ndarray) -> np.ndarray:
    return _LEVELS[q]


def kappa_of(order: int, kappa: tuple[float, ...]) -> float:
    return kappa[min(order - 2, len(kappa) - 1)]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Whole numbers, none below 0, each array byte plane by byte plane, in one frame: small ones cost little."""
    head, planes = [struct.pack("<B", len(arrays))], []
    for x in arrays:
        x = np.ascontiguousarray(x, "<i8")
        if len(x) and x.min() < 0:
            raise ValueError("a number below 0")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head.append(struct.pack("<QB", len(x), width))
        planes += [x.view(np.uint8)[k::8].tobytes() for k in range(width)]
    return zstandard.compress(b"".join([*head, *planes]), 1)


def loosen(data: bytes) -> list[np.ndarray]:
    """The arrays of ``squeeze``."""
    raw = zstandard.decompress(data)
    n, at, out = raw[0], 1, []
    sizes = [struct.unpack_from("<QB", raw, at + 9 * k) for k in range(n)]
    at += 9 * n
    for size, width in sizes:
        x = np.zeros(size, "<i8")
        for k in range(width):
            x.view(np.uint8)[k::8] = np.frombuffer(raw, np.uint8, size, at)
            at += size
        out.append(x)
    return out


def zigzag(x: np.ndarray) -> np.ndarray:
    """Differences, those below 0 too, as numbers from 0 on."""
    d = np.diff(x, prepend=0)
    return (d << 1) ^ (d >> 63)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return np.cumsum((x >> 1) ^ -(x & 1))


def fresh(x: np.ndarray) -> np.ndarray:
    """Whether a number differs from the one before."""
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2**31 in ascending order, as ``a * 2**32 + b``, and of each given pair its place there."""
    low, high, place = (int(x).bit_length() for x in (b.max(initial=0), a.max(initial=0), max(len(a) - 1, 0)))
    if low + high + place > 63:
        return np.unique((a << 32) | b, return_inverse=True)
    # Places are sorted along with their pairs, which is faster than sorting them by their pairs.
    both = (a << (low + place)) | (b << place)
    both |= np.arange(len(a))
    both.sort()
    pairs = both >> place
    new = fresh(pairs)
    back = np.empty(len(a), np.int64)
    back[both & ((1 << place) - 1)] = np.cumsum(new) - 1
    pairs = pairs[new]
    return ((pairs >> low) << 32) | (pairs & ((1 << low) - 1)), back


def pack_cell(context: np.ndarray, word: np.ndarray, seen: np.ndarray, many: np.ndarray) -> bytes:
    """Pairs in the order of contexts and words: words as differences within their context, its count once."""
    new = fresh(context)
    step = np.diff(word, prepend=0)
    return squeeze(zigzag(context), np.where(new, word, step), seen, many[new])


def unpack_cell(data: bytes) -> tuple[np.ndarray, ...]:
    context, word, seen, many = loosen(data)
    context = unzigzag(context)
    first = np.flatnonzero(fresh(context))
    run = np.diff(first, append=len(context))
    total = np.cumsum(word)
    return context, total - np.repeat(total[first] - word[first], run), seen, np.repeat(many, run)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


BLOCKS = "block long, ids array<long>, sizes array<int>, tokens binary, words array<binary>, counts array<long>"


def make_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Documents by block; code 0 is the end of a text, whose word is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", block_bytes):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
            flat = lists.flatten().cast(pa.binary())
            full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
            bounds = lists.offsets.to_numpy()
            run = np.concatenate([[0], np.cumsum(full)])
            many = run[bounds[1:] - bounds[0]] - run[bounds[:-1] - bounds[0]]
            coded = flat.filter(pa.array(full)).dictionary_encode()
            del lists, flat
            ids = batch.column("id").to_pylist()
            tokens = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + 1, np.cumsum(many), np.uint32(0))
            train = np.repeat(np.array([not held_out(i) for i in ids]), many + 1)
            counts = np.bincount(tokens[train], minlength=len(coded.dictionary) + 1)
            words = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.cast(pa.binary())])
            one = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([(many + 1).tolist()], pa.list_(pa.int32())), pa.array([squeeze(tokens)], pa.binary()), pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(counts.astype(np.int64)))],
                ["block", "ids", "sizes", "tokens", "words", "counts"],
            )
            block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return write_shared(rows.mapInArrow(run, BLOCKS), "lm-blocks")


_WORD_ROWS = "block long, at int, place long, count long"
#: A word's part, and in that many low bits its place in the part.
PLACE_BITS, PLACE_MASK = 40, (1 << 40) - 1


def _digest(word: str):
    return F.xxhash64(word)


def settle_words(blocks: DataFrame, most: int) -> tuple[DataFrame, np.ndarray, int, int]:
    """``to, at, place, count`` of all local words that training has; each part's first number; all training tokens; distinct words.

    One shuffle brings the local words of all blocks together; they stream by
    in the order of their hashes, and a task holds the rows of one hash: one for
    each block that has the word.  Words with one hash are told apart.
    ``place`` holds the part, and the word's place in it.
    """
    names = ["block", "at", "place", "count"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, total = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []  # rows of the last hash so far
        last = None

        def rows(block: np.ndarray, at: np.ndarray, places: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(block), pa.array(at, pa.int32()), pa.array((part << PLACE_BITS) + places), pa.array(count)], names)

        def whole(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            """The rows of words all of whose rows are here."""
            nonlocal place, total
            code = pa.concat_arrays([b.column("word") for b in some]).dictionary_encode().indices.to_numpy()
            block, at, count = (np.concatenate([b.column(c).to_numpy() for b in some]) for c in ("block", "at", "count"))
            sums = np.bincount(code, count).astype(np.int64)
            places = place + np.cumsum(sums > 0) - 1
            kept = np.flatnonzero(sums[code] > 0)
            place, total = place + int((sums > 0).sum()), total + int(sums.sum())
            return rows(block[kept], at[kept], places[code[kept]], sums[code[kept]])

        for batch in batches:
            if not batch.num_rows:
                continue
            digest = batch.column("digest").to_numpy()
            if held and digest[0] != last:
                yield whole(held)
                held = []
            last = digest[-1]
            cuts = np.flatnonzero(np.diff(digest))
            if len(cuts):
                end = int(cuts[-1]) + 1
                yield whole([*held, batch.slice(0, end)])
                held = [batch.slice(end)]
            else:
                held.append(batch)
        if held:
            yield whole(held)
        # A row without a place in a block tells how many words the part has, and their count.
        yield rows(np.array([-1]), np.array([-1]), np.array([place]), np.array([total]))

    local = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("block", "at", F.col("e.words").alias("word"), F.col("e.counts").alias("count"))
    many = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, int(many) // most + 1)
    # The hash is made behind the shuffle, so that it takes no disk.
    dealt = local.repartition(parts, "word").withColumn("digest", _digest("word")).sortWithinPartitions("digest")
    settled = write_shared(dealt.mapInArrow(settle, _WORD_ROWS), "lm-words")
    found = settled.filter("at < 0").select("place", "count").collect()
    first = np.zeros(max((r["place"] >> PLACE_BITS for r in found), default=0) + 2, np.int64)
    for r in found:
        first[(r["place"] >> PLACE_BITS) + 1] = r["place"] & PLACE_MASK
    first = np.cumsum(first)
    return settled.filter("at >= 0").withColumnRenamed("block", "to"), first, sum(r["count"] for r in found), int(first[-1])


class Grams(NamedTuple):
    """A block's distinct pairs of context and word at one order, ready to be asked for."""

    context: np.ndarray  # of each pair: the node of its context,
    word: np.ndarray  # its word's number,
    many: np.ndarray  # the count of its context
    order: np.ndarray  # pairs as they are sent: by bucket, context and word
    cuts: np.ndarray  # where each bucket's pairs begin in that order


class Answers(NamedTuple):
    level: np.ndarray  # quantised probability, 0: not in training
    weight: np.ndarray  # quantised back-off weight of the context
    node: np.ndarray  # -1: not in training
    count: np.ndarray


class Step(NamedTuple):
    """Where a block's tokens stand at one order."""

    own: np.ndarray  # each token's context as a place in ``nodes`` and ``counts``, or -1
    nodes: np.ndarray
    counts: np.ndarray
    pair: np.ndarray  # of each token: its pair, or -1
    keys: np.ndarray  # the pairs: context * 2**32 + local word

    def context_count(self, some: np.ndarray) -> np.ndarray:
        own = self.own[some]
        return np.where(own >= 0, self.counts[own], 0)


class Block:
    """A coded block, and what levels have answered so far."""

    def __init__(self, row: dict, answers: pa.Table | None, setting: tuple[int, int, int]) -> None:
        self.total, self.buckets, last = setting
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        (self.tokens, end), (numbers, self.word_counts) = loosen(row["tokens"]), loosen(row["numbers"])
        self.end = int(end[0])
        self.numbers = unzigzag(numbers)
        self.steps = [self._step(np.concatenate([[0], self.tokens[:-1]]), self.numbers, self.word_counts)]
        self.answers: list[Answers] = []
        orders = answers.column("order").to_numpy() if answers is not None else np.empty(0)
        for order in sorted(set(orders.tolist())):
            rows = answers.filter(pa.array(orders == order))
            self.answers.append(self._gather(rows, self.steps[-1]))
            if order < last:
                self.steps.append(self._next(self.steps[-1], self.answers[-1]))

    def _step(self, own: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> Step:
        # The end of a text is also the context of a first word.
        own[self.starts] = self.end if nodes is self.numbers else -1
        known = (own >= 0) & (counts[own] > 0) & (self.word_counts[self.tokens] > 0)
        keys, back = distinct_pairs(own[known], self.tokens[known])
        pair = np.full(len(own), -1, np.int64)
        pair[known] = back
        return Step(own, nodes, counts, pair, keys)

    def _next(self, step: Step, done: Answers) -> Step:
        own = np.concatenate([[-1], step.pair[:-1]])
        if not len(done.node):
            done = Answers(*(np.full(1, -1, np.int64),) * 3, np.zeros(1, np.int64))
        own[done.node[own] < 0] = -1
        return self._step(own, done.node, done.count)

    def _gather(self, rows: pa.Table, step: Step) -> Answers:
        g = self.grams(step)
        n = len(g.context)
        out = Answers(*(np.zeros(n, np.int64) for _ in range(2)), np.full(n, -1, np.int64), np.zeros(n, np.int64))
        for b, x in zip(rows.column("bucket").to_pylist(), rows.column("answer").to_pylist()):
            own = g.order[g.cuts[b] : g.cuts[b + 1]]
            level, weight, *more = loosen(x)
            first = np.flatnonzero(fresh(g.context[own]))
            out.level[own], out.weight[own] = level, np.repeat(weight, np.diff(first, append=len(own)))
            if more:
                known = own[level > 0]
                out.node[known], out.count[known] = (b << NODE_BITS) + unzigzag(more[0]), more[1]
        return out

    def seen(self, step: Step) -> np.ndarray:
        """Of each pair its count in training documents of the block."""
        train = np.repeat(np.array([not held_out(i) for i in self.ids], bool), self.sizes)
        return np.bincount(step.pair[train & (step.pair >= 0)], minlength=len(step.keys))

    def _deal(self, context: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
        mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if word is not None:
            mixed ^= word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def grams(self, step: Step) -> Grams:
        a, b = step.keys >> 32, step.keys & 0xFFFFFFFF
        context, word, many = step.nodes[a], self.numbers[b], step.counts[a]
        bucket = self._deal(context) if step.nodes is self.numbers else context >> NODE_BITS
        # The words after a frequent context are spread over all buckets; others lie where their context does.
        wide = np.flatnonzero(many * 4 * self.buckets > self.total)
        bucket[wide] = self._deal(context[wide], word[wide])
        order = np.argsort(bucket.astype(np.min_scalar_type(self.buckets)), kind="stable")
        return Grams(context, word, many, order, np.searchsorted(bucket[order], np.arange(self.buckets + 1)))


def _dense(x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Numbers below 2**31 that stand for ``x`` in its order, and what they stand for (None: themselves)."""
    if not len(x) or int(x.max()) < 1 << 31:
        return None, x
    return np.unique(x, return_inverse=True)


def _answer(kappa: float, order: int, last: int):
    """A bucket's level from all blocks' pairs, and its answer to each block."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cells = [unpack_cell(x) for x in rows.column("cell").to_pylist()]
        cuts = np.cumsum([0, *(len(c[0]) for c in cells)])
        context, word, seen, many = (np.concatenate(x) for x in zip(*cells))
        del cells
        contexts, c = _dense(context)
        words, w = _dense(word)
        pairs, first, back = np.unique((c << 32) | w, return_index=True, return_inverse=True)
        del c, w, word
        count = np.bincount(back, seen, len(pairs)).astype(np.int64)
        c, w, many = pairs >> 32, pairs & 0xFFFFFFFF, many[first]
        c, w = c if contexts is None else contexts[c], w if words is None else words[w]
        kept = count > 0
        weights = quantise(kappa / (many + kappa))
        with tempfile.TemporaryFile() as file:
            file.write(Level.build(c[kept], w[kept], quantise(count[kept] / (many[kept] + kappa)), weights[kept]))
            file.flush()
            level = Level(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
            at, place = level.find(c, w)
            known, there = at >= 0, place >= 0
            levels = np.zeros(len(at), np.uint8)
            levels[known] = level.levels[at[known]]
            # A context that has no pair in this bucket has its weight from its count.
            weights[there] = level.weights[place[there]]
            del level
        out = []
        for a, b in zip(cuts, cuts[1:]):
            own = back[a:b]
            parts = [levels[own], weights[own[fresh(context[a:b])]]]
            if order < last:
                found = own[known[own]]
                parts += [zigzag(at[found]), count[found]]
            out.append(squeeze(*parts))
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array([order] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["to", "bucket", "order", "answer"])

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    last: int = ORDER,
    kappa: tuple[float, ...] = KAPPA,
    block_bytes: int = BLOCK_BYTES,
    bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Documents whose id has a crc32 of 2 modulo 7 are held out; those without an
    id train.  A null text is empty: its one token is the end.  Repeated rows
    count as often as they stand.  Every text is used whole; other columns are
    left out.  With no training document every probability is 1 in 1.  ``last``
    is the order of the longest n-grams.  A block holds ``block_bytes`` of texts,
    or one longer text.
    """
    spark = docs.sparkSession
    blocks = make_blocks(docs, id_col, text_col, block_bytes)
    settled, first, total, distinct = settle_words(blocks, bucket_pairs)
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()[0] or 0
    setting = (total, max(4, int(tokens) // bucket_pairs), last)
    names = ["block", "ids", "sizes", "tokens", "numbers"]

    def number(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.column("n_words")[0].as_py()
        numbers, counts = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, place = right.column("at").to_numpy(), right.column("place").to_numpy()
        numbers[at] = (place & PLACE_MASK) + first[place >> PLACE_BITS]
        counts[at] = right.column("count").to_numpy()
        # Codes follow numbers, so that pairs in the order of codes are in the order of numbers.
        order = np.argsort(numbers, kind="stable")
        code = np.empty(n, np.int64)
        code[order] = np.arange(n)
        (tokens,) = loosen(left.column("tokens")[0].as_py())
        blobs = (squeeze(code[tokens], code[:1]), squeeze(zigzag(numbers[order]), counts[order]))
        return pa.table([*(left.column(c) for c in names[:3]), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def asked(left: pa.Table, answers: pa.Table | None) -> Iterator[pa.RecordBatch]:
        for row in left.to_pylist():
            block = Block(row, answers, setting)
            g, seen = block.grams(block.steps[-1]), block.seen(block.steps[-1])
            cells, buckets = [], np.flatnonzero(np.diff(g.cuts))
            for b in buckets.tolist():
                own = g.order[g.cuts[b] : g.cuts[b + 1]]
                cells.append(pack_cell(g.context[own], g.word[own], seen[own], g.many[own]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([row["block"]] * len(cells), pa.int64()), pa.array(cells, pa.binary())], CELLS)

    CELLS = ["bucket", "block", "cell"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from asked(pa.Table.from_batches([batch.slice(k, 1)]), None)

    def ask_on(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(asked(left, right))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0], right, setting)
        count = block.word_counts[block.tokens]
        base = (count + 1) / (total + distinct + 1)
        value = base.copy()
        for order, step in enumerate(block.steps, 2):
            k = kappa_of(order, kappa)
            level, weight = np.zeros(len(value), np.uint8), np.zeros(len(value), np.uint8)
            left = np.arange(len(value))
            if order - 2 < len(block.answers):  # a block without a known pair has none
                a, has = block.answers[order - 2], step.pair >= 0
                weight[has] = a.weight[step.pair[has]]
                level[has] = a.level[step.pair[has]]
                left = np.flatnonzero(~has)
            weight[left] = quantise(k / (step.context_count(left) + k))
            value = unquantise(level) + unquantise(weight) * value

        def by_doc(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, block.starts) if len(block.ids) else x

        n = len(block.ids)
        cols = [pa.array(block.ids, pa.int64()), pa.array([held_out(i) for i in block.ids]), pa.array(block.sizes), pa.array(by_doc((count > 0).astype(np.int64))), pa.array(np.full(n, total)), pa.array(by_doc(np.log10(base))), pa.array(by_doc(np.log10(value)))]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    left = blocks.select(*names[:4], F.size("words").alias("n_words")).groupBy("block")
    coded = left.cogroup(settled.groupBy("to")).applyInArrow(number, "block long, ids array<long>, sizes array<int>, tokens binary, numbers binary")
    coded = write_shared(coded, "lm-coded")
    drop_shared(blocks)
    drop_shared(settled)
    release_shuffles(spark)
    answers, cells = None, "bucket long, block long, cell binary"
    for order in range(2, last + 1):
        pairs = coded.mapInArrow(ask, cells) if answers is None else coded.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(ask_on, cells)
        found = write_shared(pairs.groupBy("bucket").applyInArrow(_answer(kappa_of(order, kappa), order, last), "to long, bucket long, order int, answer binary"), "lm-answers")
        release_shuffles(spark)
        answers = found if answers is None else answers.unionByName(found)
    met = coded.groupBy("block").cogroup(answers.groupBy("to"))
    return met.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
