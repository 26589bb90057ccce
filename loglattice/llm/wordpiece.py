"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of pieces that begin a word and of pieces that
continue one.  Where the longest match ends, a failure link leads to the node
of what is left of the read characters, and the number of pieces that are
popped on the way is known beforehand.  So every character is read once, and
only counts are kept, never pieces.

The automaton runs in lock-step over the distinct words of a batch: step ``k``
moves all words that have a ``k``-th byte.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_of

NONE = -1


class Automaton(NamedTuple):
    keys: np.ndarray  # node * 256 + byte of each edge, ascending
    targets: np.ndarray
    fail: np.ndarray  # NONE: no segmentation goes on from here
    pops: np.ndarray  # pieces popped with the failure link
    finish: np.ndarray  # pieces if the word ends here, NONE: none
    longest: int  # bytes of words that are segmented at most; longer ones are unknown


def build(initial: list[bytes], continuing: list[bytes], longest: int = 1 << 30) -> Automaton:
    """The automaton of a vocabulary; node 0 begins words, node 1 continues them."""
    edges: dict[int, int] = {}
    piece, parent = [False, False], [(-1, -1), (-1, -1)]
    for root, words in ((0, initial), (1, continuing)):
        for word in words:
            node = root
            for b in word:
                key = node * 256 + b
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(False)
                    parent.append((node, b))
                node = edges[key]
            piece[node] = piece[node] or bool(word)
    n = len(piece)
    fail, pops = [NONE] * n, [0] * n
    level = [v for v in range(2, n) if parent[v][0] < 2]
    order, children = [], [[] for _ in range(n)]
    for v in range(2, n):
        children[parent[v][0]].append(v)
    while level:
        order += level
        level = [w for v in level for w in children[v]]
    for v in order:
        if piece[v]:
            fail[v], pops[v] = 1, 1
            continue
        u, b = parent[v]
        z, count = fail[u], pops[u]
        while z != NONE and (z * 256 + b) not in edges:
            count += pops[z]
            z = fail[z]
        if z != NONE:
            fail[v], pops[v] = edges[z * 256 + b], count
    # A word that ends in a node is segmented if failure links lead to node 1.
    finish = [NONE] * n
    finish[0], finish[1] = 0, 0
    for v in sorted(range(2, n), key=lambda v: _depth(v, parent)):
        if fail[v] != NONE and finish[fail[v]] != NONE:
            finish[v] = pops[v] + finish[fail[v]]
    keys = np.array(sorted(edges), np.int64)
    return Automaton(keys, np.array([edges[k] for k in keys.tolist()], np.int32), np.array(fail, np.int32), np.array(pops, np.int32), np.array(finish, np.int32), longest)


def _depth(node: int, parent: list[tuple[int, int]]) -> int:
    n = 0
    while node > 1:
        node, n = parent[node][0], n + 1
    return n


def piece_counts(a: Automaton, words: pa.Array) -> np.ndarray:
    """Pieces of each word: 1 for a word that can't be segmented (the unknown piece), 0 for an empty one."""
    words = words.cast(pa.large_binary())
    n = len(words)
    at = np.frombuffer(words.buffers()[1], np.int64, n + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    state, count, lost = np.zeros(n, np.int64), np.zeros(n, np.int64), size > a.longest
    live, k = np.flatnonzero((size > 0) & ~lost), 0
    while len(live):
        byte = data[at[live] + k].astype(np.int64)
        todo = np.arange(len(live))
        while len(todo):
            v = live[todo]
            key = state[v] * 256 + byte[todo]
            found = np.minimum(np.searchsorted(a.keys, key), len(a.keys) - 1)
            hit = a.keys[found] == key if len(a.keys) else np.zeros(len(key), bool)
            state[v[hit]] = a.targets[found[hit]]
            todo, v = todo[~hit], v[~hit]
            back = a.fail[state[v]]
            count[v] += a.pops[state[v]]
            lost[v[back == NONE]] = True
            state[v] = np.maximum(back, 0)
            todo = todo[back != NONE]
        k += 1
        live = live[(size[live] > k) & ~lost[live]]
    finish = a.finish[state]
    out = np.where(lost | (finish == NONE), 1, count + finish)
    return np.where(size == 0, 0, out)


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """A byte-level vocabulary as word pieces: entries with the space mark begin words, the others continue them.

    Every single byte begins and continues words, so no word is unknown.
    """
    from .bpe import _byte_alphabet

    back = {c: b for b, c in _byte_alphabet().items()}
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    initial, continuing = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
    for text in entries:
        raw = bytes(back[c] for c in text) if all(c in back for c in text) else b""
        if raw[:1] == b" ":
            initial.add(raw[1:])
        else:
            continuing.add(raw)
    return sorted(initial - {b""}), sorted(continuing - {b""})


def count_pieces(docs: DataFrame, initial: list[bytes], continuing: list[bytes], id_col: str = "doc_id", text_col: str = "text", longest: int = 1 << 30) -> DataFrame:
    """``id, n_words, n_pieces, longest_word_pieces`` of every whole text.

    Words are runs of characters other than the six ASCII white-space
    characters; the bytes of a word are matched.  Null and empty texts have no
    word.  Repeated rows give repeated rows; other columns are left out.  What
    is sent to all tasks has the size of the vocabulary.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(build(initial, continuing, longest)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        for batch in slices(batches, "text", 8 << 20):
            texts = [t.encode("utf-8", "replace").split() for t in batch.column("text").to_pylist()]
            many = np.fromiter(map(len, texts), np.int64, len(texts))
            coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            each = piece_counts(automaton, coded.dictionary)[coded.indices.to_numpy()] if many.sum() else np.empty(0, np.int64)
            total = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(many)
            some = np.flatnonzero(many)
            most = np.zeros(len(texts), np.int64)
            if len(some):
                most[some] = np.maximum.reduceat(each, (ends - many)[some])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(many), pa.array(total[ends] - total[ends - many]), pa.array(most)], ["id", "n_words", "n_pieces", "longest_word_pieces"])

    source = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    return source.mapInArrow(count, f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_pieces long, longest_word_pieces long")


def op10_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    initial, continuing = byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return count_pieces(documents(spark, sf_dir), initial, continuing).withColumnRenamed("id", "doc_id")
