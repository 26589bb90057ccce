"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine.

Terms are all words of the examples.  A term weighs ``(1 + log tf) * idf``,
times how much it tells the classes apart: the lower bound of its phi coefficient
with the toxic label over ``FULL_PHI``, at least ``LEAST_SHARE``, so that words of
topics and languages count less than telling ones, and none is dropped.

The examples are kept in a block-max inverted index.  Rare terms have postings.
Frequent ones, whose postings would be long, lie example by example, with the
largest weight of each term in each block of examples.  A query adds up its rare
terms' postings; what frequent terms can add to a block is bounded by its
largest weights; blocks are finished from the highest bound down until no bound
reaches the k-th best cosine.  So the neighbours are exact.

Neighbours vote by cosine squared.  The votes are calibrated by a logistic
curve, fitted to the votes that examples get from an index of the other
``FOLDS - 1`` parts of them, so neither an example's vector nor its label has a
share in its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, slices, small_batches, text_of, write_shared

#: Labelled rows that are learned from at most, those with the least hash of id and text,
#: and distinct words of theirs in all; both bound what every task holds.
MAX_EXAMPLES = 4_000
MAX_POSTINGS = 1_500_000
#: The phi coefficient from which on a term has its full weight, and the least share of it.
FULL_PHI, LEAST_SHARE = 0.3, 0.05
#: Standard errors that are taken from it, so that a chance meeting tells nothing.
SURE = 3.0
#: A term is frequent if more than one example in so many has it.
RARE = 5
NEIGHBOURS = 25
BLOCK = 64
EVIDENCE = 3
#: Parts of the examples, each of which is voted on by the others to fit the calibration.
FOLDS = 4
_LETTERS = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 64-bit hashes of a text's words in lower case, and how often each occurs."""
    counts = Counter(_LETTERS.findall(text.lower()))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w.encode("utf-8", "replace")) for w in counts), np.uint64, len(counts))
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(counts.values(), np.int64, len(counts))[order]


class Index(NamedTuple):
    terms: np.ndarray  # ascending hashes
    weight: np.ndarray  # of each term
    ids: np.ndarray  # of the examples
    labels: np.ndarray
    frequent: np.ndarray  # of each term: its number among the frequent ones, or -1
    start: np.ndarray  # postings of rare term t: start[t] to start[t + 1]
    example: np.ndarray
    value: np.ndarray
    row: np.ndarray  # frequent terms of example i: row[i] to row[i + 1]
    column: np.ndarray
    entry: np.ndarray
    length: np.ndarray  # of each example's vector of frequent terms
    most: np.ndarray  # largest entry of each frequent term (row) in each block
    curve: np.ndarray  # intercept and slope of the calibration

    @property
    def learned(self) -> bool:
        """Whether there are examples of both classes."""
        return bool(len(self.labels)) and 0 < int(self.labels.sum()) < len(self.labels)


def term_weights(df: np.ndarray, positive: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """idf times the share by which a term tells the classes apart."""
    p, q, overall = positive / max(toxic, 1), (df - positive) / max(n - toxic, 1), df / n
    spread = np.sqrt(np.maximum(overall * (1 - overall), 1e-12) / max(toxic * (n - toxic) / n, 1e-12) * n)
    return np.log(1 + n / df) * np.clip(((p - q) / spread - SURE / np.sqrt(n)) / FULL_PHI, LEAST_SHARE, 1)


def vector(index: Index, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and unit weights of a text; words that no example has are left out."""
    if not len(index.terms):
        return np.empty(0, np.int64), np.empty(0)
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[at] == hashes
    at = at[known]
    w = (1 + np.log(counts[known])) * index.weight[at]
    return at, w / np.sqrt((w * w).sum()) if len(w) else w


def build_index(ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], rare: int = RARE) -> Index:
    """The index of examples, given as hashes and counts; the calibration is still to be fitted."""
    n = len(ids)
    many = np.array([len(h) for h, _ in vectors], np.int64)
    hashes = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in vectors)])
    terms, term = np.unique(hashes, return_inverse=True)
    term = term.astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), many)
    del hashes
    y = np.array(labels, np.int64)
    df = np.bincount(term, minlength=len(terms))
    weight = term_weights(df, np.bincount(term, y[owner], len(terms)), max(n, 1), int(y.sum()))
    w = (1 + np.log(np.concatenate([np.ones(0), *(c for _, c in vectors)]))) * weight[term]
    norms = np.sqrt(np.bincount(owner, w * w, n))
    w = w / norms[owner]
    # Examples with the same heaviest term lie together, so that a block's largest weights are those of few terms.
    heaviest = np.full(n, -1, np.int64)
    order = np.lexsort((term, w, owner))
    last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True)) if len(order) else order
    heaviest[owner[order][last]] = term[order][last]
    del order, last
    place = np.empty(n, np.int32)
    sort = np.lexsort((np.array(ids, np.int64), heaviest))
    place[sort] = np.arange(n)
    owner = place[owner]
    frequent = np.full(len(terms), -1, np.int64)
    often = np.flatnonzero(df * rare > n)
    frequent[often] = np.arange(len(often))
    short = np.flatnonzero(frequent[term] < 0)
    short = short[np.lexsort((owner[short], term[short]))]
    long = np.flatnonzero(frequent[term] >= 0)
    long = long[np.lexsort((term[long], owner[long]))]
    most = np.zeros((len(often), max(1, -(-n // BLOCK))), np.float32)
    entry = w[long].astype(np.float32)
    np.maximum.at(most, (frequent[term[long]], owner[long] // BLOCK), entry)
    return Index(
        terms, weight, np.array(ids, np.int64)[sort], y[sort], frequent,
        np.searchsorted(term[short], np.arange(len(terms) + 1)), owner[short].astype(np.int32), w[short].astype(np.float32),
        np.searchsorted(owner[long], np.arange(n + 1)), frequent[term[long]].astype(np.int32), entry,
        np.sqrt(np.bincount(owner[long], entry.astype(np.float64) ** 2, n)), most, np.array([0.0, 1.0]),
    )


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` examples of largest cosine above 0, the first ones among equals, and the cosines; ``without`` is passed over."""
    n = len(index.ids)
    often = index.frequent[terms]
    t, w = terms[often < 0], weights[often < 0]
    first, many = index.start[t], index.start[t + 1] - index.start[t]
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    total = np.bincount(index.example[at], index.value[at] * np.repeat(w, many), n)
    dense = np.zeros(len(index.most))
    often, heavy = often[often >= 0], weights[often >= 0]
    dense[often] = heavy
    # What frequent terms can add: no more than a block's largest entries give, nor than the lengths of both parts give.
    by_block = np.repeat((index.most[often] * heavy[:, None]).sum(axis=0), BLOCK)[:n]
    bounds = total + np.minimum(by_block, np.sqrt((heavy * heavy).sum()) * index.length) + 1e-6
    if without >= 0:
        bounds[without] = 0
    best, cosines, least, step = np.empty(0, np.int64), np.empty(0), 1e-6, 2 * k
    left = np.flatnonzero(bounds > least)
    while len(left):
        some = left
        if len(left) > step:
            some = left[np.argpartition(-bounds[left], step)[:step]]
            bounds[some] = -1
        begin, size = index.row[some], index.row[some + 1] - index.row[some]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        sums = np.bincount(np.repeat(np.arange(len(some)), size), dense[index.column[at]] * index.entry[at], len(some)) + total[some]
        hit = np.flatnonzero(sums > 0)
        best, cosines = np.concatenate([best, some[hit]]), np.round(np.concatenate([cosines, sums[hit]]), 9)
        keep = np.lexsort((best, -cosines))[:k]
        best, cosines = best[keep], cosines[keep]
        if len(some) == len(left):
            break
        if len(cosines) == k:
            least = cosines[-1]
        left, step = left[bounds[left] >= least], step * 4
    return best, cosines


def vote(index: Index, best: np.ndarray, cosines: np.ndarray) -> float:
    """The log odds of the neighbours' votes, drawn a little towards the rate of all examples."""
    rate, votes = float(index.labels.mean()), cosines**2
    share = (float(votes @ index.labels[best]) + 0.02 * rate) / (float(votes.sum()) + 0.02)
    return float(np.log(share / (1 - share)))


def score(index: Index, hashes: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
    """The calibrated score of a text, and its nearest examples as id, cosine and label."""
    if not index.learned:
        return 0.5, []
    best, cosines = nearest(index, *vector(index, hashes, counts))
    value = 1 / (1 + np.exp(-(index.curve[0] + index.curve[1] * vote(index, best, cosines))))
    return float(value), [(int(index.ids[b]), float(c), int(index.labels[b])) for b, c in zip(best[:EVIDENCE], cosines)]


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slope of the logistic curve of ``y`` over ``x``, with a little weight on the identity."""
    design, curve, prior = np.stack([np.ones(len(x)), x], 1), np.array([0.0, 1.0]), 0.1 * np.eye(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ curve))
        gradient = design.T @ (y - p) - prior @ (curve - [0.0, 1.0])
        curve = curve + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + prior, gradient)
    return curve


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
    max_postings: int = MAX_POSTINGS,
) -> Index:
    """The index of at most ``max_examples`` labelled texts with at most ``max_postings`` distinct words in all.

    A document with several labels counts as toxic if one of them says so; null
    labels and ids, and labels without a document, are left out; rows that agree
    in id and text are one example.  Without examples of both classes nothing is
    learned and every score is one half.  The driver gets the sample's word
    counts, which the two numbers bound.
    """
    spark = docs.sparkSession
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    keyed = texts.select("id", F.xxhash64("id", "text").alias("key")).filter("id is not null")
    chosen = keyed.join(marks, "id").distinct().orderBy("key", "id").limit(max_examples).collect()
    if not chosen:
        return build_index([], [], [])
    taken = F.broadcast(spark.createDataFrame([(r["key"], r["id"], r["label"]) for r in chosen], "key long, id long, label int"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            made = [word_counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "label")), pa.array([len(h) for h, _ in made], pa.int64()), *(pa.array([x.tobytes() for x in column], pa.binary()) for column in ([h for h, _ in made], [c.astype(np.int32) for _, c in made]))], ["key", "id", "label", "n", "hashes", "counts"])

    found = texts.withColumn("key", F.xxhash64("id", "text")).join(taken, ["key", "id"]).select("key", "id", "label", "text")
    sample = write_shared(found.mapInArrow(counted, "key long, id long, label int, n long, hashes binary, counts binary"), "toxic-examples")
    # Repeated rows are one example; the rest stops where the words exceed the bound.
    sizes = sorted({(r["key"], r["id"], r["n"]) for r in sample.select("key", "id", "n").distinct().collect()})
    fit = [(k, i) for (k, i, _), upto in zip(sizes, np.cumsum([n for *_, n in sizes]).tolist()) if upto <= max_postings]
    # The order by key, a hash, deals the examples to the parts.
    kept = F.broadcast(spark.createDataFrame([(k, i, at % FOLDS) for at, (k, i) in enumerate(fit)], "key long, id long, fold int"))
    sample = sample.join(kept, ["key", "id"]).dropDuplicates(["key", "id"])
    rows = sample.orderBy("key", "id").collect()
    vectors = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in rows]
    ids, marked, part = [r["id"] for r in rows], [int(r["label"] > 0) for r in rows], [r["fold"] for r in rows]
    del rows
    votes = []
    for fold_ in range(FOLDS):
        others = [k for k, p in enumerate(part) if p != fold_]
        index = build_index([ids[k] for k in others], [marked[k] for k in others], [vectors[k] for k in others])
        if index.learned:
            votes += votes_on(sample.filter(F.col("fold") == fold_), index)
        del index
    index = build_index(ids, marked, vectors)
    return index._replace(curve=fit_curve(np.array([v for v, _ in votes]), np.array([y for _, y in votes], float)))


def votes_on(sample: DataFrame, index: Index) -> list[tuple[float, int]]:
    """The vote on each example of ``sample``, none of which the index holds, and its label."""
    shared = sample.sparkSession.sparkContext.broadcast(tuple(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for batch in batches:
            found = [vote(own, *nearest(own, *vector(own, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)))) for h, c in zip(*(batch.column(x).to_pylist() for x in ("hashes", "counts")))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.float64())], ["label", "vote"])
        give_back()

    dealt = sample.select("label", "hashes", "counts").repartition(sample.sparkSession.sparkContext.defaultParallelism)
    votes = dealt.mapInArrow(run, "label int, vote double").orderBy("vote", "label").collect()
    shared.unpersist()
    return [(r["vote"], int(r["label"] > 0)) for r in votes]


def score_toxicity(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` as ``__doc``, with ``__score`` and ``__evidence`` (id, cosine and label of the nearest examples).

    Null texts count as empty.  Every text is scored whole; equal texts get
    equal scores; a text without a known word gets the examples' rate,
    calibrated.  A very long text counts whole, and needs memory for its distinct
    words.  An empty table gives no row; columns of any name pass within
    ``__doc``.  What is sent to all tasks is bounded by ``learn``.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(index))
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value)
        for batch in slices(batches, "doc", 2 << 20, text_col):
            texts = batch.column("doc").field(text_col).cast(pa.string()).to_pylist()
            results = [score(own, *word_counts(t or "")) for t in texts]
            evidence = [[{"doc_id": i, "cosine": c, "label": y} for i, c, y in e] for _, e in results]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([s for s, _ in results], pa.float64()), pa.array(evidence, near)], ["__doc", "__score", "__evidence"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(run, f"__doc {rows.schema['doc'].dataType.simpleString()}, __score double, __evidence array<struct<doc_id:long,cosine:double,label:int>>")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def learn_train(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the training fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0)
    return learn(documents(spark, sf_dir), labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is in no fold, so not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_toxicity(docs, learn_train(spark, sf_dir))
    out = F.coalesce(fold("__doc.doc_id") == 0, F.lit(False))
    return scored.select("__doc.doc_id", out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__evidence").alias("evidence"))
