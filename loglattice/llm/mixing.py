"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / quality``; within a source,
ascending keys are a weighted random order.  A source whose target is above
its size gives complete epochs first; what is left of the target is filled in
key order until the prefix sum of sizes reaches it.

The order within a source is never made in one task.  Keys are numbers of
``BITS`` bits, and the place where a budget ends is found digit by digit: sizes
are summed by the next digit, and only rows of the one digit in which the
budget ends go on, until a few are left; these alone are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, documents, text_of, write_shared

#: Documents of a source that are sorted in one task at most, unless their keys agree in all digits.
BUCKET_ROWS = 4096
#: Logarithms of keys lie between -64 and 64; as whole numbers they have this many bits, in digits of so many.
BITS, DIGIT = 48, 8
#: Sources up to this number are sent to all tasks; beyond it Spark joins them.
BROADCAST_SOURCES = 20_000


def water_fill(sizes: dict[str | None, int], weights: tuple[float, ...], share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Targets by source: shares of all sizes by weight, at most ``most`` times a source's size.

    What a capped source leaves is shared among the others by weight until
    none is above its cap.  Sources are taken by code point, null last, and
    weigh ``weights``, repeated.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in above)
        free = [s for s in free if s not in target]
    return target


def quality(text):
    """A document's weight from its text alone: the share of letters and spaces, never 0."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.greatest(plain / F.greatest(F.length(text), F.lit(1)), F.lit(0.01))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    most: float = 3.0,
) -> DataFrame:
    """The documents with ``__size, __source_size, __target, __copies``.

    ``__copies`` says how often the mix takes the whole document; documents
    are not cut, so a source misses its target by half a document at most.
    Null texts have size 0 and are taken with the epochs only; null sources
    are a source of their own, the last one.  Keys hang on the seed, the id and
    the text, so reruns agree; equal rows have equal keys and are ordered by
    nothing else.  An empty table gives an empty result.  The driver gets one
    row for each source, whose number is set by those who configure weights.
    """
    text = text_of(docs, text_col)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(uniform) / quality(text)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        F.col(source_col).alias("__source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("__size"),
        key.alias("__key"),
    )
    # The logarithm grows with the key, so its digits are in the order of keys.
    scale = float(1 << (BITS - 7))
    number = F.least(F.greatest((F.log("__key") + 64) * scale, F.lit(0.0)), F.lit(128 * scale - 1)).cast("long")
    # Written once, so that texts are measured once.
    rows = write_shared(rows.withColumn("__number", number), "mix-rows")
    plan = _selection(rows.select("__source", "__number", "__key", "__size"), weights, most)
    digits = F.expr("shiftright(__number, __shift)")
    picked = (digits < F.col("__edge")) | ((digits == F.col("__edge")) & (F.col("__key") <= F.col("__last")))
    return (
        rows.join(_by_source(docs.sparkSession, plan), F.col("__source").eqNullSafe(F.col("__s")))
        .withColumn("__copies", F.col("__epochs") + picked.cast("int"))
        .select("__doc", "__size", "__source_size", "__target", "__copies")
    )


def _by_source(spark: SparkSession, plan: list[dict]) -> DataFrame:
    names = ["__s", "__source_size", "__target", "__epochs", "__left", "__edge", "__shift", "__before", "__last"]
    df = spark.createDataFrame([tuple(p[n] for n in names) for p in plan], "__s string, __source_size long, __target double, __epochs int, __left double, __edge long, __shift int, __before double, __last double")
    return F.broadcast(df) if len(plan) <= BROADCAST_SOURCES else df


def _selection(narrow: DataFrame, weights: tuple[float, ...], most: float) -> list[dict]:
    """For each source: its target, complete epochs, and the last key that the fraction takes."""
    spark = narrow.sparkSession
    sizes = {r["__source"]: int(r["n"]) for r in narrow.groupBy("__source").agg(F.sum("__size").alias("n")).collect()}
    targets = water_fill(sizes, weights, most=most)
    plan = []
    for s, size in sizes.items():
        epochs = int(targets[s] / size + 1e-9) if size else 0
        left = max(0.0, float(targets[s] - epochs * size))
        plan.append({"__s": s, "__source_size": size, "__target": float(targets[s]), "__epochs": epochs, "__left": left, "__edge": -1 if left == 0 else 0, "__shift": BITS, "__before": 0.0, "__last": -1.0})
    by = {p["__s"]: p for p in plan}
    same, digits = F.col("__source").eqNullSafe(F.col("__s")), F.expr("shiftright(__number, __shift)")
    # Sums are made by source and digit first, not with all rows of a source in one task.
    upto = F.sum("n").over(Window.partitionBy(F.struct("__source")).orderBy("digit"))
    # The sources whose edge isn't found to a few rows yet.
    open_ = [p for p in plan if p["__left"] > 0]
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        if not open_:
            break
        sums = (
            narrow.join(_by_source(spark, open_), same & (digits == F.col("__edge")))
            .groupBy("__source", "__before", "__left", F.shiftright("__number", shift).alias("digit"))
            .agg(F.sum("__size").alias("n"), F.count("*").alias("rows"))
            .withColumn("upto", F.col("__before") + upto)
        )
        found = sums.filter((F.col("upto") - F.col("n") < F.col("__left")) & (F.col("upto") >= F.col("__left"))).collect()
        for r in found:
            by[r["__source"]].update(__edge=r["digit"], __shift=shift, __before=float(r["upto"] - r["n"]))
        open_ = [by[r["__source"]] for r in found if r["rows"] > BUCKET_ROWS]
    # Only rows of those digits are sorted; the last document is the one that ends nearest the budget.
    by_key = Window.partitionBy("__source").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        narrow.join(_by_source(spark, plan), same & (digits == F.col("__edge")))
        .groupBy("__source", "__key", "__before", "__left")
        .agg(F.sum("__size").alias("n"))
        .withColumn("upto", F.col("__before") + F.sum("n").over(by_key))
        .filter(F.col("upto") - F.col("n") / 2 <= F.col("__left"))
        .groupBy("__source")
        .agg(F.max("__key").alias("last"))
    )
    for r in ends.collect():
        by[r["__source"]]["__last"] = r["last"]
    return plan


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("__doc.doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
