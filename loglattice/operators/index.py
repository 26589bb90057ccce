"""The line index: length statistics, line endings, sparse checkpoints and look-ups in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .jumps import STRETCH, follow, kind_of, taken, with_stretch
from .stored import kept
from .survey import ENDING_BYTES, survey

LARGE_FILE = 50 << 20
STEP = LARGE_FILE // 50
ENDING_SAMPLE = ENDING_BYTES
#: Later parts of files whose entries are sent to all tasks; more are chosen from by stretches of lines.
MOST_SENT = 100_000


def line_stats(lines: DataFrame) -> DataFrame:
    """Counts and length statistics by file, blank lines left out of the lengths."""
    size = F.octet_length(F.rtrim(F.col("line"), F.lit("\r\n")))
    lines = lines.select("file_id", "line_number", "start_offset", F.when(~is_blank(F.col("line")), size).alias("__full"))
    full = F.col("__full")
    longest = F.max_by(F.struct("line_number", "start_offset"), F.struct(full.alias("n"), (-F.col("line_number")).alias("k")))
    out = lines.groupBy("file_id").agg(
        F.count("*").alias("line_count"),
        F.count_if(full.isNull()).alias("empty_line_count"),
        F.coalesce(F.max(full), F.lit(0)).alias("line_length_max"),
        F.coalesce(F.avg(full), F.lit(0.0)).alias("line_length_avg"),
        F.percentile(full, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"),
        F.coalesce(F.stddev_samp(full), F.lit(0.0)).alias("line_length_stddev"),
        F.max(F.when(full.isNotNull(), F.lit(1))).alias("any"),
        longest.alias("longest"),
    )
    parts = [F.coalesce(F.col("p")[k], F.lit(0.0)).alias(n) for k, n in enumerate(("line_length_median", "line_length_p95", "line_length_p99"))]
    some = F.col("any").isNotNull()
    return out.select(
        "file_id", "line_count", "empty_line_count", "line_length_max", "line_length_avg", *parts, "line_length_stddev",
        F.when(some, F.col("longest.line_number")).alias("max_line_number"), F.when(some, F.col("longest.start_offset")).alias("max_byte_offset"),
    )


def line_endings(lines: DataFrame, sample: int = ENDING_SAMPLE) -> DataFrame:
    """``LF, CRLF, CR`` or ``mixed`` by file, from the lines that begin in its first bytes; none counts as LF."""
    size = F.col("end_offset") - F.col("start_offset") - F.octet_length("line")
    lone = F.length("line") - F.length(F.replace(F.col("line"), F.lit("\r"), F.lit("")))
    seen = lines.filter(F.col("start_offset") < sample).groupBy("file_id").agg(F.count_if(size == 2).alias("crlf"), F.count_if(size == 1).alias("lf"), F.sum(lone).alias("cr"))
    return seen.select("file_id", _ending(F.col("crlf"), F.col("lf"), F.col("cr")).alias("line_ending"))


def _ending(crlf: Column, lf: Column, cr: Column) -> Column:
    kinds = sum((c > 0).cast("int") for c in (crlf, lf, cr))
    return F.when(kinds > 1, "mixed").when(crlf > 0, "CRLF").when(cr > 0, "CR").otherwise("LF")


def stats_of(parts: DataFrame) -> DataFrame:
    """``line_stats`` and ``line_ending`` by file, from the ``stats`` of one pass (see ``survey``); all figures are exact."""
    rows = parts.filter("family = 'stats'").select("file_id", "xs", F.posexplode_outer(F.arrays_zip(F.slice("xs", 10, F.greatest(F.size("xs") - 9, F.lit(0))).alias("size"), F.col("ys").alias("n"))).alias("pos", "p"))
    rows = rows.select("file_id", "xs", F.col("p.size").alias("size"), F.col("p.n").alias("n"), (F.coalesce("pos", F.lit(0)) == 0).alias("head"))
    total = lambda k: F.sum(F.when(F.col("head"), F.col("xs")[k]))
    size, many, wide = F.col("size"), F.col("n"), F.col("size").cast("decimal(19,0)")
    out = rows.groupBy("file_id").agg(
        *(total(k).alias(n) for k, n in enumerate(("line_count", "empty_line_count", "crlf", "lf", "cr"))),
        F.max("size").alias("most"), F.sum(many).alias("full"), F.sum(size * many).alias("bytes"),
        F.sum((wide * wide).cast("decimal(38,0)") * many).cast("decimal(38,0)").alias("squares"),
        F.percentile(size, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.coalesce(many, F.lit(0))).alias("p"),
        F.max_by(F.struct(F.col("xs")[7].alias("line"), F.col("xs")[8].alias("at")), F.struct(F.col("xs")[6].alias("n"), (-F.col("xs")[7]).alias("k"))).alias("longest"),
    )
    n = F.col("full").cast("decimal(19,0)")
    spread = F.try_divide((n * F.col("squares") - F.col("bytes").cast("decimal(19,0)") * F.col("bytes")).cast("double"), (n * (n - 1)).cast("double"))
    parts = [F.coalesce(F.col("p")[k], F.lit(0.0)).alias(c) for k, c in enumerate(("line_length_median", "line_length_p95", "line_length_p99"))]
    some = F.col("full").isNotNull()
    return out.select(
        "file_id", "line_count", "empty_line_count", F.coalesce("most", F.lit(0)).cast("int").alias("line_length_max"), F.coalesce(F.col("bytes") / F.col("full"), F.lit(0.0)).alias("line_length_avg"), *parts,
        F.coalesce(F.sqrt(spread), F.lit(0.0)).alias("line_length_stddev"), F.when(some, F.col("longest.line")).alias("max_line_number"), F.when(some, F.col("longest.at")).alias("max_byte_offset"),
        _ending(F.col("crlf"), F.col("lf"), F.col("cr")).alias("line_ending"),
    )


def checkpoints(lines: DataFrame, step: int = STEP) -> DataFrame:
    """``file_id, line_number, byte_offset``: line 1, then each first line that begins ``step`` bytes or more after the last.

    Each checkpoint hangs on the one before.  A pass over the lines, made when
    this is called, gives those of the parts that begin a file; of other parts it
    gives where each is left by where it is entered.  Only if there are such
    parts are the lines read again, once all entries are known.
    """
    return points_of(lines, kept(survey(lines, ("point",), step)), step)


def points_of(lines: DataFrame, parts: DataFrame, step: int) -> DataFrame:
    """The checkpoints of ``lines``, from the ``point``, ``jump`` and ``tail`` rows of one pass."""
    first = parts.filter("family = 'point'").select("file_id", "line_number", F.col("start_offset").alias("byte_offset"))
    kind = kind_of(lines)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place = None, step
        for batch in batches:
            entries = []
            for f, family, upto, out in zip(*(batch.column(c).to_pylist() for c in ("file_id", "family", "xs", "ys"))):
                if f != file:
                    file, place = f, step
                entries.append(place)
                if family == "tail":
                    place = upto[0]
                else:
                    k = int(np.searchsorted(np.array(upto), place))
                    place = out[k] if k < len(out) else place
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file_id", "family", "line_number")), pa.array(entries, pa.int64())], ["file_id", "family", "line_number", "entry"])

    later = parts.filter("family = 'jump'")
    many = later.count()
    if not many:
        return first
    if many > MOST_SENT:
        return _by_stretches(lines, step)
    ends = parts.filter("family in ('jump', 'tail')").join(F.broadcast(later.select("file_id").distinct()), "file_id", "left_semi")
    ends = ends.repartition("file_id").sortWithinPartitions("file_id", "line_number").select("file_id", "family", "line_number", "xs", "ys")
    known = {(r["file_id"], r["line_number"]): r["entry"] for r in ends.mapInArrow(chain, f"file_id {kind}, family string, line_number long, entry long").filter("family = 'jump'").collect()}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, following, place = None, 0, None
        for batch in batches:
            number, end = batch.column("line_number").to_numpy(), batch.column("end_offset").to_numpy()
            code = batch.column("file_id").dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (number[1:] != number[:-1] + 1)) + 1 if len(number) else []
            for a, b in zip([0, *cuts], [*cuts, len(number)]):
                if a == b:
                    continue
                f, at = batch.column("file_id")[int(a)].as_py(), int(number[a])
                if f != file or at != following:
                    place = None if at == 1 else known[f, at]
                file, following = f, int(number[b - 1]) + 1
                if place is not None:
                    taken_rows = int(a) + np.array(follow(end[a:b], end[a:b] + step, place), np.int64)
                    if len(taken_rows):
                        place = int(end[taken_rows[-1]]) + step
                        yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array(taken_rows)), pa.array(number[taken_rows] + 1), pa.array(end[taken_rows])], ["file_id", "line_number", "byte_offset"])

    rest = lines.select("file_id", "line_number", "end_offset").mapInArrow(choose, f"file_id {kind}, line_number long, byte_offset long")
    return first.unionByName(rest)


def _by_stretches(lines: DataFrame, step: int, size: int = STRETCH) -> DataFrame:
    """Checkpoints of any number of parts: stretches of ``size`` lines are dealt out and chosen from (see ``jumps``)."""
    end = F.col("end_offset")
    items = with_stretch(lines, size).select("file_id", "__stretch", end.alias("at"), (end + step).alias("next"), (F.col("line_number") + 1).alias("line_number"))
    later = taken(items, step).select("file_id", "line_number", F.col("at").alias("byte_offset"))
    first = lines.filter("line_number = 1").select("file_id", F.lit(1).cast("long").alias("line_number"), F.lit(0).cast("long").alias("byte_offset"))
    return first.unionByName(later)


def nearest_before(wanted: DataFrame, points: DataFrame, at: str, place: str, bucket: int) -> DataFrame:
    """As-of join: ``wanted`` (``file_id`` and ``at``) with ``found``, the row of ``points`` with the last ``place`` not after it.

    ``points`` keep all their columns in ``found``.  Both sides are dealt by
    file and by buckets of so many places, and a window runs within a bucket;
    one row for each bucket of points carries the last one over, so no task
    holds a file and no pairs are made.
    """
    row = F.struct(*[F.col(c) for c in points.columns if c != "file_id"])
    kind = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in points.schema.fields if f.name != 'file_id')}>"
    own = points.select("file_id", F.col(place).cast("long").alias("__at"), row.alias("__point"), F.lit(None).cast("long").alias("__wanted"))
    asked = wanted.select("file_id", F.col(at).cast("long").alias("__at"), F.lit(None).cast(kind).alias("__point"), F.col(at).cast("long").alias("__wanted"))
    both = own.unionByName(asked).withColumn("__bucket", F.floor(F.col("__at") / bucket))
    within = Window.partitionBy("file_id", "__bucket").orderBy("__at", F.col("__wanted").isNotNull())
    found = both.withColumn("__own", F.last("__point", ignorenulls=True).over(within)).filter("__wanted is not null")
    ends = both.groupBy("file_id", "__bucket").agg(F.max_by("__point", F.when(F.col("__point").isNotNull(), F.col("__at"))).alias("__end"))
    before = Window.partitionBy("file_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file_id", "__bucket", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    out = found.join(carried, ["file_id", "__bucket"])
    return out.select("file_id", F.col("__wanted").alias(at), F.coalesce("__own", "__carried").alias("found"))


def nearest_checkpoint(wanted: DataFrame, points: DataFrame, by: str = "line_number", bucket: int = 1 << 20) -> DataFrame:
    """To each row of ``wanted`` (``file_id`` and ``by``) the last checkpoint not after it."""
    named = points.select("file_id", F.col("line_number").alias("checkpoint_line"), F.col("byte_offset").alias("checkpoint_offset"))
    found = nearest_before(wanted, named, by, "checkpoint_line" if by == "line_number" else "checkpoint_offset", bucket)
    return found.select("file_id", by, "found.*")


def build(lines: DataFrame, step: int = STEP, analyze: bool = False, files: DataFrame | None = None, window: int | None = None, lengths: bool = False) -> DataFrame:
    """One row for each file: statistics, ending, bytes and the checkpoints as an array of (line, offset).

    ``analyzed`` tells whether ``anomalies`` were looked for.  With ``files``
    (``path, size, mtime``, the path being the file's id) the row also has these,
    as kept indexes need; with ``lengths`` each line length with its number, so
    that indexes can be merged.  The lines are read once when this is called, and once
    more if a file lies in several parts.
    """
    from . import detectors

    seen = detectors.window_lines(window)
    families = ("stats", "point", *(detectors.families_of() if analyze else ()))
    parts = kept(survey(lines, tuple(dict.fromkeys(families)), step, seen))
    points = points_of(lines, parts, step).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "byte_offset"))).alias("line_index"))
    sizes = parts.filter("family = 'stats'").groupBy("file_id").agg(F.max("end_offset").alias("byte_count"))
    out = stats_of(parts).join(sizes, "file_id").join(points, "file_id").withColumn("analyzed", F.lit(analyze))
    if analyze:
        found = detectors.anomalies_of(parts, window=window)
        shape = F.struct(*[F.col(c) for c in found.columns if c != "file_id"])
        each = found.groupBy("file_id").agg(F.array_sort(F.collect_list(shape)).alias("anomalies"))
        out = out.join(each, "file_id", "left").withColumn("anomalies", F.coalesce("anomalies", F.array().cast(each.schema["anomalies"].dataType)))
    if lengths:
        pairs = parts.filter("family = 'stats'").select("file_id", F.explode(F.arrays_zip(F.slice("xs", 10, F.greatest(F.size("xs") - 9, F.lit(0))).alias("size"), F.col("ys").alias("n"))).alias("p"))
        pairs = pairs.groupBy("file_id", "p.size").agg(F.sum("p.n").alias("n")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("lengths"))
        out = out.join(pairs, "file_id", "left")
    if files is not None:
        out = out.join(files.select(F.col("path").alias("file_id"), "path", "size", "mtime"), "file_id")
    return out


def merged(index: DataFrame, by: str | None = None) -> DataFrame:
    """The line statistics of all files of kept indexes together, or of each value of a column, without a scan.

    The indexes need their ``lengths`` (see ``build``); the percentiles are exact.
    """
    keys = [by] if by else []
    one = F.posexplode_outer("lengths").alias("pos", "p")
    rows = index.select(*keys, "line_count", "empty_line_count", one).withColumn("head", F.coalesce("pos", F.lit(0)) == 0)
    size, many = F.col("p.size"), F.col("p.n")
    out = rows.groupBy(*keys).agg(
        *(F.sum(F.when(F.col("head"), F.col(c))).alias(c) for c in ("line_count", "empty_line_count")), F.max(size).alias("line_length_max"),
        (F.sum(size * many) / F.sum(many)).alias("line_length_avg"), F.percentile(size, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.coalesce(many, F.lit(0))).alias("p"),
    )
    named = [F.coalesce(F.col("p")[k], F.lit(0.0)).alias(c) for k, c in enumerate(("line_length_median", "line_length_p95", "line_length_p99"))]
    return out.select(*keys, "line_count", "empty_line_count", F.coalesce("line_length_max", F.lit(0)).alias("line_length_max"), F.coalesce("line_length_avg", F.lit(0.0)).alias("line_length_avg"), *named)


def needs_index(size: Column, analyze: bool = False, threshold: int = LARGE_FILE) -> Column:
    """Files under the threshold are left out, unless they are to be analyzed."""
    return (size >= threshold) | F.lit(analyze)
