"""Search: lines that any of several patterns matches, each match with the patterns it is due to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PatternSet
from .prefilter import candidates

#: Patterns from which on they are looked for by their texts first.
MANY = 8


def matching_lines(lines: DataFrame, patterns: PatternSet) -> DataFrame:
    return lines.filter(F.col("line").rlike(patterns.combined))


def _texts(line: Column, regex: str | Column) -> Column:
    return F.regexp_extract_all(line, F.lit(regex), F.lit(0))


def submatches(line: Column, regex: str | Column) -> Column:
    """``array<struct<text, start, end>>``: what the expression matches, left to right, in bytes of the line."""
    found = _texts(line, regex)
    # Each match with the text before it; the place where it begins runs along.
    parts = F.arrays_zip(F.slice(F.split(line, regex, -1), 1, F.size(found)).alias("before"), found.alias("text"))
    kind = "array<struct<text:string,start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.octet_length(x["before"])
        end = start + F.octet_length(x["text"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(x["text"].alias("text"), start.alias("start"), end.alias("end"))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def matches(lines: DataFrame, patterns: PatternSet, with_submatches: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line and each pattern that it is due to; with ``more`` of the lines' columns, if asked.

    A line is due to a pattern if one of the pattern's own matches is among
    the matches of the alternation; so a pattern whose matches an earlier one
    always takes isn't reported.  Many patterns are looked for by texts that
    their matches must hold first (see ``prefilter``).
    """
    patterns.check(lines.sparkSession)
    if len(patterns.patterns) >= MANY:
        return _matches_of_many(lines, patterns, with_submatches, more)
    found = matching_lines(lines, patterns).withColumn("__texts", _texts(F.col("line"), patterns.combined))
    due = [F.when(F.arrays_overlap(_texts(F.col("line"), patterns.regex(k)), F.col("__texts")), F.lit(i)) for k, i in enumerate(patterns.ids)]
    out = found.withColumn("pattern_id", F.explode(F.array_compact(F.array(*due))))
    out = out.select("pattern_id", "file_id", F.col("start_offset").alias("offset"), "line_number", F.col("line").alias("line_text"), *more)
    if with_submatches:
        out = out.withColumn("submatches", submatches(F.col("line_text"), patterns.combined))
    return out


def _matches_of_many(lines: DataFrame, patterns: PatternSet, with_submatches: bool, more: tuple[str, ...]) -> DataFrame:
    """``matches``, with only those patterns tried on a line that it can match.

    Patterns that match nowhere in a line can be left out of the alternation.
    """
    regexes = F.array(*(F.lit(patterns.regex(k)) for k in range(len(patterns.patterns))))
    one = lambda k: F.element_at(regexes, k + 1)
    found = candidates(lines.select("file_id", "line_number", "start_offset", "line", *more), patterns)
    found = found.withColumn("__any", F.array_join(F.transform("__patterns", lambda k: F.concat(F.lit("(?:"), one(k), F.lit(")"))), "|"))
    found = found.withColumn("__texts", _texts(F.col("line"), F.col("__any"))).filter(F.size("__texts") > 0)
    found = found.withColumn("__k", F.explode("__patterns")).filter(F.arrays_overlap(_texts(F.col("line"), one(F.col("__k"))), F.col("__texts")))
    out = found.select(F.concat(F.lit("p"), (F.col("__k") + 1).cast("string")).alias("pattern_id"), "file_id", F.col("start_offset").alias("offset"), "line_number", F.col("line").alias("line_text"), *more, "__any")
    if with_submatches:
        out = out.withColumn("submatches", submatches(F.col("line_text"), F.col("__any")))
    return out.drop("__any")


def ordered(found: DataFrame, most: int | None = None) -> DataFrame:
    """Matches by file, offset and pattern, ids as text; with ``most``, the first of them only."""
    by = found.orderBy(F.col("file_id").cast("string"), "offset", "pattern_id")
    return by if most is None else by.limit(most)


def contexts(found: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """Lines around each match, the matched one included: an equi-join on file and line."""
    wanted = found.select("pattern_id", "file_id", F.col("offset").alias("match_offset"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_number") - before), F.col("line_number") + after)).alias("line_number"))
    near = lines.select("file_id", "line_number", F.col("start_offset").alias("line_offset"), F.col("line").alias("line_text"))
    return wanted.join(near, ["file_id", "line_number"])


def context_map(around: DataFrame) -> DataFrame:
    """One row for each match: its key ``pattern:file:offset`` and its lines in order."""
    key = F.concat_ws(":", "pattern_id", F.col("file_id").cast("string"), F.col("match_offset").cast("string"))
    return around.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("line_number", "line_offset", "line_text"))).alias("lines"))


def per_file(found: DataFrame) -> DataFrame:
    return found.groupBy("file_id").agg(F.count("*").alias("n_matches"), F.countDistinct("line_number").alias("n_lines"))


def per_pattern(found: DataFrame, patterns: PatternSet) -> DataFrame:
    """Matches by pattern, patterns without a match included."""
    names = found.sparkSession.createDataFrame(list(zip(patterns.ids, patterns.patterns)), "pattern_id string, pattern string")
    counts = found.groupBy("pattern_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("f"))
    return names.join(counts, "pattern_id", "left").select("pattern_id", "pattern", F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce("f", F.lit(0)).alias("n_files"))


def with_names(found: DataFrame, files: DataFrame, patterns: PatternSet) -> DataFrame:
    """Matches with the path of their file (``file_id, path``) and the text of their pattern.

    The patterns are literals in the plan; Spark picks the join with the files by their size.
    """
    text = F.create_map(*[F.lit(x) for pair in zip(patterns.ids, patterns.patterns) for x in pair])[F.col("pattern_id")]
    return found.join(files.select("file_id", "path"), "file_id").withColumn("pattern", text)


def first_of_each(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct values of a column, in the order of their first row."""
    return rows.groupBy(name).agg(F.min(order).alias("first")).orderBy("first")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object for each row; absent arrays are empty ones."""
    filled = [F.coalesce(F.col(f.name), F.array()).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*filled)).alias("json"))
