"""The inputs of the registered queries: the tables as lines, and log lines made from events.

The same SQL text makes the log lines in Spark and in the SQL that checks it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import STRETCH
from ..sources.lines import lines_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")


#: ``lines``: the lines of all documents.
LINES_SQL = """split AS (
  SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_number, len(string_split(text, chr(10))) AS n
  FROM documents),
sized AS (SELECT *, strlen(line) + CASE WHEN line_number < n THEN 1 ELSE 0 END AS size FROM split),
lines AS (
  SELECT file_id, CAST(line_number AS BIGINT) AS line_number, CAST(end_at - size AS BIGINT) AS start_offset,
         CAST(end_at AS BIGINT) AS end_offset, line
  FROM (SELECT *, sum(size) OVER (PARTITION BY file_id ORDER BY line_number) AS end_at FROM sized)
  WHERE NOT (line = '' AND line_number = n))"""

#: Lines of the kinds that each detector knows, and some that it doesn't.
KINDS = {
    "python": ["Traceback (most recent call last):", "  File app.py, line 3, in run", "    return run(1)", "  File b.py, line 8", "ValueError: bad value", "app.errors.Failure", "", "INFO request done", "    x = 1", "Traceback (most recent call last):  "],
    "java": ['Exception in thread "main" java.lang.Error: x', "java.io.IOException: gone", "   at a.b.C.run(C.java:3)", "   at a.b.C.main(C.java:9)", "   ... 12 more", "Caused by: java.lang.Error: y", "   Suppressed: z.Error", "", "INFO done", "   at d.E.f(E.java:1)"],
    "go": ["panic: boom", "fatal error: all asleep", "goroutine 1 [running]:", "main.run(0x1, 0x2)", "   /src/main.go:3", "", "created by main.start", "[signal SIGSEGV: code]", "exit status 2", "INFO done", "main.main()", ""],
    "js": ["TypeError: x is null", "UnhandledPromiseRejectionWarning: no", "    at run (app.js:3:1)", "    at app.js:9:2", "", "INFO done", "    at Object.f (b.js:1:1)", "Error: y"],
    "dump": ["Segmentation fault", "(core dumped)", "==12==ERROR: AddressSanitizer: heap", "==12==ABORTING", "  #0 0x1 in f", "", "[  12.345] Call Trace:", "[  12.346]  f+0x1", "*** stack smashing detected ***: x", "Aborted (core dumped)", "INFO done", "[  12.347] Code"],
    "json": ["{", "[", '  "a": 1,', '  "b": {', "  },", "}", "]", '  "c": "}{",', "  [", "  ]", "INFO", "}"],
    "repeat": ["same", "same", "same", "same", "same", "", "other", "same"],
}


def log_sql(kind: str) -> str:
    """``log``: one line for each event, twenty files, with numbers and offsets."""
    words = KINDS[kind]
    pick = f"(((event_id % 1009) * (event_id % 757) + event_id % 13) % {len(words)})"
    case = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words))
    return f"""event_lines AS (SELECT user_id % 20 AS file_id, event_id, CASE {pick} {case} END AS line FROM events),
log AS (
  SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY event_id) AS BIGINT) AS line_number,
         CAST(sum(octet_length(CAST(line AS BINARY)) + 1) OVER (PARTITION BY file_id ORDER BY event_id) - octet_length(CAST(line AS BINARY)) - 1 AS BIGINT) AS start_offset,
         CAST(sum(octet_length(CAST(line AS BINARY)) + 1) OVER (PARTITION BY file_id ORDER BY event_id) AS BIGINT) AS end_offset, line
  FROM event_lines)"""


def log_lines(spark: SparkSession, sf_dir: str, kind: str, size: int = STRETCH) -> DataFrame:
    """Twenty files of the events' lines, by event; numbered and placed in two levels, so that no file is in one task."""
    words = KINDS[kind]
    pick = ((F.col("event_id") % 1009) * (F.col("event_id") % 757) + F.col("event_id") % 13) % len(words)
    keys = ["file_id", "part"]
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("file_id"), F.floor(F.col("event_id") / size).alias("part"), "event_id", F.array(*map(F.lit, words))[pick.cast("int")].alias("line"))
    rows = rows.withColumn("n", F.octet_length("line") + 1)
    before = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"))
    parts = parts.select(*keys, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("rows", "bytes")))
    within = Window.partitionBy(*keys).orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(*keys, "line", "n", F.row_number().over(within).alias("k"), F.sum("n").over(within).alias("upto")).join(parts, keys)
    return placed.select("file_id", (F.col("k") + F.col("rows")).cast("long").alias("line_number"), (F.col("bytes") + F.col("upto") - F.col("n")).cast("long").alias("start_offset"), (F.col("bytes") + F.col("upto")).cast("long").alias("end_offset"), "line")


#: ``filed``: the lines of twenty files, each with every twentieth document by number.
FILED_SQL = """pieces AS (
  SELECT doc_id % 20 AS k, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS piece
  FROM documents WHERE text IS NOT NULL),
filed AS (
  SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS BIGINT) AS line_number,
         CAST(sum(strlen(piece) + 1) OVER (PARTITION BY k ORDER BY doc_id, i) - strlen(piece) - 1 AS BIGINT) AS start_offset, regexp_replace(piece, '\\r$', '') AS line
  FROM pieces)"""


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors see: below the one a cluster names in ``spark.checkpoint.dir``, or a local one on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/loglattice-{uuid.uuid4().hex}"


def filed(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """The folder of twenty text files of the documents."""
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents").filter("text is not null").select((F.col("doc_id") % 20).alias("k"), "doc_id", "text")
    docs.repartition("k").sortWithinPartitions("k", "doc_id").select("k", "text").write.partitionBy("k").option("compression", compression).text(path)
    return path


def number_of(file: str = "file_id"):
    return F.regexp_extract(file, "/k=([0-9]+)/", 1).cast("long").alias("k")
