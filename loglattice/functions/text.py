"""Scalar functions, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import MATCHING_FLAGS

SIZES = ("B", "KB", "MB", "GB", "TB", "PB")
#: Multipliers of frame sizes by their last letters (fixed values).
FRAME_UNITS = {"GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10, "G": 1 << 30, "M": 1 << 20, "K": 1 << 10, "B": 1}


def human_size(n: Column) -> Column:
    """``1.50 KB`` and the like, in steps of 1024."""
    x = F.abs(n.cast("double"))
    out = F.when(x < 1024, F.format_string("%.2f B", x))
    for k, unit in enumerate(SIZES[1:], 1):
        part = x / float(1024**k)
        out = out.when(F.lit(k == len(SIZES) - 1) | (part < 1024), F.format_string(f"%.2f {unit}", part))
    return F.concat(F.when(n < 0, "-").otherwise(""), out)


def shell_quote(x: Column) -> Column:
    """One POSIX shell word."""
    quoted = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(x.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), x).otherwise(quoted)


def command_line(program: str, *words: Column) -> Column:
    """A command with its arguments quoted; null arguments are left out."""
    return F.concat_ws(" ", F.lit(program), *(F.when(w.isNotNull(), shell_quote(w)) for w in words))


def frame_size(x: Column) -> Column:
    """Bytes of ``4M``, ``1.5GB``, ``300``; null where the text is none of these."""
    up = F.upper(F.trim(x))
    unit = F.regexp_extract(up, r"(GB|MB|KB|G|M|K|B)$", 1)
    number = F.trim(F.regexp_extract(up, r"^(.*?)(?:GB|MB|KB|G|M|K|B)?$", 1))
    scale = F.create_map(*[F.lit(v) for kv in FRAME_UNITS.items() for v in kv])[F.nullif(unit, F.lit(""))]
    bare = F.when(up.rlike(r"^[+-]?\d+$"), F.expr("1")).isNotNull()
    whole = F.try_to_number(F.when(bare, F.regexp_replace(up, r"^\+", "")), F.lit("S9999999999999999999")).cast("long")
    scaled = F.when(number.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)(E[+-]?\d+)?$"), number).cast("double") * scale
    return F.when(unit == "", whole).otherwise(scaled.cast("long"))


def patterns_hash(patterns: list[str], flags: list[str]) -> Column:
    """16 hex digits that don't hang on the order of patterns and flags."""
    kept = sorted(f for f in flags if f in MATCHING_FLAGS)
    body = json.dumps({"flags": kept, "patterns": sorted(patterns)}, ensure_ascii=False)
    return F.substring(F.sha2(F.lit(body), 256), 1, 16)


def patterns_hash_of(patterns: Column, flags: Column) -> Column:
    """``patterns_hash`` of arrays of patterns and flags."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), one), ", "), F.lit("]"))
    kept = F.filter(flags, lambda f: f.isin(*MATCHING_FLAGS))
    return F.substring(F.sha2(F.concat(F.lit('{"flags": '), listed(kept), F.lit(', "patterns": '), listed(patterns), F.lit("}")), 256), 1, 16)


def path_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def safe_name(path: Column) -> Column:
    """A path's last part with everything but letters, digits, dots, dashes and underscores replaced."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"[^\p{L}\p{Nd}._-]", "_")


def cache_name(path: Column) -> Column:
    return F.concat(safe_name(path), F.lit("_"), path_hash(path), F.lit(".json"))


def mtime_text(t: Column) -> Column:
    """A local time, its microseconds only where there are any."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(t, "SSSSSS") == "000000", whole).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_time(x: Column) -> Column:
    """The time in any of the layouts that are written, null for none."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in layouts))


def task_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def compression_ratio(raw: Column, packed: Column) -> Column:
    """How many times smaller, cut to two decimals."""
    return F.when(packed > 0, F.floor(raw * 100 / packed) / 100)


def packed_share(raw: Column, packed: Column) -> Column:
    return F.when(raw > 0, packed / raw)


def trim_newline(x: Column) -> Column:
    return F.regexp_replace(x, r"\r?\n\z", "")


def is_blank(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\x0b\f\r\n")) == ""


def indent(x: Column) -> Column:
    return F.length(F.regexp_extract(x, "^[ \\t]*", 0))


def has_non_text(x: Column) -> Column:
    return x.rlike("[^\\t\\n\\r\\x20-\\x7E]")


def outside_strings(x: Column) -> Column:
    """A line without its JSON strings; one that isn't closed reaches the end."""
    return F.regexp_replace(x, r'"(?:\\.|[^"\\])*(?:"|$)', "")


def bracket_delta(x: Column) -> Column:
    """Opened less closed brackets outside of strings."""
    bare = outside_strings(x)
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def highlight(x: Column, regex: str, before: str = "\x1b[1;31m", after: str = "\x1b[0m") -> Column:
    return F.regexp_replace(x, f"(?d)({regex})", f"{before}$1{after}")


def query_string(params: dict[str, Column]) -> Column:
    """Parameters by name, percent-encoded; null ones are left out."""
    return F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in sorted(params.items())))
