"""What lines of interest look like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import indent

# The shapes of the lines that detectors know.
PY_OPENER = "Traceback (most recent call last):"
PY_EXCEPTION = r"^[A-Za-z_][\w.]*(?::[\t\n\f\r ].*)?$"
JAVA_OPENERS = (r'^Exception in thread "[^"]+"', r"^(?:\w+\.)+\w+(?:Exception|Error)(?::|[\t\n\f\r ]|$)")
JAVA_MORE = (r"^[\t\n\f\r ]+at [\w.$<>]+\(.*\)$", r"^[\t\n\f\r ]+\.\.\. \d+ more$", r"^[\t\n\f\r ]*Suppressed: ", r"^Caused by: ")
GO_OPENER = r"^(?:panic: |fatal error: )"
GO_MORE = (r"^[ \t]", r"^created by ", r"^\[signal ", r"^[A-Za-z_][\w./*()$]*\.[\w*()$]+\(", r"^goroutine \d+ \[[^\]]+\]:$")
GO_EXIT = r"^exit status \d+$"
JS_OPENER = r"^(?:\w*Error: |UnhandledPromiseRejectionWarning: )"
JS_MORE = (r"^[\t\n\f\r ]+at [\w.\[\]<>]+ \(.*\)$", r"^[\t\n\f\r ]+at .*:\d+:\d+$")
DUMP_OPENERS = {"segfault": r"^Segmentation fault", "stack-smash": r"^\*\*\* stack smashing detected \*\*\*", "asan": r"^==\d+==ERROR: AddressSanitizer:", "kernel": r"^\[[\t\n\f\r ]*\d+\.\d+\] Call Trace:"}
ASAN_END = r"^==\d+==ABORTING"
KERNEL_LINE = r"^\[[\t\n\f\r ]*\d+\.\d+\]"
SECRET = r"AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]+|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
LONG_FLOOR, LONG_BONUS, LONG_TIMES = 1024, 512, 4
MIN_RUN = 5


def _any(*shapes: str):
    return lambda line: line.rlike("(?d)" + "|".join(f"(?:{s})" for s in shapes))


#: By family the bit of each shape: what opens a segment, what goes on in it, and others.
BITS = {
    "python": {
        "opens": (1 << 0, lambda line: F.regexp_replace(line, "[ \\t]+$", "") == PY_OPENER),
        "more": (1 << 1, lambda line: (indent(line) > 0) & (line != "")),
        "exception": (1 << 2, _any(PY_EXCEPTION)),
    },
    "java": {"opens": (1 << 3, _any(*JAVA_OPENERS)), "more": (1 << 4, _any(*JAVA_MORE))},
    "go": {"opens": (1 << 5, _any(GO_OPENER)), "more": (1 << 6, _any(*GO_MORE)), "empty": (1 << 7, lambda line: line == ""), "status": (1 << 8, _any(GO_EXIT))},
    "js": {"opens": (1 << 9, _any(JS_OPENER)), "more": (1 << 10, _any(*JS_MORE))},
}
#: Codes of what opens a crash dump, of what else such a line may be, and of brackets; 0 is none of them.
DUMP_KINDS = ("", *DUMP_OPENERS)
DUMP_WHATS = ("", "blank", "core", "asan-end", "aborted", "kernel")
BRACKETS = ("", "{", "}", "[", "]")
#: Where the two codes of crash dumps lie among the bits.
KIND_SHIFT, WHAT_SHIFT = 16, 20


def dump_kind(line: Column) -> Column:
    out = F.lit(0)
    for code, name in reversed(list(enumerate(DUMP_KINDS))[1:]):
        out = F.when(_any(DUMP_OPENERS[name])(line), code).otherwise(out)
    return out


def dump_what(line: Column) -> Column:
    shapes = {"blank": line == "", "core": line.startswith("(core dumped)"), "asan-end": _any(ASAN_END)(line), "aborted": line.startswith("Aborted (core dumped)"), "kernel": _any(KERNEL_LINE)(line)}
    out = F.lit(0)
    for code, name in reversed(list(enumerate(DUMP_WHATS))[1:]):
        out = F.when(shapes[name], code).otherwise(out)
    return out


def bracket(c: Column) -> Column:
    out = F.lit(0)
    for code, text in list(enumerate(BRACKETS))[1:]:
        out = F.when(c == text, code).otherwise(out)
    return out
