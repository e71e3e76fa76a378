"""Text functions as column expressions: normalising, hashing, sizing, trimming and escaping. Null in, null out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, what timestamps look like in log messages, and labels before epoch numbers.
BLANK = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ANSI = r"\x1B\[[0-9;]*m"
ISO_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z?"
DATE_TIME = rf"\d{{4}}-\d{{2}}-\d{{2}}{BLANK}+\d{{2}}:\d{{2}}:\d{{2}}"
EPOCH_LABEL = rf"(?i)(\b(?:timestamp|time(?:stamp)?|epoch|unix(?:_timestamp)?)[:=]?{BLANK}*)\d{{10}}(?:\d{{3}})?\b"
EPOCH_IN = (rf"\[{BLANK}*\d{{10}}(?:\d{{3}})?{BLANK}*\]", "[]"), (rf"\({BLANK}*\d{{10}}(?:\d{{3}})?{BLANK}*\)", "()")


@dataclass(frozen=True)
class Normalising:
    """Which steps ``normalize_message`` takes. Without any, it only lower-cases."""

    strip_ansi: bool = True
    strip_timestamps: bool = True
    whitespace: bool = True


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_message(text: Column, rule: Normalising | None = None) -> Column:
    """The form in which messages are compared; runs of white space collapse only where there is a run of two or more.

    Every step is taken only where its text can hold what the step looks for: most messages hold nothing of the kind.
    """
    rule = rule or Normalising()

    def without_times(out: Column) -> Column:
        with_iso = F.when(F.contains(out, F.lit("T")), F.regexp_replace(out, ISO_TIME, "")).otherwise(out)
        return F.regexp_replace(with_iso, DATE_TIME, "")

    def without_epochs(out: Column) -> Column:
        out = F.regexp_replace(out, EPOCH_LABEL, "$1")
        for pattern, left in EPOCH_IN:
            out = F.regexp_replace(out, pattern, left)
        return out

    def collapsed(x: Column) -> Column:
        # texts of ASCII alone have only ASCII blanks, for which expressions have a short form
        ascii_only = F.octet_length(x) == F.length(x)
        short = F.when(x.rlike(r"\s{2}"), F.trim(F.regexp_replace(x, r"\s+", " "))).otherwise(x)
        return F.when(ascii_only, short).when(x.rlike(BLANK + "{2}"), F.trim(F.regexp_replace(x, BLANK + "+", " "))).otherwise(x)

    out = text
    if rule.strip_ansi:
        out = F.when(F.contains(out, F.lit("\x1b")), strip_ansi(out)).otherwise(out)
    if rule.strip_timestamps:
        out = bound(out, lambda x: F.when(F.contains(x, F.lit("-")) & F.contains(x, F.lit(":")), without_times(x)).otherwise(x))
        out = bound(out, lambda x: F.when(x.rlike(r"\d{10}"), without_epochs(x)).otherwise(x))
    if rule.whitespace:
        out = bound(out, collapsed)
    return F.lower(out)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; equal to ``length`` without characters beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def djb2(text: Column) -> Column:
    """DJB2 over UTF-16 code units, modulo 2**32, in base 36."""
    start = F.lit(5381).cast("long")

    def fold(raw: Column) -> Column:
        units = F.sequence(F.lit(0), (F.octet_length(raw) / 2).cast("int") - 1)
        return F.aggregate(units, start, lambda h, i: (h * 33 + _unit(raw, i)).bitwiseAND(F.lit(4294967295)))

    folded = F.when(F.length(text) > 0, bound(F.encode(text, "UTF-16BE"), fold))
    return F.lower(F.conv(F.when(F.length(text) == 0, start).otherwise(folded).cast("string"), 10, 36))


def _unit(raw: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), 16, 10).cast("long")


def estimate_tokens(text: Column, chars_per_token: float = 4, utf16: bool = False) -> Column:
    """Characters by characters per token, rounded up; an empty text has none."""
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be greater than 0")
    size = utf16_length(text) if utf16 else F.length(text)
    return F.ceil(size / F.lit(float(chars_per_token))).cast("long")


def exceeds_tokens(text: Column, limit: int, chars_per_token: float = 4) -> Column:
    return estimate_tokens(text, chars_per_token) > limit


def character_limit(tokens: int, chars_per_token: float = 4) -> int:
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be greater than 0")
    return int(tokens * chars_per_token)


def chars_for_tokens(tokens: int, average: float = 3.5) -> int:
    return int(tokens * average // 1)


def _last_index(text: Column, mark: str) -> Column:
    """0-based place of the last occurrence, or -1."""
    back = F.locate(mark, F.reverse(text))
    return F.when(back == 0, -1).otherwise(F.length(text) - back)


def safe_trim(text: Column, target: Column | int, prefer_boundaries: bool = True, safety: float = 0.1) -> Column:
    """Texts over the target are cut to it less a margin, at a natural boundary if one lies in the last fifth."""
    target = F.lit(target) if isinstance(target, int) else target
    keep = F.floor(target * F.lit(1 - safety)).cast("int")
    cut = F.substring(text, F.lit(1), F.greatest(keep, F.lit(0)))
    out = cut
    if prefer_boundaries:
        edge = F.greatest(*[_last_index(cut, m) for m in (" ", "\n", ".", ",")])
        out = F.when((keep > 100) & (edge > keep * 0.8), F.substring(text, F.lit(1), edge + 1)).otherwise(cut)
    return F.when(F.length(text) <= target, text).otherwise(out)


def join_with_ellipsis(chunks: Column, ellipsis: str = "...") -> Column:
    return F.array_join(F.filter(chunks, lambda c: F.length(F.trim(F.regexp_replace(c, r"\s", " "))) > 0), ellipsis)


def tiny_limit(text: Column, tokens: int) -> Column:
    """What is said of a text when there is hardly room for any."""
    if tokens < 5:
        return F.when(text.isNotNull(), "...")
    if tokens < 10:
        line = F.try_element_at(F.filter(F.split(text, "\n"), is_error_line), F.lit(1))
        return F.concat(safe_trim(F.coalesce(line, text), tokens * 3, prefer_boundaries=False), F.lit("..."))
    return F.concat(safe_trim(text, tokens * 3 - 10, safety=0.2), F.lit("\n...[cut]"))


def head_and_tail(text: Column, head: float = 0.4, tail: float = 0.4) -> Column:
    """struct<head, tail>: the first and last share of the lines; texts of one or two lines are all head."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    first = F.greatest(F.lit(1), F.floor(n * F.lit(head)).cast("int"))
    last = F.greatest(F.lit(1), F.floor(n * F.lit(tail)).cast("int"))
    return F.struct(
        F.when(n <= 2, text).otherwise(F.array_join(F.slice(lines, F.lit(1), first), "\n")).alias("head"),
        F.when(n <= 2, F.lit("")).otherwise(F.array_join(F.slice(lines, -last, last), "\n")).alias("tail"),
    )


def lines_with_context(n_lines: Column, matches: Column, around: int = 1) -> Column:
    """Sorted 0-based indices of matching lines and those around them."""
    spread = F.flatten(F.transform(matches, lambda i: F.sequence(F.greatest(F.lit(0), i - around), F.greatest(F.least(n_lines - 1, i + around), i))))
    return F.sort_array(F.array_distinct(spread))


def fair_caps(items: Column, budget: int, least: int = 100) -> Column:
    """Items cut to an equal share of a budget each, in order, until it is used up."""
    share = F.greatest(F.lit(least), F.floor(F.lit(budget) / F.size(items)).cast("int"))
    start = F.struct(F.lit(budget).alias("left"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, item: Column) -> Column:
        room = F.least(share, state["left"])
        text = F.when(F.length(item) <= room, item).otherwise(F.concat(safe_trim(item, room - 10), F.lit("\n...[cut]")))
        more = F.struct((state["left"] - F.length(text)).alias("left"), F.concat(state["out"], F.array(text)).alias("out"))
        return F.when(state["left"] > 0, more).otherwise(state)

    return F.aggregate(items, start, step, lambda s: s["out"])


#: What error lines and stack frame lines look like, and words that make a line matter.
ERROR_LINES = (r"^(Error|TypeError|ReferenceError|SyntaxError|RangeError|AssertionError):", r"^[A-Z]\w*Error:", r"^\s*(Expected|Received|Actual|Assert)", r"^(FAIL|FAILED|✖|✗|×)")
FRAME_LINES = (r"^\s*at\s+", r"^\s*↳\s+", r"^\s*[├└│]\s*", r"^\s*\d+\)\s+", r"^\s*#\d+\s+", r"^[\s\S]*:\d+:\d+")
KEYWORDS = (
    "error", "fail", "failure", "exception", "throw", "crash", "fatal", "assert", "expect", "should", "must",
    "require", "test", "describe", "it(", "spec", "scenario", "warning", "critical", "important", "bug", "issue",
    "problem",
)
FOREIGN_PATHS = ("node_modules", "internal/", "<anonymous>", "[native code]")
FOREIGN_STARTS = ("node:", "async ", "timers.")


def is_error_line(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in ERROR_LINES))


def is_frame_line(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in FRAME_LINES))


def has_keyword(line: Column) -> Column:
    return F.exists(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower(line), k))


def is_user_path(path: Column) -> Column:
    inside = [~F.contains(path, F.lit(p)) for p in FOREIGN_PATHS] + [~F.startswith(path, F.lit(p)) for p in FOREIGN_STARTS]
    out = inside[0]
    for c in inside[1:]:
        out = out & c
    return out


def json_escape(text: Column) -> Column:
    """Backslashes, quotes and control characters as JSON escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
        out = F.replace(out, F.lit(c), F.lit(e))
    rest = out
    for code in range(32):
        if chr(code) not in "\n\r\t\f\b":
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(out.rlike(r"[\x00-\x1F]"), rest).otherwise(out)


def console_argument(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("... [truncated]"))).otherwise(text)


def console_message(arguments: Column) -> Column:
    """All arguments of a console call as one message; null ones read ``null``."""
    return F.array_join(F.transform(arguments, lambda a: F.coalesce(console_argument(a), F.lit("null"))), " ")


#: Fixed value: the first home folder and its owner.
HOME = r"(?s)^(.*?(?:^|/))(?:Users|home)/[^/]+"


def mask_home(path: Column) -> Column:
    """The owner of the first home folder (a whole segment of the path) is masked."""
    return F.regexp_replace(path, HOME, "$1Users/***")


def truncated_logs(logs: Column, limit: int = 1000) -> Column:
    """A category's logs, or one cut text of them all if they are longer together than the limit."""
    whole = F.array_join(logs, "\n")
    cut = F.array(F.concat(safe_trim(whole, limit - 20), F.lit("\n...[truncated]")))
    return F.when(F.length(whole) <= limit, logs).otherwise(cut)
