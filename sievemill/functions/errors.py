"""Errors, stacks, code contexts and assertions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions import text as T
from sievemill.functions.paths import process_path

_CALL = r"^\s*at\s+(?:async\s+)?(.+?)\s+\((.+?):(\d+):(\d+)\)$"
_PLACE = r"^\s*at\s+(.+?):(\d+):(\d+)$"
_INTERNAL = r"^node:|^internal/|^\[.*\]$|^<anonymous>$"


def stack_frames(stack: Column, root: str, drop_node_modules: bool = False, absolute: bool = False) -> Column:
    """array<struct<file_relative, file_absolute, line, col, function, in_project, in_node_modules>>, without internals."""
    lines = F.filter(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda x: F.contains(x, F.lit("at ")))

    def parts(line: Column) -> Column:
        """function, file, line, col of a call; file, line, col of a place; else the line: one pass of each pattern."""
        call = F.split(F.regexp_replace(line, _CALL, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
        place = F.split(F.regexp_replace(line, _PLACE, "$1\u0001$2\u0001$3"), "\u0001")
        return T.bound(call, lambda c: F.when(F.size(c) == 4, c).otherwise(place))

    def parsed(p: Column) -> Column:
        named = F.size(p) == 4
        file = F.when(named, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0)))
        file = F.trim(F.regexp_replace(F.regexp_replace(file, "^file://", ""), r"[?#].*$", ""))
        row, col = F.element_at(p, -2), F.element_at(p, -1)
        return F.struct(file.alias("file"), row.cast("int").alias("line"), col.cast("int").alias("col"), F.when(named, F.trim(F.get(p, F.lit(0)))).alias("function"))

    def placed(f: Column) -> Column:
        p = process_path(f["file"], root, absolute)
        return F.struct(p["file_relative"].alias("file_relative"), p["file_absolute"].alias("file_absolute"), f["line"].alias("line"), f["col"].alias("col"), f["function"].alias("function"), p["in_project"].alias("in_project"), p["in_node_modules"].alias("in_node_modules"))

    found = F.filter(F.transform(lines, parts), lambda p: F.size(p) >= 3)
    frames = F.filter(F.transform(found, parsed), lambda f: ~f["file"].rlike(_INTERNAL))
    found = F.transform(frames, placed)
    return F.filter(found, lambda f: ~f["in_node_modules"]) if drop_node_modules else found


def first_frame(frames: Column) -> Column:
    return F.try_element_at(frames, F.lit(1))


def code_window(source: Column, line: Column, column: Column | None = None, around: int = 3) -> Column:
    """Numbered lines around a failing one, which is marked; null where the line is not in the source."""
    lines = F.split(source, "\n")
    first = F.greatest(F.lit(1), line - around)
    last = F.least(F.size(lines), line + around)
    where = F.lit("") if column is None else F.when(column.isNotNull(), F.concat(F.lit(" at column "), column.cast("string"))).otherwise(F.lit(""))
    numbered = F.transform(
        F.sequence(first, last),
        lambda i: F.concat(
            F.lpad(i.cast("string"), F.greatest(F.length(i.cast("string")), F.lit(3)), F.lit(" ")), F.lit(": "), F.element_at(lines, i),
            F.when(i == line, F.concat(F.lit(" // <- failure"), where)).otherwise(F.lit("")),
        ),
    )
    return F.when((line >= 1) & (line <= F.size(lines)), numbered)


def first_text(*candidates: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def first_number(*candidates: Column) -> Column:
    """The first that begins with a whole number."""
    return F.coalesce(*[F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long") for c in candidates])


def normalized_error(message: Column, name: Column, kind: Column, constructor: Column, stack: Column, line: Column, context_line: Column) -> Column:
    """struct<message, type, stack, line>: the first of what is known, with defaults."""
    plain = F.when(constructor != "Object", constructor)
    by_stack = F.nullif(F.regexp_extract(F.coalesce(stack, F.lit("")), r":(\d+):", 1), F.lit("")).cast("long")
    return F.struct(
        F.coalesce(F.nullif(message, F.lit("")), F.lit("Unknown error")).alias("message"),
        F.coalesce(first_text(name, kind, plain), F.lit("Error")).alias("type"),
        F.nullif(stack, F.lit("")).alias("stack"),
        F.coalesce(line.cast("long"), by_stack, context_line.cast("long")).alias("line"),
    )


def merged_error(primary: Column, secondary: Column) -> Column:
    """Fields of the primary error where it has them, else of the secondary."""
    return F.struct(
        *[first_text(primary[n], secondary[n]).alias(n) for n in ("message", "type", "stack")],
        F.coalesce(primary["line"], secondary["line"]).alias("line"),
    )


def formatted_error(kind: Column, message: Column, line: Column, expected: Column, actual: Column) -> Column:
    return F.concat_ws("\n", F.concat(kind, F.lit(": "), message), F.concat(F.lit("  at line "), line.cast("string")), F.concat(F.lit("  Expected: "), expected), F.concat(F.lit("  Actual: "), actual))


def limited_code(code: Column, limit: int = 10) -> Column:
    """Long contexts keep their first and last half around an ellipsis."""
    half = limit // 2
    cut = F.concat(F.slice(code, 1, half), F.array(F.lit("...")), F.slice(code, -half, half))
    return F.when(F.size(code) > limit, cut).otherwise(code)


def merged_context(code_a: Column, code_b: Column, line_a: Column, line_b: Column, limit: int = 10) -> Column:
    return F.struct(limited_code(F.concat(code_a, code_b), limit).alias("code"), F.coalesce(line_a, line_b).alias("line"))


def assertion_value(raw: Column) -> Column:
    """struct<value (JSON text), type>: strings that read as numbers, booleans or null are taken as such."""
    number = raw.rlike(r"^-?\d+(\.\d+)?$")
    kind = (
        F.when(raw.isNull() | (raw == "null"), "null").when(number, "number").when(raw.isin("true", "false"), "boolean")
        .when(raw.rlike(r"^\s*\[") & F.try_parse_json(raw).isNotNull(), "array")
        .when(raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull(), "Record<string, unknown>").otherwise("string")
    )
    plain = F.when(kind == "string", F.concat(F.lit('"'), T.json_escape(raw), F.lit('"'))).otherwise(F.coalesce(raw, F.lit("null")))
    return F.struct(plain.alias("value"), kind.alias("type"))


def truncated_stack(stack: Column, frames: int, user_first: bool = True) -> Column:
    """Header lines, then frames of user code, of others and of packages, at most so many; then how many were left out."""
    lines = F.split(stack, "\n")
    header = F.filter(lines, T.is_error_line)
    framed = F.filter(lines, lambda x: ~T.is_error_line(x) & T.is_frame_line(x))
    user = F.filter(framed, T.is_user_path)
    package = F.filter(framed, lambda x: ~T.is_user_path(x) & F.contains(x, F.lit("node_modules")))
    other = F.filter(framed, lambda x: ~T.is_user_path(x) & ~F.contains(x, F.lit("node_modules")))
    ranked = F.concat(user, other, package) if user_first else F.concat(other, package)
    kept = F.slice(ranked, 1, frames) if frames else F.slice(ranked, 1, 0)
    left = F.size(framed) - F.size(kept)
    note = F.when(left > 0, F.array(F.concat(F.lit("    ... "), left.cast("string"), F.lit(" frames omitted")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(header, kept, note), "\n")


def truncated_code(code: Column, line: Column, around: int = 2, rebase: bool = False) -> Column:
    """Lines around an index into the window. ``rebase``: take the window's middle, whatever the line's number."""
    at = F.floor(F.size(code) / 2).cast("int") if rebase else line.cast("int")
    first, last = F.greatest(F.lit(0), at - around), F.least(F.size(code), at + around + 1)
    body = F.slice(code, first + 1, F.greatest(last - first, F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    dots = F.array(F.lit("..."))
    cut = F.concat(F.when(first > 0, dots).otherwise(none), body, F.when(last < F.size(code), dots).otherwise(none))
    short = F.slice(code, 1, 2 * around + 1)
    return F.when(code.isNull() | (F.size(code) == 0), none).when(at.isNull() | (at < 0), short).otherwise(cut)


def truncated_assertion(value: Column, kind: Column, most: int = 200) -> Column:
    """Long strings and long JSON texts are cut; numbers, booleans and null never."""
    cut = F.substring(value, F.lit(1), F.lit(most - 10))
    edge = T._last_index(cut, "\n")
    closing = F.when(F.startswith(value, F.lit("{")), "}").otherwise("]")
    structured = F.when(edge > most * 0.5, F.concat(F.substring(value, F.lit(1), edge), F.lit("\n  ...\n"), closing)).otherwise(F.concat(T.safe_trim(value, most - 3), F.lit("...")))
    long = F.when(kind.isin("array", "Record<string, unknown>"), structured).otherwise(F.concat(T.safe_trim(value, most - 3), F.lit("...")))
    return F.when(kind.isin("number", "boolean", "null") | (F.length(value) <= most), value).otherwise(long)
