"""Path functions as column expressions (POSIX rules)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.text import utf16_length


def normalize_path(path: Column) -> Column:
    """Without ``file://``, and with single slashes."""
    bare = F.regexp_replace(path, "^file://", "")
    drive = F.regexp_replace(bare, "^/([A-Za-z]:)", "$1")
    return F.regexp_replace(F.when(F.startswith(path, F.lit("file://")), drive).otherwise(bare), "/+", "/")


def _comparable(path: Column) -> Column:
    slashes = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    return F.when(F.length(slashes) > 1, F.regexp_replace(slashes, "/$", "")).otherwise(slashes)


def _within(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.when(F.endswith(root, F.lit("/")), root).otherwise(F.concat(root, F.lit("/"))))


def repo_relative(path: Column, root: str) -> Column:
    """The part below the root; the root itself is ``.``; what lies outside stays as it is."""
    if not root:
        return F.coalesce(path, F.lit(""))
    p, r = _comparable(path), _comparable(F.lit(root))
    rest = F.regexp_replace(F.substring(p, F.length(r) + 1, F.length(p)), "^/+", "")
    inside = F.when(rest == "", ".").otherwise(rest)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).when(_within(p, r), inside).otherwise(path)


def in_node_modules(path: Column) -> Column:
    return F.coalesce(F.array_contains(F.split(_comparable(path), "/"), "node_modules"), F.lit(False))


def in_project(path: Column, root: str) -> Column:
    return F.coalesce((path != "") & _within(_comparable(path), _comparable(F.lit(root))) & ~in_node_modules(path), F.lit(False))


def process_path(path: Column, root: str, absolute: bool = False) -> Column:
    """struct<file_relative, file_absolute, in_project, in_node_modules>."""
    clean = normalize_path(path)
    anchored = clean.rlike(r"^(/|[A-Za-z]:[\\/])")
    kept = F.when(F.startswith(clean, F.lit("/")), clean) if absolute else F.lit(None).cast("string")
    return F.struct(
        F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).when(anchored, repo_relative(clean, root)).otherwise(path).alias("file_relative"),
        kept.alias("file_absolute"),
        in_project(clean, root).alias("in_project"),
        in_node_modules(clean).alias("in_node_modules"),
    )


def is_test_file(path: Column) -> Column:
    return path.rlike(r"\.test\.|\.spec\.|__tests__")


#: Rules that a path may break, in the order in which they are checked.
MAX_PATH = 4096


def path_failures(path: Column) -> Column:
    """Names of all rules that a path breaks; a valid one breaks none."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    lower = F.lower(path)
    rules = {
        "empty": F.coalesce(path, F.lit("")) == "",
        "null byte": F.contains(path, F.lit("\0")),
        "traversal": F.contains(path, F.lit("..")),
        "protocol": lower.rlike("javascript:|data:|file://"),
        "malformed encoding": path.isNotNull() & (decoded.isNull() | path.rlike("%(?![0-9A-Fa-f]{2})")),
        "encoded traversal": F.contains(decoded, F.lit("..")) | F.contains(decoded, F.lit("\0")),
        "length": utf16_length(path) > MAX_PATH,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))


def is_valid_path(path: Column) -> Column:
    return F.size(path_failures(path)) == 0


class PathValidator:
    """Existing files within a root, on the driver's own disk; answers are remembered."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)
        self.known: dict[str, str | None] = {}
        self.hits = self.misses = 0

    def validate(self, path: str) -> str | None:
        if path in self.known:
            self.hits += 1
            return self.known[path]
        self.misses += 1
        real = None
        if path and "\0" not in path and os.path.exists(path):
            found = os.path.realpath(path)
            real = found if self.is_within_root(found) else None
        self.known[path] = real
        return real

    def is_within_root(self, path: str) -> bool:
        return Path(os.path.realpath(path)).is_relative_to(self.root)

    def clear(self) -> None:
        self.known.clear()
        self.hits = self.misses = 0
