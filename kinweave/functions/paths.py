"""Column functions over repo-relative paths and dotted symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+|/+$", "")


def relative_path(path: Column) -> Column:
    """``path`` from the top of the tree: ``.`` and empty segments are dropped and ``..`` takes back the segment before it."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    resolved = F.aggregate(
        segments, _no_strings(),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(
            F.concat(done, F.array(s))
        ),
    )
    absolute = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    return F.concat(absolute, F.array_join(resolved, "/"))


def _prefixes(parts: Column, separator: str) -> Column:
    """Proper prefixes of ``parts``, longest first. Empty when there are none."""
    n = F.size(parts)
    return F.when(
        n > 1,
        F.transform(
            F.sequence(n - 1, F.lit(1), F.lit(-1)),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator),
        ),
    ).otherwise(_no_strings())


def ancestor_dirs(path: Column) -> Column:
    """Directories that contain ``path``, deepest first, on segment boundaries."""
    return _prefixes(F.split(normalize_path(path), "/"), "/")


def dir_depth(directory: Column) -> Column:
    clean = normalize_path(directory)
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, "/")))


def file_of(symbol_id: Column) -> Column:
    """The file part of ``file::fqn``; a bare path is its own file."""
    return F.substring_index(symbol_id, "::", 1)


def has_fqn(symbol_id: Column) -> Column:
    return F.instr(symbol_id, "::") > 0


def fqn_of(symbol_id: Column) -> Column:
    return F.regexp_extract(symbol_id, r"(?s)\A.*?::(.*)\z", 1)


def enclosing_scopes(symbol_id: Column) -> Column:
    """Ids of the scopes around a symbol, innermost first: ``f::A.b.c`` gives ``f::A.b, f::A``."""
    file = file_of(symbol_id)
    return F.when(
        has_fqn(symbol_id),
        F.transform(
            _prefixes(F.split(fqn_of(symbol_id), r"\."), "."),
            lambda scope: F.concat(file, F.lit("::"), scope),
        ),
    ).otherwise(_no_strings())


def parent_fqn(fqn: Column) -> Column:
    """``A.b`` gives ``A``; null for a top-level name."""
    return F.when(F.instr(fqn, ".") > 0, F.regexp_replace(fqn, r"\.[^.]*$", ""))


def last_segment(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for dotfiles and bare names."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]*)$", 1))


def under_excluded_dir(path: Column, excluded: list[str]) -> Column:
    """True when a *directory* segment of ``path`` is one of ``excluded``."""
    segments = F.split(path, "/")
    directories = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return F.arrays_overlap(directories, F.array(*[F.lit(e) for e in excluded])) if excluded else F.lit(False)


def watch_ignored(path: Column, excluded: list[str], state_dir: str = ".kinweave") -> Column:
    """True for change events that never trigger a reindex."""
    ignored = (path == state_dir) | path.startswith(state_dir + "/") | path.startswith(".git/")
    if excluded:
        ignored |= F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(e) for e in excluded]))
    return ignored


def rule_file_name(anchor: Column, prefix: str = "kinweave-") -> Column:
    slug = F.regexp_replace(F.regexp_replace(anchor, r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit(prefix), slug, F.lit(".mdc"))
