"""Source trees, document folders and text dumps as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.extract import php, python, typescript
from kinweave.extract.knowledge import DECISION_DIRS, RECORD_SEPARATOR
from kinweave.functions.paths import ancestor_dirs, extension, under_excluded_dir, watch_ignored
from kinweave.session import materialize

# The language of each file extension and the folders that are
# never walked.
LANGUAGE_EXTENSIONS = {
    "typescript": typescript.EXTENSIONS,
    "php": php.EXTENSIONS,
    "sql": (".sql",),
    "python": python.EXTENSIONS,
}
DEFAULT_EXCLUDES = ("node_modules", "dist", ".git", "vendor", "build", "coverage")


def extensions_for(languages: list[str] | tuple[str, ...]) -> list[str]:
    return [e for name, exts in LANGUAGE_EXTENSIONS.items() if name in languages for e in exts]


def language_of(path: Column) -> Column:
    """The language a path is read as; null when there is none."""
    ext = extension(path)
    return F.coalesce(*[F.when(ext.isin(*exts), name) for name, exts in LANGUAGE_EXTENSIONS.items()])


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as a full URI, by the file system that the session is configured with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def _entries(store: fs.FileSystem, folder: str) -> list[tuple[str, int, bool]]:
    """Name, time of change in milliseconds, and whether it is a folder, of what is in ``folder``."""
    if isinstance(store, fs.LocalFileSystem):  # the only store here with links
        out = []
        try:
            with os.scandir(folder) as found:
                for x in found:
                    try:
                        if x.is_file(follow_symlinks=False) or x.is_dir(follow_symlinks=False):
                            out.append((x.name, x.stat(follow_symlinks=False).st_mtime_ns // 1_000_000, x.is_dir(follow_symlinks=False)))
                    except OSError:
                        continue
        except OSError:
            pass
        return out
    try:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return []
    kinds = (fs.FileType.File, fs.FileType.Directory)
    return [(x.base_name, int(x.mtime_ns or 0) // 1_000_000, x.type == fs.FileType.Directory) for x in found if x.type in kinds]


def list_tree(spark: SparkSession, root: str, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``(path, mtime)`` of every file below ``root``, hidden names included; file contents are not read.

    Folders are listed level by level in parallel, and a folder whose name is in
    ``exclude`` is not entered. Links are neither files nor folders: a link to a
    folder above it would be walked without end. What vanishes or cannot be read
    while the tree is listed is left out, as is a root that does not exist.
    Spark's own file listing is not used because it skips names that start with
    ``_`` or ``.``.
    """
    uri, skipped = qualified(spark, root), set(exclude)
    layout = "path string, mtime long, folder boolean"

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [
                    (f"{folder}/{name}".lstrip("/"), mtime, is_folder)
                    for name, mtime, is_folder in _entries(store, f"{base.rstrip('/')}/{folder}")
                    if not is_folder or name not in skipped
                ]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*found)) or [(), (), ()], (pa.string(), pa.int64(), pa.bool_()))], names=["path", "mtime", "folder"])

    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = materialize(level.mapInArrow(children, layout), "listing")
        levels.append(found.filter("not folder").select("path", "mtime"))
        level = found.filter("folder").select("path")
        n = level.count()
        if not n:
            return reduce(DataFrame.unionAll, levels)
        level = level.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def walk(
    listing: DataFrame,
    include: list[str] | tuple[str, ...],
    languages: list[str] | tuple[str, ...],
    exclude: list[str] | tuple[str, ...] = DEFAULT_EXCLUDES,
) -> DataFrame:
    """The rows of a listing that are source files: by folder, extension and excluded folder names."""
    path = F.col("path")
    in_scope = F.lit(False)
    for folder in (f.strip("/") for f in include):
        in_scope |= F.lit(True) if folder in ("", ".") else path.startswith(folder + "/")
    return listing.filter(
        in_scope & extension(path).isin(*extensions_for(languages)) & ~under_excluded_dir(path, list(exclude))
    )


def watch_roots(
    listing: DataFrame, include: list[str] | tuple[str, ...], exclude: list[str] | tuple[str, ...] = DEFAULT_EXCLUDES
) -> DataFrame:
    """``(root)``: the folders of a listing to watch, none inside another one.

    The top of the tree is not watched itself: it stands for its folders that are
    not ignored. A named folder is watched if it is in the listing, even if its
    name is ignored elsewhere.
    """
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1))
    wanted = [normal for normal in ("/".join(p for p in f.split("/") if p not in ("", ".")) for f in include)]
    named = sorted({w for w in wanted if w and not any(w.startswith(f"{o}/") for o in wanted if o)})
    spark, roots = listing.sparkSession, []
    if "" in wanted:
        tops = listing.select(folder.alias("root")).filter("root IS NOT NULL").distinct()
        # a top folder covers the named ones inside it
        roots.append(tops.filter(~watch_ignored(F.col("root"), list(exclude)) & (F.col("root") != ".git")))
    if named:
        asked = spark.createDataFrame([(n,) for n in named], "root string")
        held = listing.select(F.explode(ancestor_dirs(F.col("path"))).alias("root")).distinct()
        found = asked.join(held, "root", "left_semi")
        if roots:
            found = found.join(roots[0].withColumnRenamed("root", "top"), F.substring_index("root", "/", 1) == F.col("top"), "left_anti")
        roots.append(found)
    return reduce(DataFrame.unionByName, roots).distinct() if roots else spark.createDataFrame([], "root string")


def read_sources(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(file_path, text)`` of the files ``wanted(path)`` below ``root``, all files where none are given.

    Exactly these files are opened, each by the task that holds its path. Bytes
    that are no UTF-8 become replacement characters; a file that has vanished or
    cannot be read is left out.
    """
    uri = qualified(spark, root)
    paths = (list_tree(spark, root) if wanted is None else wanted).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with store.open_input_stream(f"{base.rstrip('/')}/{path}") as file:
                        text = file.read().decode("utf-8", "replace")
                except OSError:
                    continue
                yield pa.record_batch([pa.array([path]), pa.array([text])], names=["file_path", "text"])

    spread = paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, "file_path string, text string")


def decision_documents(
    listing: DataFrame, docs: list[str] | tuple[str, ...] = (), conventional: bool = True
) -> DataFrame:
    """Markdown files directly inside decision folders, plus the given files and folders."""
    path = F.col("path")
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    name = F.lower(F.substring_index(path, "/", -1))
    is_document = name.endswith(".md") & (name != "readme.md")
    folders = [*(DECISION_DIRS if conventional else ()), *[d.rstrip("/") for d in docs]]
    named = path.isin(*docs) if docs else F.lit(False)
    return listing.filter((folder.isin(*folders) & is_document) | named).select("path").distinct().orderBy("path")


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log dump, one per row (``--format=%H%x1f%s%x1f%b%x1e``)."""
    return spark.read.option("lineSep", RECORD_SEPARATOR).text(path)


def read_staged_changes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ``--name-status`` dump, for :func:`kinweave.operators.drift.staged_changes`."""
    return spark.read.text(path)
