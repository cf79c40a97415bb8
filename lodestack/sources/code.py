"""Source files as tables: path, module, src."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan leaves out, besides those whose names begin with a dot.
SKIPPED = (".git", "__pycache__", ".venv", "venv", "build", "dist", "site-packages", "node_modules", ".mypy_cache", ".pytest_cache")
#: Language by file suffix: what a scan takes up, as far as there is a parser.
LANGUAGES = {".py": "python"}
#: Folders that the driver lists before tasks go on below them.
WIDE = 64


def kept_folder(name: str) -> bool:
    return name not in SKIPPED and not name.startswith(".")


def language(path: Column) -> Column:
    """The language that a path's ending names; null if there is no parser for it."""
    found = F.lit(None).cast("string")
    for suffix, name in LANGUAGES.items():
        found = F.when(F.endswith(path, F.lit(suffix)), F.lit(name)).otherwise(found)
    return found


def below(files: fs.FileSystem, base: str, folders: list[str], suffixes: tuple[str, ...], wide: int | None = None) -> tuple[list[tuple[str, str]], list[str]]:
    """(path below base, full path) of source files below folders; what isn't listed yet once `wide` folders wait.

    Folders that are left out aren't listed.
    """
    out, waiting = [], list(folders)
    while waiting and (wide is None or len(waiting) < wide):
        for x in files.get_file_info(fs.FileSelector(waiting.pop(0))):
            if x.type == fs.FileType.Directory and kept_folder(x.base_name):
                waiting.append(x.path)
            elif x.type == fs.FileType.File and x.base_name.endswith(suffixes):
                out.append((x.path[len(base) :].lstrip("/"), x.path))
    return out, waiting


def _address(root: str) -> str:
    return root if "://" in root else str(Path(root).resolve())


def listed(root: str, suffix: str | tuple[str, ...] = tuple(LANGUAGES)) -> list[tuple[str, str]]:
    """(path below root, full path) of source files, by path."""
    files, base = fs.FileSystem.from_uri(_address(root))
    suffixes = (suffix,) if isinstance(suffix, str) else suffix
    if files.get_file_info(base).type == fs.FileType.File:
        name = base.rsplit("/", 1)[-1]
        return [(name, base)] if name.endswith(suffixes) else []
    return sorted(below(files, base, [base], suffixes)[0])


def scan(spark: SparkSession, root: str, suffix: str | tuple[str, ...] = tuple(LANGUAGES), per_task: int = 500, wide: int = WIDE) -> DataFrame:
    """path (below root), module, src of every source file below root, or of root itself if it is a file.

    Root is a folder that all workers see, or the address of one. Suffixes are compared with
    case; module is the relative path with its suffix; a file that is gone by then has a null src.
    Spark's own file sources pass over names that begin with a dot or an underscore, and with
    them every package's __init__.py; so the driver lists the first folders, tasks list what is below them, and read.
    """
    where = _address(root)
    suffixes = (suffix,) if isinstance(suffix, str) else suffix
    files, base = fs.FileSystem.from_uri(where)
    if files.get_file_info(base).type == fs.FileType.File:
        names, folders = listed(root, suffixes), []
    else:
        names, folders = below(files, base, [base], suffixes, wide)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(where)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found, _ = below(files, base, [folder], suffixes)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["path", "full"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(where)
        for b in batches:
            for path, full in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with files.open_input_stream(full) as f:
                        raw = f.read()
                except FileNotFoundError:
                    raw = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([path]), pa.array([raw], pa.binary())], names=["path", "module", "src"])

    rows = spark.createDataFrame(names, "path string, full string").repartition(max(1, -(-len(names) // per_task)))
    if folders:
        deep = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders)).mapInArrow(walk, "path string, full string")
        rows = rows.union(deep.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(folders))))
    return rows.mapInArrow(read, "path string, module string, src binary")


def from_rows(rows: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The same table from a column of paths and one of texts."""
    return rows.select(F.col(path).alias("path"), F.col(path).alias("module"), F.encode(F.col(text), "UTF-8").alias("src"))


def file_module(path: Column) -> Column:
    """The module name of a single file: its base name without .py."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.py$", "")


def read_query(given: str) -> str:
    """A query's text: from standard input for "-", from a file where one is named, else as given."""
    if given == "-" and not sys.stdin.isatty():
        return sys.stdin.read()
    try:
        if Path(given).is_file():
            return Path(given).read_text("utf-8", errors="ignore")
    except OSError:
        pass
    return given
