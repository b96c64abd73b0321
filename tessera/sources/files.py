"""A tree of source files as rows.

Spark's own file sources skip names that begin with ``_`` or ``.``, and so would lose ``__init__.py``.
A tree is therefore listed and read through Arrow's file systems: a path of this machine (which on a
cluster all machines must see) or the URI of a store (``s3://``, ``gs://``, ``hdfs://``, ``file://``).
The driver lists directories only until there are enough for all cores; workers list what is below
them, and files are dealt out again by their number and size before they are read.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import LANGUAGES, ScanConfig
from ..plans.schema import SOURCE

# Directories that are never listed, by what is looked for.
DETECT_PRUNED = frozenset("target node_modules .git dist build .venv venv".split())
LIST_PRUNED = frozenset("node_modules .git dist build target .venv venv .next .turbo".split())
SUFFIXES = {"python": (".py",), "typescript": (".ts", ".tsx", ".js", ".jsx"), "rust": (".rs",)}
#: Bytes of source that one partition reads, about.
PARTITION_BYTES = 4 << 20


def classify(name: str) -> str | None:
    """The language that a file name stands for when languages are detected."""
    if name.endswith(".py"):
        return "python"
    if name.endswith(".rs"):
        return "rust"
    if name.endswith((".tsx", ".jsx")) or name.endswith(".ts") and not name.endswith(".d.ts") or name.endswith(".js") and not name.endswith(".min.js"):
        return "typescript"
    return None


def store(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root:
        files, path = pa.fs.FileSystem.from_uri(root)
        return files, path.rstrip("/")
    return pa.fs.LocalFileSystem(), os.path.realpath(root)


def is_directory(root: str) -> bool:
    try:
        files, path = store(root)
        return files.get_file_info(path).type == pa.fs.FileType.Directory
    except (OSError, pa.ArrowInvalid):
        return False


def _entries(files: pa.fs.FileSystem, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a directory, bytes) of what a directory holds; links to directories are not followed."""
    if isinstance(files, pa.fs.LocalFileSystem):
        with os.scandir(path) as found:
            own = [(e.name, e.is_dir(follow_symlinks=False), e.is_dir(), e) for e in found]
        return sorted((name, real, 0 if real or not os.path.exists(e.path) else e.stat().st_size) for name, real, directory, e in own if real or not directory)
    found = files.get_file_info(pa.fs.FileSelector(path))
    return sorted((f.base_name, f.type == pa.fs.FileType.Directory, f.size or 0) for f in found)


def walk(files: pa.fs.FileSystem, top: str, pruned: frozenset[str] = frozenset()) -> Iterator[tuple[str, int]]:
    """(path, bytes) of all files below a directory."""
    todo = [top]
    while todo:
        at = todo.pop()
        for name, directory, size in _entries(files, at):
            path = posixpath.join(at, name)
            if not directory:
                yield path, size
            elif name not in pruned:
                todo.append(path)


def detect_languages(root: str) -> tuple[str, ...]:
    """Languages found under ``root``, in report order; stops once all are there."""
    found: set[str] = set()
    for path, _ in walk(*store(root), DETECT_PRUNED):
        if c := classify(posixpath.basename(path)):
            found.add(c)
            if len(found) == len(LANGUAGES):
                break
    if not found:
        raise ValueError(f"no Python, TypeScript or Rust files under {root}")
    return tuple(lang for lang in LANGUAGES if lang in found)


def _heads(files: pa.fs.FileSystem, root: str, pruned: frozenset[str], enough: int) -> list[tuple[str, bool]]:
    """(directory, whether all below it too): together the whole tree, in ``enough`` parts where it has them."""
    shallow, deep = [], [root]
    while deep and len(deep) < enough:
        at = deep.pop(0)
        shallow.append((at, False))
        deep += [posixpath.join(at, name) for name, directory, _ in _entries(files, at) if directory and name not in pruned]
    return shallow + [(at, True) for at in deep]


def listing(spark: SparkSession, config: ScanConfig, languages: tuple[str, ...]) -> DataFrame:
    """(lang, path, display, below, package, bytes) of the tree's files; Python trees are not pruned."""
    root, exclude, package = config.root, tuple(config.exclude), config.package
    files, top = store(root)
    pruned = {lang: frozenset() if lang == "python" else LIST_PRUNED for lang in languages}
    heads = [(lang, at, deep) for lang in languages for at, deep in _heads(files, top, pruned[lang], 4 * spark.sparkContext.defaultParallelism)]
    spec = T.StructType.fromDDL("lang string, path string, display string, below string, package string, bytes long")
    arrow = to_arrow_schema(spec)

    def below_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(root)
        parent = posixpath.basename(top)
        for batch in batches:
            for head in batch.to_pylist():
                lang, made = head["lang"], []
                found = walk(files, head["at"], pruned[lang]) if head["deep"] else ((posixpath.join(head["at"], n), size) for n, directory, size in _entries(files, head["at"]) if not directory)
                for path, size in found:
                    below = posixpath.relpath(path, top)
                    if path.endswith(SUFFIXES[lang]) and not any(pattern in below for pattern in exclude):
                        # Rust paths are shown below the root, the others below the root's parent
                        made.append({"lang": lang, "path": path, "display": below if lang == "rust" else f"{parent}/{below}", "below": below, "package": package, "bytes": size})
                    if len(made) >= 1000:
                        yield pa.RecordBatch.from_pylist(made, schema=arrow)
                        made = []
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return spark.createDataFrame(heads, "lang string, at string, deep boolean").repartition(len(heads)).mapInArrow(below_heads, spec)


def source_rows(spark: SparkSession, config: ScanConfig, languages: tuple[str, ...]) -> DataFrame:
    """SOURCE rows of the tree, listed and read in the workers."""
    root = config.root
    found = listing(spark, config, languages).persist()
    n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bytes") + 1024), F.lit(0))).first()
    paths = found.drop("bytes").repartition(int(max(1, min(n, total // PARTITION_BYTES + 1))))
    arrow = to_arrow_schema(SOURCE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(root)
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                try:
                    with files.open_input_stream(row["path"]) as f:
                        row["source"] = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    row["source"] = None
                made.append(row)
                if len(made) >= 256:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return paths.mapInArrow(read, SOURCE)
