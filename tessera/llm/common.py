"""Shared plumbing of the training-data operators.

* :func:`table` reads one of the input tables through Spark's own reader.
* :func:`materialize` writes an intermediate to the folder that ``spark.checkpoint.dir``
  names and reads it back: lineage is cut on storage that outlives executors.  :func:`discard`
  deletes one that nothing reads any more, :func:`clean` all that an application has written.
* :func:`map_rows` runs a per-row Python kernel over Arrow batches, keeping only the
  columns that the kernel needs.
* :class:`WordCache` is the bounded two-generation memo that makes per-word models cheap.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, the separators of contract words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of an output Arrow batch of :func:`map_rows`, at most; bytes of text in one, about.
OUT_ROWS = 1024

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one named by ``spark.checkpoint.dir``.

    Where that is unset: in the warehouse, which all machines of a cluster share; a local master, which
    is one machine, gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and (context.master == "local" or context.master.startswith("local[")):
        if context.applicationId not in _OWN_DIRS:
            _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        named = _OWN_DIRS[context.applicationId]
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/tessera-{context.applicationId}"


#: Whether this JVM can be asked to give native memory back: known after the first try.
_TRIMS = [True]


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM give native memory that it has freed back to the system (what ``jcmd System.trim_native_heap`` does).

    Compiling the code of many queries leaves some 200 MB of it with the allocator.  False where the JVM cannot.
    """
    if _TRIMS[0]:
        try:
            jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
            kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
            for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
                kinds[k] = jvm.java.lang.Class.forName(name)
            args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
            # by the interface: the server's own class is not open to reflection
            invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
            invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
        except Py4JError:  # another JVM or C library
            _TRIMS[0] = False
    return _TRIMS[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and reread (same columns and types)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_driver(spark)
    written = spark.read.schema(df.schema).parquet(path)
    written.__dict__["_tessera_path"] = path
    return written


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` begins with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these; nothing that is still to run may read them."""
    for df in frames:
        if path := df.__dict__.get("_tessera_path"):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete everything that this application has materialised, once its results have been read or written."""
    _delete(spark, shared_dir(spark))


class WordCache(dict):
    """``cache[key]`` computes missing values with ``make`` and holds at most 2 x ``cap`` of them.

    A full young generation becomes the old one, so that frequent keys survive and rare ones go.
    Keys over ``LONGEST_KEY`` characters are computed each time: memory is bounded in bytes, whatever
    the vocabulary, and the result never depends on what was kept.
    """

    LONGEST_KEY = 64

    def __init__(self, make: Callable[[Any], Any], cap: int = 100_000):
        super().__init__()
        self.make, self.cap, self.room, self.old = make, cap, cap, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST_KEY:
            return self.make(key)
        value = self.old.get(key) if self.old else None
        if value is None:
            value = self.make(key)
        self[key] = value
        self.room -= 1
        if not self.room:
            self.old, self.room = dict(self), self.cap
            self.clear()
        return value


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _malloc_trim = None


def trim() -> None:
    """Give freed memory back to the system: a worker process lives on, idle, beside steps that need none of it."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


#: The model that a worker process holds between tasks, under a key that names it exactly.
_KEPT: dict[str, Any] = {}


def kept(key: str, build: Callable[[], Any]) -> Any:
    """``build()`` once per worker process and ``key``; the model of another step makes way."""
    if key not in _KEPT:
        release()
        _KEPT[key] = build()
    return _KEPT[key]


def release() -> None:
    """Let go of the model of an earlier step, which a worker process would hold through steps that use none."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trim()


#: Rows of one Arrow batch to a Python worker: with 10,000 texts, Spark's default, a batch alone takes 100 MB.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for texts, unless the session has asked for smaller ones."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def map_rows(df: DataFrame, columns: Sequence[str], kernel: Callable[[], Callable[..., Iterable[tuple]]], schema: T.StructType) -> DataFrame:
    """Apply a Python kernel to the named columns of each row.

    ``kernel()`` is called once per task and returns ``f(*values) -> iterable of output tuples``.
    Columns that are not named are pruned before any row reaches Python, so extra columns,
    whatever their names, cost nothing.
    """
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rows = kernel(), []

        def flush() -> pa.RecordBatch:
            made = list(zip(*rows)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(made, arrow)], schema=arrow)

        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                for out in f(*values):
                    rows.append(out)
                    if len(rows) >= OUT_ROWS:
                        yield flush()
                        rows = []
            if rows:
                yield flush()
                rows = []
        trim()

    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)


#: Characters of text that :func:`map_texts` hands to its kernel at once, about.
BLOCK_CHARS = 1_000_000


def map_texts(df: DataFrame, key: str, kernel: Callable[[], Callable[[list], list[tuple]]], schema: T.StructType) -> DataFrame:
    """Like :func:`map_rows` for kernels that score a list of texts at once: ``kernel()(texts)`` gives a tuple a text.

    Lists hold about ``BLOCK_CHARS`` characters, so a task's memory does not follow its batch size.
    """
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= BLOCK_CHARS or i + 1 == len(texts):
                    rows = [(k, *r) for k, r in zip(keys[start : i + 1], f(texts[start : i + 1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                    start, size = i + 1, 0
        trim()

    return df.select(f"`{key}`", "text").mapInArrow(run, schema)


_TYPES = {"long": T.LongType(), "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def struct(spec: str) -> T.StructType:
    """A StructType from ``name type, ...``; needs no session, so executors can import it."""

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _TYPES[name]

    fields = [part.strip().rsplit(" ", 1) for part in spec.split(",")]
    return T.StructType([T.StructField(name, kind(type_name)) for name, type_name in fields])


def with_key(df: DataFrame, key: str, spec: str) -> T.StructType:
    """``spec`` preceded by the key column of ``df`` with the type that it has there."""
    return T.StructType([T.StructField(key, df.schema[key].dataType), *struct(spec).fields])
