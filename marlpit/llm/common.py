"""Shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Most rows that go to a Python worker at once.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WORD = re.compile(r"[^\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; none for null."""
    return _WORD.findall(text.lower()) if text else []


def fitting(sizes: list[int], most: int, rows: int, large: int) -> list[int]:
    """Positions of a sample of at most ``rows`` texts and ``most`` bytes, given the texts' sizes in the order of drawing.

    A text that does not fit is passed over and a later one takes its place. Texts of over ``large`` bytes are drawn
    after the others of the first ``rows``, so that a few of them do not use up the bytes. Never empty, unless ``sizes``
    is: where nothing fits, the smallest text is taken.
    """
    taken, held = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (i >= rows, sizes[i] > large)):
        if len(taken) == rows:
            break
        if held + sizes[i] <= most:
            held += sizes[i]
            taken.append(i)
    return taken or ([min(range(len(sizes)), key=sizes.__getitem__)] if sizes else [])


def give_back() -> None:
    """Return a worker's freed memory to the system; workers live on, and the next task may need little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: What a worker remembers from task to task, by the module that does, and the module whose tasks it ran last.
_MEMORIES: dict[str, Callable[[], None]] = {}
_last = ""


def remembers(module: str, forget: Callable[[], None]) -> None:
    """``forget`` is called in a worker before it runs tasks of another module."""
    _MEMORIES[module] = forget


def _begin(module: str) -> None:
    global _last
    if _last and _last != module:
        for name, forget in _MEMORIES.items():
            if name != module:
                forget()
        give_back()
    _last = module


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType, module: str | None = None) -> DataFrame:
    """``mapInArrow``, shipping this package and giving memory back after each task, and before it what other modules remember.

    Texts are long, so the session's rows a batch are lowered to ``BATCH_ROWS`` where they are more.
    """
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))

    module = module or f.__module__

    def run(batches):
        from marlpit.llm import common  # the worker's own, not what is pickled with this function

        common._begin(module)
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple | list]], schema: T.StructType, rows: int = 4096) -> DataFrame:
    """``map_batches`` for a function from record batches to rows (tuples in the order of ``schema``)."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = []
        for row in f(batches):
            held.append(row)
            if len(held) >= rows:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return map_batches(df, run, schema, f.__module__)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, which bounds what a step holds of long texts."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
