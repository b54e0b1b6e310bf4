"""Shared helpers: task-side Arrow columns, shipping of the package, tokenizer files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_SPACE = r"[\x20\x09-\x0D]+"


USUAL_BATCH, OWN_BATCH = "67108864b", "8388608b"  # Spark's default bytes of a batch, and ours


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and bound the bytes of their batches.

    The default batch of 10,000 texts would be held several times over by every worker. A session's own
    setting is kept.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == USUAL_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", OWN_BATCH)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
        # One allocator for Arrow and the rest, so that trimming reaches both.
        spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
        spark.sparkContext.environment.setdefault("MALLOC_ARENA_MAX", "1")


@lru_cache(1)
def _trim() -> Callable[[], None]:
    """Gives freed memory back to the system, where the C library can."""
    import ctypes
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


class _Released:
    """A task function whose worker keeps no freed memory: workers outlive tasks, beside a growing JVM."""

    def __init__(self, fn):
        self.fn = fn

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for out in self.fn(batches):
            yield out
            held += out.nbytes
            if held > 4 << 20:
                del out
                pa.default_memory_pool().release_unused()
                _trim()()
                held = 0
        pa.default_memory_pool().release_unused()
        _trim()()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | T.StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(_Released(fn), schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text): whatever else the table holds can't clash with computed columns."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def inner(batch: pa.RecordBatch, name: str, column: str = "row") -> pa.Array:
    """A column inside the struct that carries a table's whole rows: the text is not sent twice."""
    rows_array = batch.column(column)
    return rows_array.field(name) if rows_array.null_count == 0 else pc.struct_field(rows_array, name)


def raw_inner(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column of the rows, null as empty."""
    return [x or b"" for x in inner(batch, name).cast(pa.string()).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def rows(columns: dict[str, object], **types: pa.DataType) -> pa.RecordBatch:
    """A record batch; ``types`` gives the Arrow type where it can't be told from values."""
    return pa.RecordBatch.from_pydict({k: pa.array(v, type=types.get(k)) if not isinstance(v, pa.Array) else v
                                       for k, v in columns.items()})


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
