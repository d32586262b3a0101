"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, bounded broadcasts.

Every operator takes a DataFrame and the names of the columns that it uses. It reads no other column, so
extra columns, whatever their names, neither change its result nor clash with its output. A row is a
document: repeated rows and repeated ids are kept as rows of their own.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

#: Rows of an Arrow batch, so that a Python worker holds a few MB of ordinary documents at a time.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []
shared_dir = shared.shared_dir


def keep(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df to the shared folder, in a folder for each value of a column if one is named, and read it back: this cuts the lineage and fixes every value in it."""
    spark = df.sparkSession
    path = shared.new_path(spark, name)
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def release(spark: SparkSession, *but: str) -> None:
    """Delete the tables that keep() wrote for this session, but those of the names given; call it once what was read from them is stored."""
    global _written
    mine = [(s, p) for s, p in _written if s is spark and not p.rpartition("/")[2].startswith(tuple(f"{x}-" for x in but))]
    _written = [x for x in _written if x not in mine]
    shared.delete(*[path for _, path in mine])
    settle(spark)


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep() returned, once nothing that is still to be read depends on them."""
    global _written
    gone = [t._kept for t in tables]
    _written = [x for x in _written if x[1] not in gone]
    shared.delete(*gone)


#: Keys of rows to leave out that are sent to all executors, at most: 8 bytes each, some 64 MB as Spark holds them.
BROADCAST_KEYS = 2_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key, a long, is not in gone, a stored table. Up to BROADCAST_KEYS keys are sent to where the rows lie; more meet them by shuffle."""
    gone = gone.select(key)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_rows(df: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Keep the Arrow batches of this session small: so many rows and so many bytes at most (one row at least)."""
    _importable(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df


_caches: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def on_leave(owner: str, clear: Callable[[], None]) -> None:
    """What a worker forgets when it begins a task of another operator."""
    _caches[owner] = clear


def tidy(work: Callable[[Iterable], Iterator], owner: str) -> Callable[[Iterable], Iterator]:
    """work, in a worker that holds the caches of one operator at a time and gives memory back to the system when the task ends.

    Spark uses a Python worker again for later tasks, of other stages too; else what each has left behind adds up.
    """

    def run(batches):
        from tallyfold.llm import common as own  # the worker's module, not a copy that came with the task

        own._enter(owner)
        try:
            yield from work(batches)
        finally:
            own.trim()

    return run


def _enter(owner: str) -> None:
    global _owner
    if _owner not in (None, owner):
        _caches.get(_owner, lambda: None)()
        trim()
    _owner = owner


def trim() -> None:
    """Give freed memory back: Python's, Arrow's and the C library's (where it has a call for that)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def in_arrow(df: DataFrame, work: Callable[[Iterable], Iterator], schema: T.StructType | str, owner: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow of work in small batches and tidy workers."""
    return arrow_rows(df, batch_bytes).mapInArrow(tidy(work, owner), schema)


def groups_in_arrow(grouped, work: Callable[[pa.Table], pa.Table], schema: T.StructType | str, owner: str) -> DataFrame:
    """grouped.applyInArrow of work; a worker is tidied as it begins with another operator."""

    def run(table: pa.Table) -> pa.Table:
        from tallyfold.llm import common as own

        own._enter(owner)
        out = work(table)
        if table.nbytes > 1 << 20:
            own.trim()
        return out

    return grouped.applyInArrow(run, schema)


def _importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as far as they see that folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def texts(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """The columns that a per-document operator reads: id, text (null stays null), and those that it hands on."""
    return arrow_rows(df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in carry or ()]))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_id(df: DataFrame, id_col: str, fields: str, carry: list[str] | None = None) -> T.StructType:
    """The schema of id_col, fields (DDL) and the columns that are handed on."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType, True)])
    for f in T.StructType.fromDDL(fields).fields:
        if f.name.lower() == id_col.lower():
            raise ValueError(f"id column {id_col!r} has the name of an output column")
        out = out.add(f)
    for c in carry or ():
        if c.lower() in (f.name.lower() for f in out):
            raise ValueError(f"column {c!r} to hand on has the name of an output column")
        out = out.add(df.schema[c])
    return out


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of columns cast to schema's types."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: Bits of a Bloom filter at most: its size stays bounded whatever the number of keys, only its use fades.
BLOOM_BITS = 1 << 27
_SEGMENT = 1 << 16  # bytes


def _mix(keys: np.ndarray, k: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Bloom:
    """Set of 64-bit keys without false negatives."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def add(self, keys: np.ndarray) -> None:
        for k in (1, 2, 3):
            at = _mix(keys, k) & np.uint64(self.bits - 1)
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for k in (1, 2, 3):
            at = _mix(keys, k) & np.uint64(self.bits - 1)
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom(df: DataFrame, col: str, count: int) -> Bloom:
    """A Bloom filter of a long column, made on the executors; what reaches the driver is the filter of bounded size."""
    bits = min(BLOOM_BITS, max(1 << 20, 1 << (16 * max(1, count) - 1).bit_length()))

    def part(batches):
        own = Bloom(bits)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for i in range(0, len(own.data), _SEGMENT):
            if own.data[i : i + _SEGMENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([own.data[i : i + _SEGMENT].tobytes()], pa.binary())], names=["at", "bits"])

    def merge(table):
        data = np.zeros(_SEGMENT, np.uint8)
        for x in table.column("bits").to_pylist():
            own = np.frombuffer(x, np.uint8)
            data[: len(own)] |= own
        return pa.table({"at": table.column("at")[:1], "bits": pa.array([data.tobytes()], pa.binary())})

    made = Bloom(bits)
    for r in in_arrow(df.select(F.col(col).cast("long")).coalesce(64), part, "at long, bits binary", "bloom").groupBy("at").applyInArrow(merge, "at long, bits binary").collect():
        own = np.frombuffer(r["bits"], np.uint8)[: len(made.data) - r["at"]]
        made.data[r["at"] : r["at"] + len(own)] = own
    return made
