"""Shared helpers: shared-folder tables, word splitting, batch slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Fixed value: the word pattern of the contracts (anything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; release() says when it goes."""
    return f"{new_folder(spark)}/{tag}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage, nothing redone."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """df with only these columns; a missing one is an error that names it."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, name: str) -> str:
    """A name like name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: The largest number of keys that a join may spread by broadcast.
HOT_KEYS = 10_000


def spread_join(many: DataFrame, one: DataFrame, key: str, weight: str) -> DataFrame:
    """many joined with one, which has a row for each key and in weight how many rows of many have it, or more.

    Keys with over 1 / HOT_KEYS of all weight, of which there can't be more than HOT_KEYS, are joined where
    the rows of many are; so no key sends more rows than that share to one task.
    """
    total = one.agg(F.sum(weight).alias("total"))
    share = F.col(weight) * HOT_KEYS > total.scalar()
    hot = one.where(share).drop(weight)
    cold = one.where(~share).drop(weight)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


@cache
def _trim():
    """The C library's call that gives free memory back; None where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after each, what the worker no longer uses goes back to the machine, as workers outlive their tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about max_bytes of text each, so a worker's memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.fromiter(((len(x.as_buffer()) if x.is_valid else 0) + 64 for x in batch.column(column)), np.int64, batch.num_rows))
        part = sizes // max_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: tuple[str, ...], least: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns in parts of least rows or more that never cut a group; rows come in the order of their groups (keys).

    A group is held whole, each of its rows once.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size, of = 0, [columns.index(k) for k in keys]
    for batch in batches:
        if not batch.num_rows:
            continue
        part = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)
        if size >= least:
            other = np.logical_or.reduce([part[k] != held[-1][k][-1] for k in of])
            if other.any():
                cut = int(other.argmax())
                held.append(tuple(x[:cut] for x in part))
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size, part = [], 0, tuple(x[cut:] for x in part)
        held.append(part)
        size += len(part[0])
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def words_of(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Offsets of each text's words, the words' numbers, and the word of each number (UTF-8)."""
    raw = (t.encode("utf-8", "surrogatepass") for t in texts)
    each = [r.translate(_ASCII_LOWER).split() for r in raw] if lower else [r.split() for r in raw]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
    flat = list(chain.from_iterable(each))
    known = dict(zip(dict.fromkeys(flat), count()))
    return offsets, np.fromiter(map(known.__getitem__, flat), np.int32, len(flat)), list(known)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; workers have no session to parse it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def record_batch(schema: str, columns: dict) -> pa.RecordBatch:
    fields = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in fields], schema=fields)
