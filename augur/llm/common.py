"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augur.sources.shared import remove, written, written_at

#: Deletes no byte and lower-cases A-Z only, as the word contracts ask.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between white space (space, tab to carriage return), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


#: Cuts lineage by a table in the shared folder.
cut = written


def freed(run):
    """``run`` for mapInArrow, after which the worker gives its unused memory back, so that the
    workers of one stage don't stand in the way of the next one."""

    @wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return go


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], n_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``n_bytes``; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * n_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """From batches sorted by integer ``keys``, yields blocks of whole groups as
    (first rows of the groups, then the number of rows; columns). Holds one group and
    one batch at a time."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = {f: c.to_numpy(zero_copy_only=False) for f, c in zip(batch.schema.names, batch.columns)}
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        n = len(now[keys[0]])
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        starts = np.flatnonzero(new)
        end = starts[-1]
        if len(starts) > 1:
            yield starts, {k: v[:end] for k, v in now.items()}
        held = {k: v[end:] for k, v in now.items()}
    if held is not None:
        n = len(held[keys[0]])
        yield np.array([0, n]), held


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long) by alternating large-star
    and small-star steps until nothing changes, which takes a number of rounds of the order
    of the squared logarithm of the nodes; every round is an aggregation by node and a join,
    and is cut in the shared folder, where the round before it is deleted. Returns (node,
    root): the smallest node that can be reached; roots themselves are left out. Nothing but a
    count and a checksum comes to the driver. Rows of a star's centre are split by AQE.
    """
    spark = edges.sparkSession
    e, path = written_at(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        # Large star: each node's larger neighbours go to its smallest neighbour.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
        e, new = written_at(
            small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        remove(spark, path)
        path = new
        row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        now = (row["n"], row["h"])
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


#: Keys with more than 1 / HOT of the rows, of which there are at most HOT, are broadcast.
HOT = 20_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` to ``table``, one row a key with the key's number of rows in
    ``count`` (``table`` should be written, as it is read thrice). Hot keys meet their rows
    where those are, so that no task gets all rows of a key."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > max(10_000, total / HOT))
    if hot.isEmpty():
        return rows.join(table, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])
