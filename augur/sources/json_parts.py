"""Elements of arrays in JSON documents of any size, read by many tasks.

Spark reads a document that is not line JSON as one cell. Here a file is cut into parts at any
byte. What a part means depends on what stands before it, but on little of that: whether it begins
in a string (or behind a backslash there), how deep it begins, and under which key. So

1. every part says, for each of the three ways to begin, how it ends and how much deeper,
2. a fold over a file's parts, a row for each, gives every part its true begin,
3. every part says which keys of the document it begins, so that a second fold gives the
   key under which each part begins,
4. every part gives out the elements that begin in it, reading on where one ends later.

A file is read three times, in parallel; nothing but its parts' ends meets in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.sources.shared import written
from augur.sources.shared_files import place

PART = 32 << 20  # bytes of a part
MORE = 64 << 10  # bytes that are read on at once
OUT, IN, BACKSLASH = 0, 1, 2  # outside of strings, in one, and behind a backslash in one

#: A string, also one that does not end here, or a sign of structure.
_token = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[\[\]{},:]', re.S)
_rest = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)', re.S)


def begin(data: bytes, state: int) -> tuple[int, int]:
    """The place behind the string that a part begins in, and the state there; the state is not
    ``OUT`` if the part ends before."""
    if state == OUT:
        return 0, OUT
    at = 1 if state == BACKSLASH else 0
    if at > len(data):
        return at, state
    m = _rest.match(data, at)
    if m.end() > at and data[m.end() - 1 : m.end()] == b'"' and not _open_backslash(data[at : m.end() - 1]):
        return m.end(), OUT
    return m.end(), BACKSLASH if _open_backslash(m[0]) else IN


def _open_backslash(text: bytes) -> bool:
    return (len(text) - len(text.rstrip(b"\\"))) % 2 == 1


def tokens(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    for m in _token.finditer(data, at):
        yield m.start(), m[0]


def summary(data: bytes, state: int) -> tuple[int, int]:
    """How a part ends that begins in ``state``, and how much deeper."""
    at, now = begin(data, state)
    if now != OUT:
        return now, 0
    depth = 0
    for _, t in tokens(data, at):
        c = t[:1]
        if c in b"[{":
            depth += 1
        elif c in b"]}":
            depth -= 1
        elif c == b'"' and (len(t) == 1 or t[-1:] != b'"' or _open_backslash(t[1:-1])):
            return BACKSLASH if _open_backslash(t[1:]) else IN, depth
    return OUT, depth


class Text:
    """A part of a file and what stands behind it, read on as needed."""

    def __init__(self, file: str, start: int, size: int):
        self.system, self.path = place(file)
        self.start, self.size = start, size
        with self.system.open_input_file(self.path) as f:
            self.data = f.read_at(size, start)

    def longer(self) -> bool:
        with self.system.open_input_file(self.path) as f:
            more = f.read_at(MORE, self.start + len(self.data))
        self.data += more
        return bool(more)


def closed(text: Text, at: int) -> int:
    """The place behind the value that begins at ``at``: at a comma or a closing sign of its level,
    or the end of the file."""
    depth, i = 0, at
    while True:
        for s, t in tokens(text.data, i):
            c = t[:1]
            whole = c != b'"' or (len(t) > 1 and t[-1:] == b'"' and not _open_backslash(t[1:-1]))
            if not whole:
                i = s
                break
            if depth == 0 and c in b",]}":
                return s
            depth += (c in b"[{") - (c in b"]}")
            i = s + len(t)
        if not text.longer():
            return len(text.data)


def keys_of(text: Text, state: int, depth: int) -> Iterator[tuple[str, int]]:
    """(key, place behind its colon) of the document's keys that begin in the part."""
    at, now = begin(text.data, state)
    end = text.size
    while now == OUT and at < end:
        for s, t in tokens(text.data, at):
            c = t[:1]
            if s >= end:
                return
            at = s + len(t)
            if c == b'"':
                if depth == 1:
                    # A key or a value: a key if a colon follows. The string may end behind the part.
                    while not (m := re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"\s*([:,}\]])', re.S).match(text.data, s)):
                        if not text.longer():
                            return
                    at = m.start(1)
                    if m[1] == b":":
                        yield json.loads(text.data[s : text.data.rindex(b'"', s, m.start(1)) + 1]), m.end(1)
                        at = m.end(1)
                    break  # tokens anew, as the text may have grown
                if at >= end:
                    return
            else:
                depth += (c in b"[{") - (c in b"]}")
        else:
            return


def elements_of(text: Text, state: int, depth: int, key: str | None, wanted: str | None) -> Iterator[str]:
    """Elements that begin in the part, of the array under ``wanted``, or of the document itself if
    it is a list. ``key``: under which the part begins."""
    starts = {at: k for k, at in keys_of(text, state, depth)} if wanted is not None else {}
    level, now = (2, key) if wanted is not None else (1, wanted)
    at, inside = begin(text.data, state)
    if inside != OUT:
        return
    order = iter(sorted(starts))
    due = next(order, None)
    for s, t in list(tokens(text.data[: text.size], at)):
        while due is not None and due <= s:
            now, due = starts[due], next(order, None)
        c = t[:1]
        if c in b"]}":
            depth -= 1
        opened = c == b"["
        if c in b"[{":
            depth += 1
        if depth == level and now == wanted and (opened or c == b","):
            stop = closed(text, s + 1)
            value = text.data[s + 1 : stop].strip()
            if value:
                yield value.decode("utf-8", "replace")


def _folded(parts: DataFrame) -> DataFrame:
    """(file, part, state, depth, list) from the parts' summaries."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, depth, out = rows.sort_values("part"), OUT, 0, []
        is_list = bool(rows["list"].iloc[0])
        for r in rows.itertuples(index=False):
            out.append((r.file, r.part, r.start, r.size, state, depth, is_list))
            state, depth = r.ends[state], depth + r.deeper[state]
        return pd.DataFrame(out, columns=["file", "part", "start", "size", "state", "depth", "list"])

    return parts.groupBy("file").applyInPandas(fold, "file string, part long, start long, size long, state int, depth long, list boolean")


def _parts(spark: SparkSession, pattern: str, size: int) -> DataFrame:
    """The parts of all files of a pattern, each with its true begin."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(path) or []
    listed = []
    for f in found:
        inner = system.listStatus(f.getPath()) if f.isDirectory() else [f]
        listed += [(g.getPath().toString(), g.getLen()) for g in inner if g.isFile() and not g.getPath().getName().startswith((".", "_"))]
    files = spark.createDataFrame(listed, "file string, length long").where("length > 0")
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("part")
    rows = files.select("file", "length", cut).select("file", "part", (F.col("part") * size).alias("start"), F.least(F.lit(size).cast("long"), F.col("length") - F.col("part") * size).alias("size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                data = Text(file, start, length).data
                ends, deeper = zip(*(summary(data, s) for s in (OUT, IN, BACKSLASH)))
                listed = part == 0 and data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"["
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((file, pa.string()), (part, pa.int64()), (start, pa.int64()), (length, pa.int64()), (list(ends), pa.list_(pa.int32())), (list(deeper), pa.list_(pa.int64())), (listed, pa.bool_()))], ["file", "part", "start", "size", "ends", "deeper", "list"])

    ends = rows.repartition(n, "file", "part").mapInArrow(run, "file string, part long, start long, size long, ends array<int>, deeper array<long>, list boolean")
    return written(_folded(ends)).repartition(n, "file", "part")


def document_keys(spark: SparkSession, pattern: str, size: int = PART) -> DataFrame:
    """(file, part, n, key, value): the keys of documents that are objects, in order, with the JSON of
    values that are no arrays or objects; null for those."""
    return _keys(_parts(spark, pattern, size))


def _keys(parts: DataFrame) -> DataFrame:
    schema = "file string, part long, n long, key string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["list"]:
                    continue
                text, out = Text(r["file"], r["start"], r["size"]), []
                for n, (key, at) in enumerate(keys_of(text, r["state"], r["depth"])):
                    while not text.data[at:].lstrip()[:1] and text.longer():
                        pass
                    value = None
                    if text.data[at:].lstrip()[:1] not in (b"[", b"{"):
                        value = text.data[at : closed(text, at)].strip().decode("utf-8", "replace")
                    out.append({"file": r["file"], "part": r["part"], "n": n, "key": key, "value": value})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("key", pa.string()), ("value", pa.string())]))

    return parts.mapInArrow(run, schema)


def read_array(spark: SparkSession, pattern: str, key: str, size: int = PART) -> DataFrame:
    """(file, part, n, value): the elements, as JSON, of documents that are lists, and of the array
    under ``key`` of those that are objects; their order is that of part and n. Files that are
    no such documents give no elements or such as are no JSON; an empty file gives none."""
    parts = _parts(spark, pattern, size)
    last = _keys(parts).groupBy("file", "part").agg(F.max_by("key", "n").alias("last"))

    # The key under which a part begins is the last one before it: a fold over the parts that have any.
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, key = rows.sort_values("part"), None
        before = []
        for x in rows["last"]:
            before.append(key)
            key = x if isinstance(x, str) else key
        return rows.assign(key=before)[["file", "part", "start", "size", "state", "depth", "list", "key"]]

    kinds = "file string, part long, start long, size long, state int, depth long, list boolean, key string"
    known = written(parts.join(last, ["file", "part"], "left").groupBy("file").applyInPandas(fold, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = Text(r["file"], r["start"], r["size"])
                out, held = [], 0
                for n, v in enumerate(elements_of(text, r["state"], r["depth"], r["key"], None if r["list"] else key)):
                    out.append((r["file"], r["part"], n, v))
                    held += len(v)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return known.repartition(n, "file", "part").mapInArrow(run, "file string, part long, n long, value string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "part", "n", "value"])
