"""Quality scores by a factorisation machine.

Features of a document are the hashed words of its text, all of them, statistics of the
text's structure in steps, and steps of its metadata (numeric columns, such as a stated
length, also against the length that the text has). The machine adds to a linear score all pairwise interactions of
features, each the inner product of two low-rank vectors; by the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2
that takes time linear in the number of features. It is fitted by Adagrad on a bounded
sample of labelled rows (SAMPLE, the smallest hashes of doc_id); all rows are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augur.llm.common import crc_mod, freed, slices, texts

CELLS = 1 << 15
RANK = 6
SAMPLE = 12_000
EPOCHS = 8
_ALPHA = re.compile(r"[^\W\d_]+")
_cells: dict[str, int] = {}


def _cell(word: str) -> int:
    got = _cells.get(word)
    if got is None:
        if len(_cells) > 500_000:
            _cells.clear()
        got = _cells[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % CELLS
    return got


def structure(text: str) -> list[str]:
    """Names of the steps into which statistics of the whole text fall."""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    ratio = {
        "alpha": sum(map(len, _ALPHA.findall(text))) / max(1, n),
        "digit": len(re.findall(r"\d", text)) / max(1, n),
        "upper": len(re.findall(r"[A-Z]", text)) / max(1, n),
        "space": sum(map(str.isspace, text)) / max(1, n) if n < 4096 else len(re.findall(r"\s", text)) / n,
        "distinct": len(set(words)) / m,
        "lines": len(set(lines)) / k,
        "stop": len(re.findall(r"[.!?](?:\s|$)", text)) / m,
        "odd": len(re.findall(r"[^\w\s.,;:!?'\"()-]", text)) / max(1, n),
        "top": max(Counter(words).values(), default=0) / m,
    }
    out = [f"\0{name}{min(24, int(math.sqrt(v) * 24))}" for name, v in ratio.items()]
    size = {"n": n, "words": len(words), "line": n / k, "word": sum(map(len, words)) / m, "rows": len(lines)}
    return out + [f"\0{name}{int(math.log2(1 + v) * 2)}" for name, v in size.items()]


def described(meta: dict[str, float | None], n: int) -> list[str]:
    """Names of the steps of metadata: its size, and how it compares to ``n`` characters."""
    out = []
    for name, v in meta.items():
        if v is None or not math.isfinite(v):
            out.append(f"\1{name} none")
        else:
            out.append(f"\1{name}{int(math.copysign(math.log2(1 + abs(v)) * 2, v))}")
            out.append(f"\1{name} to text {max(-8, min(8, round(math.log2((1 + abs(v)) / (1 + n)) * 2)))}")
    return out


def features(text: str | None, meta: dict[str, float | None] | None = None) -> tuple[list[int], list[float]]:
    """Cells and values of all words of the text, counts summed by cell, of its structure
    and of metadata."""
    text = text or ""
    count: dict[int, int] = {}
    for w, c in Counter(text.lower().split()).items():
        cell = _cell(w)
        count[cell] = count.get(cell, 0) + c
    weight = [1 + math.log(c) for c in count.values()]
    norm = math.sqrt(sum(weight)) or 1.0
    shape = structure(text) + described(meta or {}, len(text))
    return [*count, *map(_cell, shape)], [math.sqrt(v) / norm for v in weight] + [0.5] * len(shape)


class Machine:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(CELLS)
        self.v = rng.normal(0, 0.02, (CELLS, RANK))

    def raw(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        linear = np.add.reduceat(self.w[ids] * x, starts)
        return self.bias + linear + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts)), s

    def score(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        ids, x, starts = _flat(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, x, starts)[0], -35, 35)))

    def fit(self, rows: list[tuple[list[int], list[float]]], y: np.ndarray, rate: float = 0.1, decay: float = 2e-5, seed: int = 9) -> Machine:
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(CELLS, 1e-2), np.full((CELLS, RANK), 1e-2), 1e-2
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = math.log(mean / (1 - mean))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                ids, x, starts = _flat([rows[i] for i in pick])
                out, s = self.raw(ids, x, starts)
                err = (1 / (1 + np.exp(-np.clip(out, -35, 35))) - y[pick]) / len(pick)
                sizes = np.diff(np.append(starts, len(ids)))
                e = np.repeat(err, sizes)
                cells, inv = np.unique(ids, return_inverse=True)
                dw = np.bincount(inv, e * x, len(cells)) + decay * self.w[cells]
                per = e[:, None] * (x[:, None] * np.repeat(s, sizes, axis=0) - self.v[ids] * (x * x)[:, None])
                dv = np.stack([np.bincount(inv, per[:, f], len(cells)) for f in range(RANK)], 1) + decay * self.v[cells]
                gw[cells] += dw * dw
                gv[cells] += dv * dv
                gb += err.sum() ** 2
                self.w[cells] -= rate * dw / np.sqrt(gw[cells])
                self.v[cells] -= rate * 0.3 * dv / np.sqrt(gv[cells])
                self.bias -= rate * err.sum() / math.sqrt(gb)
        return self


def _flat(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r[0]) for r in rows], np.int64)
    ids = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    x = np.concatenate([np.asarray(r[1], np.float64) for r in rows])
    return ids, x, np.concatenate([[0], np.cumsum(sizes)[:-1]])


#: Numeric columns of documents that are read as metadata where they are there.
METADATA = ("n_chars",)


def _read(docs: DataFrame, text: str, keys: list[Column]) -> tuple[DataFrame, list[str]]:
    """``keys``, text and metadata of documents, the latter as doubles under fixed names."""
    plain = (T.NumericType, T.StringType)
    meta = [c for c in METADATA if c in docs.columns and c != text and isinstance(docs.schema[c].dataType, plain)]
    cols = [F.col(c).try_cast("double").alias(f"_m{i}") for i, c in enumerate(meta)]
    return docs.select(*keys, F.col(text).cast("string").alias("text"), *cols), meta


def _features_of(batch: pa.RecordBatch, meta: list[str]) -> list[tuple[list[int], list[float]]]:
    columns = [batch.column(batch.schema.get_field_index(f"_m{i}")).to_pylist() for i in range(len(meta))]
    rows = zip(*columns) if columns else iter(lambda: (), None)
    return [features(t, dict(zip(meta, m))) for t, m in zip(texts(batch), rows)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Machine | None:
    """Fits on at most ``sample`` labelled documents, those of the smallest hashes of ids.
    Labels other than 0 and 1 and rows without id are no labels; ids with both labels take
    the larger; of documents under one id the text with the smallest hash is read, so that the
    sample bounds rows. None where no labelled document is left."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    # A threshold first, so that little is sorted; four standard deviations over the bound.
    share = min(1.0, (sample + 4 * math.sqrt(sample) + 1) / n) if n > sample else 1.0
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id").limit(sample)
    rows, meta = _read(docs, text, [F.col(doc_id).alias("_id")])
    rows = rows.join(F.broadcast(chosen), "_id")
    names = ["text", *[f"_m{i}" for i in range(len(meta))]]
    one = F.min_by(F.struct(*names), F.struct(F.xxhash64("text").alias("h"), F.struct(*names).alias("r"))).alias("r")
    rows = rows.groupBy("_id", "_y").agg(one).select("_id", "_y", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = _features_of(batch, meta)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["_id", "_y", "ids", "x"])

    schema = rows.select("_id", "_y", F.array(F.lit(0)).alias("ids"), F.array(F.lit(0.0).cast("float")).alias("x")).schema
    got = rows.mapInArrow(freed(run), schema).toArrow()
    if not got.num_rows:
        return None
    # The order in which rows arrive must not matter.
    got = got.sort_by([("_id", "ascending"), ("_y", "ascending")])
    ids, x = got["ids"].combine_chunks(), got["x"].combine_chunks()
    ends = np.cumsum(ids.value_lengths().to_numpy())[:-1]
    data = list(zip(np.split(ids.flatten().to_numpy(), ends), np.split(x.flatten().to_numpy(), ends)))
    return Machine().fit(data, got["_y"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine | None, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row; null texts count as empty, nulls in metadata are
    a feature of their own, and without a fitted machine every score is 0.5. Rows are judged
    by themselves; columns other than the text, the id and METADATA are not read."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    rows, meta = _read(docs, text, [F.col(doc_id).alias("doc_id")])
    schema = rows.select("doc_id", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches):
            out = m.score(_features_of(batch, meta)) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(freed(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels of rows whose
    crc32(doc_id) mod 4 is not 2.

    Null texts are empty ones, which are scored too; null labels, and labels of ids that have no
    document, teach nothing; repeated ids and rows are scored again, while an id teaches once,
    by the larger of its labels; a null id counts as the empty text in the crc. Without a
    labelled document every score is 0.5. A score of exactly the threshold is a 1. Further columns are not read,
    but for n_chars; an empty table gives no rows."""
    machine = fit(docs, labels.where(crc_mod(doc_id, 4) != 2), text, doc_id, label)
    return score(docs, machine, text, doc_id).withColumn("held_out", crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "score", "predicted")
