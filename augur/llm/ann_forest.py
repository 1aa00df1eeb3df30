"""Approximate nearest neighbours by inner product with a hash-prefix forest.

A tree is a sorted array of long hash strings, one bit for each of BITS random hyperplanes.
A query descends in every tree to the longest prefix that it shares with an indexed string,
and then all trees ascend together, one bit at a time, until the ranges under the common
prefix length hold enough strings between them; those are scored exactly. Vectors are
first lengthened by one coordinate so that all have the same norm, which turns the largest
inner product into the smallest angle.

How many are enough is measured: SAMPLE queries are compared with every vector by brute
force, in the same scan that counts how many strings share how long a prefix with theirs, and
the smallest number is taken with which ascents hold TARGET of their true neighbours. That
scan is linear; clustered vectors then need few candidates, and vectors without any structure
a share of all.

The arrays are cut by the first bits of the strings into groups of about GROUP, so a query
meets one group in each tree; groups that grow beyond that are cut again, items and queries
each into blocks, and every pair of blocks is a group of its own. A query whose groups hold
too few candidates ascends further, by the counts of the groups, and is sent to all groups
under its shorter prefix; where that would score as many candidates as there are vectors, it
meets every vector once, by the groups of one tree. Equal vectors are indexed
once, with the smallest ids, of which no more than a result's length can ever be reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augur.llm.common import cut, freed, sorted_groups, written

TREES, BITS = 24, 40
SAMPLE = 128  # queries of each length of vectors that are compared with all
TARGET = 0.94  # of their true neighbours that candidates must hold
LEAST = 3000  # candidates, whatever was measured; where there are fewer vectors, all
GROUP = 2048
ITEM_BLOCK, QUERY_BLOCK = 8192, 1024


def _planes(dim: int, trees: int, seed: int = 4) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim + 1, trees * BITS))


def strings(x: np.ndarray, extra: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings of vectors (rows) in each tree, as integers."""
    bits = (np.concatenate([x, extra[:, None]], 1) @ _planes(x.shape[1], trees)) > 0
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return bits.reshape(len(x), trees, BITS).astype(np.int64) @ weight


def distinct_vectors(rows: DataFrame, k: int, double: bool) -> DataFrame:
    """(key: bytes, dim, norm, ids: the k + 1 smallest) of distinct usable vectors."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid:
                    continue
                values = v.values
                if not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    found.setdefault((x + 0).tobytes(), []).append(i)
            if found:
                keys = list(found)
                arrays = [np.frombuffer(key, kind).astype(np.float64) for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([len(a) for a in arrays], pa.int32()), pa.array([float(np.sqrt(a @ a)) for a in arrays], pa.float64()), pa.array([sorted(set(found[key]))[: k + 1] for key in keys], pa.list_(pa.int64()))],
                    ["key", "dim", "norm", "ids"],
                )

    parts = rows.mapInArrow(run, "key binary, dim int, norm double, ids array<long>")
    least = F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {k + 1})").alias("ids")
    # A vector that very many rows share is first reduced in 64 parts.
    parts = parts.groupBy("key", (F.element_at("ids", 1) % 64).alias("part")).agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), least)
    return parts.groupBy("key").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), least)


def _hashed(vectors: DataFrame, most: dict[int, float], double: bool, trees: int, query: bool) -> DataFrame:
    """One row for each vector and tree: (id, dim, tree, hash)."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(keys[i] for i in at), kind).reshape(len(at), dim).astype(np.float64) / most[int(dim)]
                extra = np.zeros(len(at)) if query else np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
                h = strings(x, extra, trees)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], trees)), pa.array(np.full(n * trees, dim, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(h.ravel(), pa.int64())], ["id", "dim", "tree", "hash"])

    return vectors.select("id", "dim", "key").mapInArrow(run, "id long, dim int, tree int, hash long")


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of the common prefix of hash strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def measured(vectors: DataFrame, own: DataFrame, dim: int, most: float, k: int, double: bool, trees: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    """Candidates that the trees must hold between them so that queries of this length find
    ``target`` of their ``k`` nearest on average, by ``sample`` queries (those of the smallest
    hashes of ids) against all ``vectors``."""
    kind = np.float64 if double else np.float32
    drawn = own.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "key").collect()
    who = np.array([r["id"] for r in drawn], np.int64)
    y = np.frombuffer(b"".join(bytes(r["key"]) for r in drawn), kind).reshape(len(drawn), dim).astype(np.float64)
    held = vectors.sparkSession.sparkContext.broadcast((who, y, strings(y / most, np.zeros(len(y)), trees)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, y, hashes = held.value
        depth = np.zeros((len(who), BITS + 1), np.int64)
        best: list[np.ndarray] = [np.zeros((len(who), 0)), np.zeros((len(who), 0), np.int64), np.zeros((len(who), 0), np.int64)]
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                ids, x = part.column(0).to_numpy(), np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(part.num_rows, dim).astype(np.float64)
                score = y @ x.T
                u = x / most
                h = strings(u, np.sqrt(np.maximum(0.0, 1 - (u * u).sum(1))), trees)
                met = np.zeros(score.shape, np.int64)
                other = who[:, None] != ids[None]
                for t in range(trees):
                    same = shared_prefix(hashes[:, t, None], h[None, :, t]).astype(np.int64)
                    met = np.maximum(met, same)
                    depth += np.bincount((np.arange(len(who))[:, None] * (BITS + 1) + same).ravel(), minlength=depth.size).reshape(depth.shape)
                joined = [np.concatenate([b, c], 1) for b, c in zip(best, (np.where(other, score, -np.inf), np.broadcast_to(ids, score.shape), met))]
                order = np.lexsort((joined[1], -joined[0]))[:, :k]
                best = [np.take_along_axis(j, order, 1) for j in joined]
        row, at = np.nonzero(depth)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(at, pa.int32()), pa.array(depth[row, at], pa.int64()), pa.nulls(len(row), pa.float64())], ["q", "d", "n", "score"])
        row, col = np.nonzero(np.isfinite(best[0]))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(best[2][row, col], pa.int32()), pa.array(best[1][row, col], pa.int64()), pa.array(best[0][row, col], pa.float64())], ["q", "d", "n", "score"])

    got = cut(vectors.where(F.col("dim") == dim).select("id", "dim", "key").mapInArrow(freed(run), "q int, d int, n long, score double"))
    depth = np.zeros((len(who), BITS + 1), np.int64)
    for r in got.where("score is null").groupBy("q", "d").agg(F.sum("n").alias("n")).collect():
        depth[r["q"], r["d"]] = r["n"]
    # Each task has its best k; they are reduced in parts first.
    top = F.expr(f"slice(array_sort(collect_list(struct(-score as s, n as id, d as d))), 1, {k})")
    near = got.where("score is not null").groupBy("q", F.spark_partition_id().alias("part")).agg(top.alias("t")).groupBy("q").agg(F.expr(f"slice(array_sort(flatten(collect_list(t))), 1, {k})").alias("t")).select("q", "t.d").collect()
    under = depth[:, ::-1].cumsum(1)[:, ::-1]  # strings that share d bits or more
    true = {r["q"]: np.array(r["d"]) for r in near}

    def recall(wanted: int) -> float:
        levels = (under >= wanted).sum(1) - 1
        return float(np.mean([(d >= levels[q]).mean() if levels[q] > 0 else 1.0 for q, d in true.items()]))

    low, high = 1, int(under.max(initial=1))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(mid) >= target else (mid + 1, high)
    return low


def _depth_counts(batches: Iterator[pa.RecordBatch], cut_bits: dict[int, int]) -> Iterator[tuple]:
    """From rows sorted by group, kind (0 item, 1 query) and hash: for each group its key,
    the items' rows and hashes, and the queries' rows and hashes."""
    keys = ["dim", "tree", "prefix", "si", "sq"]
    for starts, cols in sorted_groups(batches, keys):
        ends = [*starts[1:].tolist(), len(cols["id"])] if starts[-1] < len(cols["id"]) else starts[1:].tolist()
        for a, b in zip(starts.tolist(), ends):
            if a == b:
                continue
            kind = cols["kind"][a:b]
            split = a + int(np.searchsorted(kind, 1))
            if a < split < b:
                yield cut_bits[int(cols["dim"][a])], cols, np.arange(a, split), np.arange(split, b)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec: str = "embedding", vec_id: str = "vec_id", trees: int = TREES, candidates: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by
    ``every``, by inner product in double precision, ties to the smaller id.

    Vectors that are null, empty, zero, or hold nulls or numbers that are not finite take no
    part, nor do rows without id; a vector is compared with those of its own length. Equal
    rows count once, equal vectors under different ids each. Other columns are not read.
    ``candidates``: strings that the trees must hold between them; measured if none are given.
    """
    double = isinstance(vectors.schema[vec].dataType.elementType, T.DoubleType)
    kind = np.float64 if double else np.float32
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("v"))
    rows = rows.withColumn("v", F.col("v").cast("array<double>" if double else "array<float>"))
    reps = written(distinct_vectors(rows, k, double).select(F.element_at("ids", 1).alias("id"), "dim", "norm", "key", "ids"))
    asked = rows.where(f"vec_id % {every} = 0")
    asked = written(distinct_query_rows(asked, double))
    stats = {r["dim"]: (r["n"], r["most"]) for r in reps.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    most = {d: m for d, (_, m) in stats.items()}
    # Queries are indexed vectors themselves; each distinct one is asked once.
    own = written(reps.join(asked.select("key").distinct(), "key", "left_semi"))
    asking = {r["dim"] for r in own.select("dim").distinct().collect()}
    # A table of few vectors has fewer than are wanted, so its queries ascend to the root.
    enough = {d: trees * n + 1 for d, (n, _) in stats.items()}
    for d, (n, m) in stats.items():
        if candidates is not None:
            enough[d] = candidates
        elif d in asking and n > LEAST:
            enough[d] = max(LEAST, measured(reps, own, d, m, k, double, trees))
    # Groups must be wide enough to hold the candidates asked for.
    bits = {d: max(0, int(math.log2(max(1, min(n / GROUP, trees * n / (2 * enough[d])))))) for d, (n, _) in stats.items()}

    def by_dim(values: dict[int, int]) -> Column:
        out = F.lit(0)
        for d, v in values.items():
            out = F.when(F.col("dim") == d, v).otherwise(out)
        return out

    low, wanted = by_dim(bits), by_dim(enough)
    right = lambda c, n: F.call_function("shiftright", F.col(c), n.cast("int"))
    prefix = right("hash", BITS - low)
    items = written(_hashed(reps, most, double, trees, False).withColumn("prefix", prefix))
    queries = written(_hashed(own, most, double, trees, True).withColumn("prefix", prefix))
    place = ["dim", "tree", "prefix"]
    blocks = lambda df, n, name: df.groupBy(*place).count().select(*place, F.ceil(F.col("count") / n).cast("int").alias(name))
    item_blocks = blocks(items, ITEM_BLOCK, "ni")

    def dealt(df: DataFrame, which: int, sizes: DataFrame) -> DataFrame:
        mine, other = ("ni", "nq") if which == 0 else ("nq", "ni")
        names = ("si", "sq") if which == 0 else ("sq", "si")
        df = df.join(sizes, place).withColumn(names[0], F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn("kind", F.lit(which))

    key = [*place, "si", "sq"]

    def grouped(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "kind", "hash")

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for least, cols, it, qu in _depth_counts(batches, bits):
            h, q = cols["hash"][it], cols["hash"][qu]
            n = np.zeros((len(q), BITS + 1), np.int64)
            for d in range(least, BITS + 1):
                a, b = (q >> (BITS - d)) << (BITS - d), ((q >> (BITS - d)) + 1) << (BITS - d)
                n[:, d] = np.searchsorted(h, b) - np.searchsorted(h, a)
            yield pa.RecordBatch.from_arrays([pa.array(cols["id"][qu], pa.int64()), pa.array(cols["dim"][qu], pa.int32()), pa.array(n.tolist(), pa.list_(pa.int64()))], ["id", "dim", "n"])

    cols = [*key, "kind", "hash", "id"]
    sizes = blocks(queries, QUERY_BLOCK, "nq").join(item_blocks, place)
    counts = grouped(dealt(items, 0, sizes).select(*cols), dealt(queries, 1, sizes).select(*cols)).mapInArrow(freed(depths), "id long, dim int, n array<long>")
    # All trees ascend together: the longest prefix under which they hold enough.
    sums = [F.sum(F.element_at("n", d + 1)).alias(f"d{d}") for d in range(BITS + 1)]
    level = F.lit(-1)
    for d in range(BITS + 1):
        level = F.when(F.col(f"d{d}") >= wanted, d).otherwise(level)
    levels = written(counts.groupBy("id", "dim").agg(*sums).select("id", level.alias("level")).where("level >= 0"))
    # The others go on above the prefixes of the groups, up to the root.
    short = queries.join(levels, "id", "left_anti")

    def above(df: DataFrame) -> DataFrame:
        return df.withColumn("d", F.explode(F.sequence(F.lit(0), low))).where((F.col("d") > 0) & (F.col("d") < low)).withColumn("top", right("prefix", low - F.col("d")))

    under = ["dim", "tree", "d", "top"]
    sums = above(short).join(above(items.groupBy(*place).count()).groupBy(*under).agg(F.sum("count").alias("n")), under).groupBy("id", "dim", "d").agg(F.sum("n").alias("n"))
    total = by_dim({d: n for d, (n, _) in stats.items()})
    higher = sums.where(F.col("n") >= wanted).groupBy("id", "dim").agg(F.max(F.struct("d", "n")).alias("b")).select("id", F.when(F.col("b.n") < total, F.col("b.d")).otherwise(0).alias("level"))
    # At the root one tree has all vectors.
    far = short.join(higher, "id", "left").fillna(0, ["level"]).where("level > 0 or tree = 0")
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (low - F.col("level")).cast("int"))
    start = right("prefix", low - F.col("level")) * span
    far = far.withColumn("prefix", F.explode(F.sequence(start, start + span - 1)))
    meets = written(queries.join(levels, "id").unionByName(far))
    sizes = blocks(meets, QUERY_BLOCK, "nq").join(item_blocks, place)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols, it, qu in _depth_counts(batches, bits):
            h, ids = cols["hash"][it], cols["id"][it]
            x = np.frombuffer(b"".join(cols["key"][it]), kind).reshape(len(it), -1).astype(np.float64)
            y = np.frombuffer(b"".join(cols["key"][qu]), kind).reshape(len(qu), -1).astype(np.float64)
            level = cols["level"][qu].astype(np.int64)
            q = cols["hash"][qu]
            a, b = np.searchsorted(h, (q >> (BITS - level)) << (BITS - level)), np.searchsorted(h, ((q >> (BITS - level)) + 1) << (BITS - level))
            out: list[list] = [[], [], []]
            for j, (s, e) in enumerate(zip(a.tolist(), b.tolist())):
                if s == e:
                    continue
                score = np.einsum("ij,j->i", x[s:e], y[j])
                pick = np.lexsort((ids[s:e], -score))[: k + 1]
                out[0] += [int(cols["id"][qu[j]])] * len(pick)
                out[1] += ids[s:e][pick].tolist()
                out[2] += score[pick].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q", "id", "score"])

    level0 = F.lit(0).alias("level")
    full = grouped(
        dealt(items, 0, sizes).select(*cols).join(reps.select("id", "key"), "id").select(*cols, level0, "key"),
        dealt(meets, 1, sizes).select(*cols, "level").join(reps.select("id", "key"), "id").select(*cols, "level", "key"),
    )
    found = full.mapInArrow(freed(scored), "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
    found = found.join(reps.select("id", "ids"), "id")
    top = F.expr(f"slice(array_sort(collect_list(struct(-score as s, id as id, ids as ids))), 1, {k + 1})")
    lists = cut(found.groupBy("q").agg(top.alias("near")))
    # Members of equal vectors in order of score and id; a query drops itself.
    flat = F.expr(f"slice(array_sort(flatten(transform(near, x -> transform(x.ids, i -> struct(x.s as s, i as vec_id))))), 1, {k + 1})")
    lists = lists.join(reps.select(F.col("id").alias("q"), "key"), "q").select("key", flat.alias("near"))
    mine = asked.join(lists, "key").select(F.col("vec_id").alias("query_id"), F.expr(f"slice(filter(near, x -> x.vec_id <> vec_id), 1, {k})").alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def distinct_query_rows(rows: DataFrame, double: bool) -> DataFrame:
    """(vec_id, key) of distinct rows with usable vectors."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        keys.append((x + 0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["vec_id", "key"])

    return rows.mapInArrow(run, "vec_id long, key binary").distinct()
