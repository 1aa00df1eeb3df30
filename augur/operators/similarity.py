"""A similarity join of texts by their token sets, and joins of rows that are near in time.

Equal sets are compared once, whatever the number of rows that have them: the join yields
pairs of distinct sets, and rows meet them by the number of their set.

Tokens become numbers within the tasks that hold their rows, by a dictionary that is sent to
them, so that no token is shuffled by itself and each set is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augur.sources.shared import remove, written, written_at

#: Tokens of the dictionary, at most. The most frequent ones are taken; all others are known by their hash.
DICTIONARY = 4 << 20
#: Bytes of sketches that are broadcast at once, at most, so that candidates are sifted before they are shuffled.
SKETCHED = 64 << 20
#: Parts of sets at most, two of which have their sketches broadcast; more sketches are joined to the pairs.
PARTS = 24
#: Pairs that a task looks at together.
TOGETHER = 1 << 19
#: Bytes of a row group of intermediate tables, so that tables of few files are read by many tasks.
GROUP = 4 << 20
#: Prefix tokens under which more sets than this meet are split by a second shared token.
CROWD = 20_000
#: Pairs of a family of sets that are verified in one block, about.
BLOCK = 1 << 14

def tokens_of(text: Column, min_len: int) -> Column:
    """The set of tokens of the normalised text, in order: runs of letters, numbers and
    underscores. One pass over the text, as all else stands between them."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}_]{{{min_len},}}"), F.lit(0))))


def token_sets(rows: DataFrame, text: str, min_len: int, columns: list[Column], bare: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``key`` of their token set, without texts, and the distinct sets (sid, n, s, k)
    as :func:`similar_sets` takes them; texts are cut once. A key is the sid of a set, as it is
    carried with every pair. Rows without tokens are left out, or with ``bare`` have no key."""
    spark = rows.sparkSession
    toks = tokens_of(F.col(text), min_len)
    cut, path = written_at(rows.select(*columns, toks.alias("toks")).withColumn("key", F.when(F.size("toks") > 0, F.unhex(F.sha2(F.array_join("toks", " "), 256)))), GROUP)
    coded, coded_path = written_at(_encoded(cut), GROUP)
    remove(spark, path)
    known = coded.where("key is not null")
    own = known.groupBy("key").agg(F.first(F.struct("n", "s", "k")).alias("v"))
    sets = written(own.select("key", F.monotonically_increasing_id().alias("sid"), "v.*"), GROUP)
    slim = known.drop("n", "s", "k").join(sets.select("key", F.col("sid").alias("_sid")), "key").drop("key").withColumnRenamed("_sid", "key")
    if bare:
        slim = slim.unionByName(coded.where("key is null").drop("n", "s", "k").withColumn("key", F.lit(None).cast("long")))
    slim = written(slim)
    remove(spark, coded_path)
    return slim, sets.drop("key")


def _hash(token: Column, seed: int) -> Column:
    return F.xxhash64(token, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))


def _dictionary(cut: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray, bool] | None:
    """(hashes in order, their ranks, whether it has all tokens of more than one row) of at most
    DICTIONARY tokens; rarer ones have lower ranks. None if two tokens have the same hash, which
    a second hash tells."""
    words = cut.select(F.explode("toks").alias("t")).select(_hash(F.col("t"), seed).alias("h"), F.xxhash64("t").alias("g"))
    counts, path = written_at(words.groupBy("h").agg(F.count("*").alias("df"), F.min("g").alias("lo"), F.max("g").alias("hi")))
    try:
        if not counts.where("lo <> hi").isEmpty():
            return None
        # As many rows as there are different frequencies.
        often = sorted(((r.df, r.n) for r in counts.where("df > 1").groupBy("df").agg(F.count("*").alias("n")).collect()), reverse=True)
        least, room = 2, DICTIONARY
        for df, n in often:
            if n > room:
                least = df + 1
                break
            room -= n
        got = counts.where(F.col("df") >= least).select("h", "df").toArrow()
    finally:
        remove(cut.sparkSession, path)
    h, df = got["h"].to_numpy(), got["df"].to_numpy()
    rank = np.empty(len(h), np.int32)
    rank[np.lexsort((h, df))] = np.arange(len(h), dtype=np.int32)
    order = np.argsort(h)
    if not len(h):
        return np.array([-1]), np.zeros(1, np.int32), least == 2  # no hash is negative
    return h[order], rank[order], least == 2


def _encoded(cut: DataFrame) -> DataFrame:
    """``cut`` with n, the number of its tokens; s, their ranks in order; and k, a sketch of them, in
    place of ``toks``. A sketch has at least two bits a token, of which each token turns over one. Tokens of one row alone are not in s, as nothing is found by them. Those that
    a full dictionary has no room for are as rare as any and stand first, as negative hashes."""
    seed = 1
    while (made := _dictionary(cut, seed)) is None:
        seed += 1
    held = cut.sparkSession.sparkContext.broadcast(made)
    hashed = cut.withColumn("toks", F.transform("toks", lambda t: _hash(t, seed)))
    kind = "int" if made[2] else "long"
    own = [c for c in cut.columns if c != "toks"]
    schema = hashed.select(*own, F.lit(0).alias("n"), F.array().cast(f"array<{kind}>").alias("s"), F.lit(b"").alias("k")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks, whole = held.value
        for full in batches:
            for at in range(0, full.num_rows, 2_000):
                batch = full.slice(at, 2_000)
                toks = batch.column("toks")
                n = np.diff(toks.offsets.to_numpy()).astype(np.int64)
                h = toks.flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, 2 * n))).astype(np.int64))
                starts = np.cumsum(width) - width
                bits = np.bincount(starts[row] + (h & (width[row] - 1)), minlength=int(width.sum())) & 1
                packed = np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
                k = pa.array([packed[a : a + w] for a, w in zip((starts // 8).tolist(), (width // 8).tolist())], pa.binary())
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                known = hashes[place] == h
                if whole:
                    row, ids = row[known], ranks[place[known]]
                else:
                    ids = np.where(known, ranks[place], -1 - h)
                ids = ids[np.lexsort((ids, row))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
                s = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32() if whole else pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n.astype(np.int32)), s, k], [*own, "n", "s", "k"])

    return hashed.mapInArrow(run, schema)


def _words(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches as words of 64 bits, where each begins, and how many words each has."""
    size = np.fromiter((len(x) // 8 for x in sketches.to_pylist()), np.int64, len(sketches))
    return np.frombuffer(b"".join(sketches.to_pylist()), "<u8"), np.cumsum(size) - size, size


def _apart(words: np.ndarray, starts: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits sketches ``x`` and ``y`` differ; the sets differ in at least as many tokens.
    A sketch that is wider is folded to the other's width."""
    out = np.zeros(len(x), np.int64)
    both = np.minimum(size[x], size[y])
    for w in np.unique(both):
        at = np.flatnonzero(both == w)
        for part in np.array_split(at, 1 + len(at) * int(w) // (1 << 20)):
            bits = np.zeros((len(part), w), np.uint64)
            for side in (x[part], y[part]):
                for fold in range(int((size[side] // w).max(initial=0))):
                    some = np.flatnonzero(size[side] // w > fold)
                    bits[some] ^= words[(starts[side[some]] + fold * w)[:, None] + np.arange(w)]
            out[part] = np.bitwise_count(bits).sum(1)
    return out


def _room(sets: DataFrame) -> int:
    """Bytes that all sketches take."""
    return sets.agg(F.sum(F.length("k") + 16)).first()[0] or 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns rank, n, sid, pos and last of whole groups of a rank, of rows sorted by rank. Holds a group and a batch."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy().astype(np.int64) for c in ("rank", "n", "sid", "pos", "last")]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if len(held[0]):
            end = np.searchsorted(held[0], held[0][-1])
            if end:
                yield [x[:end] for x in held]
                held = [x[end:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _fitting(rank: np.ndarray, n: np.ndarray, pos: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a rank, rows sorted by rank and size, whose sizes fit and whose overlap can
    still be reached by what stands behind the shared token: a set of n with the token in place
    pos meets none of more than (n - pos) (1 + t) / t - n tokens. Partners of a set are a run of rows."""
    tiny = 1e-9
    cap = np.floor((n - pos + tiny) * (1 + threshold) / threshold + tiny).astype(np.int64) - n
    large = np.minimum(np.floor((n + tiny) / threshold + tiny).astype(np.int64), cap)
    group = np.cumsum(np.diff(rank, prepend=rank[0]) != 0) * (n.max() + 2)
    count = np.maximum(0, np.searchsorted(group + n, group + np.minimum(large, n.max()), "right") - np.arange(1, len(n) + 1))
    ends = np.cumsum(count)
    a = 0
    while a < len(n):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + TOGETHER, "right")))
        some = count[a:b]
        left = np.repeat(np.arange(a, b), some)
        right = left + 1 + np.arange(len(left)) - np.repeat(ends[a:b] - some - done, some)
        ok = n[left] <= cap[right]
        yield left[ok], right[ok]
        a = b


def _met(entries: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of ``entries`` (sid, n, pos, rank, last) that fit under a rank and whose sketches do not tell them
    apart. Pairs are made by the task that has the rank's entries and sifted there, so that only
    those that pass are shuffled. Where the same token, ``last``, stands before the rank in both sets, they
    have met under it, so that near copies are given out once for each run of tokens they share. Where all sketches take more than SKETCHED, sets are dealt into
    parts, and any two parts meet with their sketches alone; each pair of sets meets once."""
    room = _room(sets)
    parts = 1 if room <= SKETCHED else -(-2 * room // max(1, SKETCHED))
    whole = parts <= PARTS
    t = threshold

    def meet(entries: DataFrame, held, two: bool, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rank, n, sid, pos, last in _groups(batches):
                if held is not None:
                    sids, words, starts, size = held.value
                    at = np.searchsorted(sids, sid)
                for left, right in _fitting(rank, n, pos, t):
                    new = (last[left] != last[right]) | (last[left] == rank[left])
                    left, right = left[new], right[new]
                    if two:
                        ok = sid[left] % parts != sid[right] % parts
                        left, right = left[ok], right[ok]
                    most = np.floor((n[left] + n[right]) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)
                    if held is not None:
                        ok = _apart(words, starts, size, at[left], at[right]) <= most
                        left, right = left[ok], right[ok]
                    x, y = sid[left], sid[right]
                    cols = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                    yield pa.RecordBatch.from_arrays(cols, ["x", "y"]) if held is not None else pa.RecordBatch.from_arrays([*cols, pa.array(most.astype(np.int32))], ["x", "y", "most"])

        return entries.repartition("rank").sortWithinPartitions("rank", "n").mapInArrow(run, schema)

    if not whole:
        return _sifted(meet(entries, None, False, "x long, y long, most int"), sets)
    found = None
    for i in range(parts):
        for j in range(i, parts):
            own = F.col("sid") % parts
            got = sets.where(own.isin(i, j)).select("sid", "k").orderBy("sid").toArrow()
            held = sets.sparkSession.sparkContext.broadcast((got["sid"].to_numpy(), *_words(got["k"].combine_chunks())))
            met = meet(entries.where(own.isin(i, j)), held, i != j, "x long, y long").distinct()
            if parts > 1:
                met = written(met)
                held.destroy()
            found = met if found is None else found.unionByName(met)
    return found


def _sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) of ``pairs`` (x, y, most) whose sketches differ in at most ``most`` bits, once each."""
    if _room(sets) > SKETCHED:
        side = lambda c: sets.select(F.col("sid").alias(c), F.col("k").alias(f"k{c}"))
        met = pairs.distinct().join(side("x"), "x").join(side("y"), "y")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i = np.arange(batch.num_rows)
                far = _apart(*_words(pa.concat_arrays([batch.column("kx"), batch.column("ky")])), i, i + batch.num_rows)
                yield batch.select(["x", "y"]).filter(pa.array(far <= batch.column("most").to_numpy()))

        return met.select("x", "y", "most", "kx", "ky").mapInArrow(own, "x long, y long")
    got = sets.select("sid", "k").orderBy("sid").toArrow()
    held = sets.sparkSession.sparkContext.broadcast((got["sid"].to_numpy(), *_words(got["k"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, words, starts, size = held.value
        for batch in batches:
            x, y = (np.searchsorted(sids, batch.column(c).to_numpy()) for c in ("x", "y"))
            yield batch.select(["x", "y"]).filter(pa.array(_apart(words, starts, size, x, y) <= batch.column("most").to_numpy()))

    return pairs.mapInArrow(run, "x long, y long").distinct()


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y), x < y: pairs of sets (sid) that may reach ``threshold``, and all that do.

    If J(A, B) >= t, the sets share a token among the first |A| - ceil(t |A|) + 1 of each. They
    meet under those tokens if their sizes fit and if what stands behind the shared tokens
    can still make up the overlap. A token that is in very many prefixes is joined on together
    with a second one: with prefixes longer by one, two tokens are shared. Pairs whose
    sketches differ in more bits than similar sets have different tokens are left out,
    before they are shuffled up to PARTS / 2 times SKETCHED; long sets have wide sketches."""
    t, tiny = F.lit(threshold), F.lit(1e-9)  # 0.7 * 10 must not become 8 by rounding
    keep = (F.col("n") - F.ceil(F.col("n") * t - tiny) + 1).cast("int")
    # Tokens of a set alone stand before the others.
    alone = F.col("n") - F.size("s")
    some = sets.where("n > 1").withColumns({"keep": F.greatest(F.lit(0), keep - alone), "alone": alone})
    # A set's first token has itself as ``last``.
    leads = F.slice("s", F.lit(1), F.col("keep"))
    lead = F.posexplode(F.transform(leads, lambda r, i: F.struct(r.alias("rank"), F.get("s", F.greatest(F.lit(0), i - 1)).alias("last"))))
    entries = some.select("sid", "n", "alone", lead.alias("i", "e")).select("sid", "n", (F.col("i") + F.col("alone")).alias("pos"), "e.rank", "e.last")
    crowded = written(entries.groupBy("rank").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("rank"))
    few = entries.join(F.broadcast(crowded), "rank", "left_anti") if not crowded.isEmpty() else entries
    out = _met(few, sets, threshold)
    if few is not entries:
        small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
        fits = small >= large * t - tiny
        # |A xor B| = |A| + |B| - 2 |A and B|
        most = F.floor((F.col("a.n") + F.col("b.n")) * (1 - t) / (1 + t) + tiny).cast("int")
        many = some.withColumn("lead", F.slice("s", F.lit(1), F.col("keep"))).select("sid", "n", F.slice("s", F.lit(1), F.greatest(F.lit(0), keep + 1 - F.col("alone"))).alias("more"), F.explode("lead").alias("rank")).join(F.broadcast(crowded), "rank")
        two = many.select("sid", "n", "rank", F.explode("more").alias("other")).where("other <> rank")
        two = two.select("sid", "n", F.least("rank", "other").alias("lo"), F.greatest("rank", "other").alias("hi")).distinct()
        a, b = two.alias("a"), two.alias("b")
        met = a.join(b, (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.sid") < F.col("b.sid")) & fits)
        out = out.unionByName(_sifted(met.select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y"), most.alias("most")), sets)).distinct()
    return out


def dealt(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, x, y, n, s) of ``pairs`` (x, y) and of the sets (x, without y) that a block's pairs need.
    The pairs of a set y lie in the family of its smallest partner, so that sets which are all
    similar to one another are sent to one block and not with every pair. A family of many pairs
    is cut by both sets' hashes into blocks of BLOCK pairs, about."""
    home = F.min("x").over(Window.partitionBy("y"))
    homes = written(pairs.withColumn("home", home))
    wide = homes.groupBy("home").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("home", F.ceil(F.sqrt(F.col("c") / BLOCK)).alias("cuts"))
    cut = homes.join(F.broadcast(wide), "home", "left")
    part = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.col("cuts")), F.lit(0))
    met = written(cut.select(F.xxhash64("home", part("x"), part("y")).alias("block"), "x", "y"))
    needed = met.select("block", F.explode(F.array("x", "y")).alias("sid")).distinct()
    held = sets.select("sid", "n", "s").join(needed, "sid").select("block", F.col("sid").alias("x"), F.lit(-1).cast("long").alias("y"), "n", "s")
    return held.unionByName(met, allowMissingColumns=True)


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows sorted by ``column`` in tables that have all rows of a value. Holds a value's rows and a batch."""
    held = None
    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            at = held[column].to_numpy()
            end = int(np.searchsorted(at, at[-1]))
            if end:
                yield held.slice(0, end)
                held = held.slice(end)
    if held is not None:
        yield held


def _common(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The pairs of ``table``, of rows as :func:`dealt` gives them in whole blocks, in order; how many
    tokens the two sets share, and how many they have together."""
    own = table["y"].to_numpy() < 0
    held = table.filter(pa.array(own))
    sids, first = np.unique(held["x"].to_numpy(), return_index=True)
    held = held.take(pa.array(first))
    n = held["n"].to_numpy().astype(np.int64)
    s = held["s"].combine_chunks()
    starts, size, toks = s.offsets.to_numpy()[:-1].astype(np.int64) - s.offsets[0].as_py(), np.diff(s.offsets.to_numpy()).astype(np.int64), s.flatten().to_numpy()
    if (toks < 0).any():  # hashes, not ranks in the dictionary
        toks = np.unique(toks, return_inverse=True)[1]
    seen = np.zeros(int(toks.max(initial=0)) + 1, bool)
    pairs = table.filter(pa.array(~own)).select(["x", "y"]).sort_by([("x", "ascending"), ("y", "ascending")])
    x, y = (np.searchsorted(sids, pairs[c].to_numpy()) for c in ("x", "y"))
    common = np.zeros(len(x), np.int64)
    heads = np.flatnonzero(np.diff(x, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(x)]):
        mine = toks[starts[x[a]] : starts[x[a]] + size[x[a]]]
        seen[mine] = True
        for some in np.array_split(np.arange(a, b), 1 + int(size[y[a:b]].sum()) // (1 << 22)):
            many = size[y[some]]
            ends = np.cumsum(many)
            hit = seen[toks[np.repeat(starts[y[some]] - ends + many, many) + np.arange(int(many.sum()))]]
            common[some] = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])
        seen[mine] = False
    return pairs, common, n[x] + n[y] - common


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity) of different token sets, by their sid, x before y, of at least ``threshold``.
    Candidates are verified exactly, on arrays of numbers; only sets that are in some are
    shuffled for it, once for each block of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "block"):
            pairs, common, union = _common(table)
            sim = common / union
            ok = sim >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(pairs[c].to_numpy()[ok]) for c in ("x", "y")] + [pa.array(sim[ok])], ["x", "y", "similarity"])

    rows = dealt(written(candidates(sets, threshold)), sets)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "x long, y long, similarity double")


def either_way(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of sets in both directions, and each set with itself."""
    both = F.explode(F.array(F.struct("x", "y", "similarity"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "similarity"))).alias("p")
    own = sets.select(F.col("sid").alias("x"), F.col("sid").alias("y"), F.lit(1.0).alias("similarity"))
    return near.select(both).select("p.*").unionByName(own)


def near_in_time(left: DataFrame, right: DataFrame, on: list[str], day: str, other_day: str, window_days: int) -> DataFrame:
    """Join on ``on`` of rows at most ``window_days`` apart. Both sides lie in buckets of days that
    are one wider than the window, so that a row meets its own bucket and the two beside it, and not
    a key's whole history. Rows without a date meet none."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (window_days + 1))
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: bucket(F.col(day)) + i)))
    b = right.withColumn("_bucket", bucket(F.col(other_day)))
    return a.join(b, [*on, "_bucket"]).where(F.abs(F.datediff(day, other_day)) <= window_days).drop("_bucket")
