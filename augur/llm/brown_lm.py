"""Language-model scores of a class-based bigram model with learned classes.

    P(word | previous) = P(class | previous class) * P(word | class)

Classes are found by exchange clustering: every item moves to the class that raises the
likelihood of the class bigrams most. A round moves a part of the items at once against the
counts of the round before; a round that does not raise the likelihood is taken back and the
parts are made smaller, and rounds end when a whole sweep over the parts gains less than
GAIN a token. All rounds read one table of item bigrams, packed by item, so that they
shuffle nothing; it is made in one pass over the texts and grows with the distinct bigrams
and not with the tokens.

Words that make up at least SHARE of the tokens, at most 1 / SHARE of them, are items of
their own; all other words are grouped by their ending into TAIL items. So item tables are
bounded whatever the corpus, and are sent to the workers. Counts are of all words over all
training rows. Those of rare words never travel to a document: the document's rare words
travel to them, as postings of blocks of documents dealt by a hash of the word into
buckets, and come back summed up.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.llm.common import LOWER, crc_mod, freed, slices, texts, written

SHARE = 4e-6
TAIL = 4096
CLASSES = 64  # class 0 holds only the end of a text
ROUNDS = 10  # at most
GAIN = 5e-3  # of log likelihood a token (natural logarithms)
DELTA = 0.5  # added to word counts
KAPPA = 20.0  # strength of the class unigram behind class bigrams
END = b""
BLOCK = 4 << 20  # bytes of text in a block of postings
PACKED = 1 << 16  # bigrams in a row, but for items that have more
SIDE = 1 << 31
GROUP = 8 << 20  # bytes in a row group of the tables with packed rows
_items: dict[str, dict[bytes, int]] = {}


def _words(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts of a batch, END after each text; tokens of each text."""
    out: list[bytes] = []
    sizes = []
    for t in texts(batch):
        w = t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else []
        out += w
        out.append(END)
        sizes.append(len(w) + 1)
    return out, np.array(sizes, np.int64)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``rows``, the end of a text as the empty word. Tasks add
    up before the shuffle, holding at most a quarter million words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in slices(batches):
            count.update(_words(batch)[0])
            if len(count) > 250_000:
                yield _pairs(count)
                count = Counter()
        if count:
            yield _pairs(count)

    return rows.select("text").mapInArrow(freed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(count: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])


def tail_item(word: bytes) -> int:
    return 1 + zlib.crc32(word[-3:]) % TAIL


def _key(held) -> str:
    return held.value[0]


def _dictionary(held) -> dict[bytes, int]:
    """Item of each frequent word, built once in a worker."""
    if _key(held) not in _items:
        _items.clear()
        words: list[bytes] = held.value[1]
        _items[_key(held)] = {END: 0} | {w: TAIL + 1 + i for i, w in enumerate(words)}
    return _items[_key(held)]


def _sequence(batch: pa.RecordBatch, item_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(items of the tokens, tokens of each text, distinct rare words, places of rare tokens,
    which rare word each is)."""
    words, sizes = _words(batch)
    get = item_of.get
    items = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
    at = np.flatnonzero(items < 0)
    own: dict[bytes, int] = {}
    which = np.fromiter((own.setdefault(words[i], len(own)) for i in at.tolist()), np.int64, len(at))
    rare = list(own)
    if rare:
        items[at] = np.fromiter(map(tail_item, rare), np.int32, len(rare))[which]
    return items, sizes, rare, at, which


def _buckets(rows: DataFrame, tokens: int | None = None) -> int:
    """How many buckets numbers are dealt into: several a shuffle partition, so that one fits a
    task, but one for each half million ``tokens`` is enough, as tasks deal a row a bucket."""
    most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return most if tokens is None else min(most, max(8, tokens // 500_000))


def _dealt(keys: np.ndarray, sums: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, keys, sums) for each bucket, the numbers as bytes in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, sums = bucket[order], keys[order], sums[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts], pa.int32()), *(pa.array([part.tobytes() for part in np.split(x.astype("<i8"), starts[1:])], pa.binary()) for x in (keys, sums))], ["bucket", "keys", "sums"]
    )


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k, n in zip(batch.column("keys"), batch.column("sums")):
        yield np.frombuffer(k.as_buffer(), "<i8"), np.frombuffer(n.as_buffer(), "<i8")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct keys of each bucket in order and their sums; rows come sorted by bucket. Holds
    a bucket's distinct keys and about as many that are not yet added."""
    bucket, pending, least = None, 0, 500_000
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    for batch in slices(batches):
        for at, (k, n) in zip(batch.column("bucket").to_pylist(), _numbers(batch)):
            if at != bucket and keys:
                keys, sums = _merge(keys, sums)
                yield keys[0], sums[0]
                keys, sums, pending, least = [], [], 0, 500_000
            bucket, pending = at, pending + len(k)
            keys.append(k.copy())
            sums.append(n.copy())
            if pending > least:
                keys, sums = _merge(keys, sums)
                pending = len(keys[0])
                least = max(500_000, 2 * pending)
    if keys:
        keys, sums = _merge(keys, sums)
        yield keys[0], sums[0]


PACK = "bucket int, keys binary, sums binary"


def _distinct_bigrams(rows: DataFrame, words, buckets: int) -> DataFrame:
    """Partial counts of neighbouring items over the texts of ``rows``, dealt by bigram, so that
    frequent items spread; a text begins after an end. Tasks add up before the shuffle, holding at
    most a million bigrams and a batch. A bigram's counts lie in one bucket of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_of = _dictionary(words)
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        spread = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
        for batch in slices(batches):
            seq = np.concatenate([[0], _sequence(batch, item_of)[0].astype(np.int64)])
            k, n = np.unique(seq[:-1] << 32 | seq[1:], return_counts=True)
            keys.append(k)
            sums.append(n)
            if sum(map(len, keys)) > 1_000_000:
                keys, sums = _merge(keys, sums)
                if len(keys[0]) > 500_000:
                    yield _dealt(keys[0], sums[0], spread(keys[0]))
                    keys, sums = [], []
        if keys:
            keys, sums = _merge(keys, sums)
            yield _dealt(keys[0], sums[0], spread(keys[0]))

    return rows.select("text").mapInArrow(freed(run), PACK).repartition("bucket").sortWithinPartitions("bucket")


def item_bigrams(rows: DataFrame, words) -> DataFrame:
    """(a, b, n) of neighbouring items over the texts of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _gathered(batches):
            for at in range(0, len(k), PACKED):
                part = k[at : at + PACKED]
                yield pa.RecordBatch.from_arrays([pa.array((part >> 32).astype(np.int32)), pa.array((part & 0xFFFFFFFF).astype(np.int32)), pa.array(n[at : at + PACKED])], ["a", "b", "n"])

    return _distinct_bigrams(rows, words, _buckets(rows)).mapInArrow(freed(run), "a int, b int, n long")


def _by_item(parts: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct bigrams and their counts, dealt by item: once with the item that follows, once
    with the one before. Item 0 stays in its class and needs the first only."""
    for k, n in parts:
        a, b = k >> 32, k & 0xFFFFFFFF
        back = b > 0
        both = np.concatenate([k, b[back] << 32 | SIDE | a[back]])
        yield _dealt(both, np.concatenate([n, n[back]]), (both >> 32) % buckets)


def _packed(dealt: DataFrame) -> DataFrame:
    """Rows of numbers as bytes: ``keys``, each an item, a side (0: the neighbour follows, 1: it
    precedes) and the neighbour, and ``sums``. All of an item's keys are in one row, at most two
    for each item, so a round of exchange moves nothing between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _gathered(batches):
            # A new row at the first item that begins after another PACKED keys.
            heads = np.flatnonzero(np.diff(k >> 32, prepend=-1))
            rows = np.repeat(heads // PACKED, np.diff(np.append(heads, len(k))))
            yield from slices([_dealt(k, n, rows).select(["keys", "sums"])])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(freed(run), "keys binary, sums binary")


def packed_bigrams(rows: DataFrame, words, tokens: int) -> DataFrame:
    """:func:`item_bigrams` of so many ``tokens`` packed by item, without a row a bigram in between."""
    buckets = _buckets(rows, tokens)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_item(_gathered(batches), buckets)

    return _packed(_distinct_bigrams(rows, words, buckets).mapInArrow(freed(sides), PACK))


def packed(bigrams: DataFrame) -> DataFrame:
    """(a, b, n) packed by item; a packed table as it is."""
    if "keys" in bigrams.columns:
        return bigrams
    buckets = _buckets(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([c.to_numpy().astype(np.int64) for c in batch.columns] for batch in batches if batch.num_rows)
        yield from _by_item(((a << 32 | b, n) for a, b, n in columns), buckets)

    return written(_packed(bigrams.select("a", "b", "n").mapInArrow(run, PACK)), GROUP)


def class_bigrams(bigrams: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes; CLASSES squared rows at most reach the driver."""
    held = bigrams.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, m = held.value.astype(np.int64), np.zeros(CLASSES * CLASSES)
        for batch in batches:
            for k, n in _numbers(batch):
                first = k & SIDE == 0
                k = k[first]
                m += np.bincount(cls[k >> 32] * CLASSES + cls[k & (SIDE - 1)], n[first], len(m))
        some = np.flatnonzero(m)
        yield _keyed(some, m[some].astype(np.int64))

    got = bigrams.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(CLASSES * CLASSES)
    m[got["key"].to_numpy()] = got["n"].to_numpy()
    return m.reshape(CLASSES, CLASSES)


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams, without what does not depend on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def _merge(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return [k], [np.bincount(inv, np.concatenate(sums), len(k)).astype(np.int64)]


def _keyed(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _joined(m: np.ndarray, mine: np.ndarray, ctx: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What the cells of ``m`` (own class by neighbour's class) gain when a word joins each
    class, for words taken out of their classes ``mine``: words by classes. Only classes among
    its neighbours ``ctx`` matter; ``other`` are its neighbours on the other side."""
    out = np.zeros(ctx.shape)
    i, c = np.nonzero(ctx)
    if not len(i):
        return out
    n, own, k = ctx[i, c], mine[i], np.arange(len(i))
    cells, base = m.T[c], _xlogx(m).T[c]
    # The word itself is still counted in its class, on both sides.
    cells[k, own] -= n
    same = np.flatnonzero(c == own)
    cells[same] -= other[i[same]]
    np.maximum(cells, 0, out=cells)
    base[k, own] = _xlogx(cells[k, own])
    base[same] = _xlogx(cells[same])
    heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    out[i[heads]] = np.add.reduceat(_xlogx(cells + n[:, None]) - base, heads, axis=0)
    return out


def best_classes(m: np.ndarray, mine: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For words of classes ``mine`` with counts of following and preceding classes, the
    class to which moving the word raises the likelihood most."""
    k = np.arange(len(mine))
    gain = _joined(m, mine, after, before) + _joined(m.T, mine, before, after)
    for total, lost, n in ((m.sum(1), before, after.sum(1)), (m.sum(0), after, before.sum(1))):
        size = total - lost
        size[k, mine] -= n
        size = np.maximum(size, 0)
        gain -= _xlogx(size + n[:, None]) - _xlogx(size)
    gain[:, 0] = -np.inf
    # A word stays unless another class is clearly better.
    gain[k, mine] += 1e-9 * np.abs(gain[k, mine])
    return gain.argmax(1)


def exchange(bigrams: DataFrame, m: np.ndarray, classes: np.ndarray, turn: int, parts: int) -> np.ndarray:
    """New classes of the items of one part; each task has all neighbours of its items, and only
    (item, class) of those that move come back."""
    held = bigrams.sparkSession.sparkContext.broadcast((m, classes))
    width = 2 * CLASSES
    part = turn % parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cls = held.value[0], held.value[1].astype(np.int64)
        for batch in batches:
            for k, n in _numbers(batch):
                item = k >> 32
                some = (item > 0) & (item % parts == part)
                k, n, item = k[some], n[some], item[some]
                starts = np.flatnonzero(np.diff(item, prepend=-1))
                ends = np.append(starts, len(k))
                for a in range(0, len(starts), 128):
                    b = min(a + 128, len(starts))
                    pick = slice(ends[a], ends[b])
                    row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                    side = np.where(k[pick] & SIDE, CLASSES, 0)
                    ctx = np.bincount(row * width + side + cls[k[pick] & (SIDE - 1)], n[pick], (b - a) * width).reshape(b - a, width)
                    items = item[starts[a:b]]
                    new = best_classes(m, cls[items], ctx[:, :CLASSES], ctx[:, CLASSES:])
                    moved = np.flatnonzero(new != cls[items])
                    yield pa.RecordBatch.from_arrays([pa.array(items[moved], pa.int64()), pa.array(new[moved], pa.int32())], ["item", "cls"])

    got = bigrams.mapInArrow(freed(run), "item long, cls int").toArrow()
    out = classes.copy()
    out[got["item"].to_numpy()] = got["cls"].to_numpy()
    return out


def cluster(bigrams: DataFrame, classes: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes after exchange, their bigrams, and the likelihood at the start and after each
    round that was kept; it never falls. ``bigrams`` are (a, b, n) or packed by item."""
    bigrams = packed(bigrams)
    m = class_bigrams(bigrams, classes)
    seen, n = [likelihood(m)], m.sum()
    parts, turn, idle = 2, 0, 0
    for _ in range(rounds):
        new = exchange(bigrams, m, classes, turn, parts)
        if (new == classes).all():
            turn, idle = turn + 1, idle + 1
            if idle >= parts:
                break
            continue
        made = class_bigrams(bigrams, new)
        now = likelihood(made)
        if now <= seen[-1]:
            # Too many items moved at once.
            parts, idle = parts * 2, 0
            continue
        classes, m, turn, idle = new, made, turn + 1, 0
        seen.append(now)
        if len(seen) > parts and seen[-1] - seen[-1 - parts] < gain * n:
            break
    return classes, m, seen


@dataclass
class Model:
    words: object  # broadcast list of frequent words
    counts: DataFrame  # all (word, n)
    n: int
    v: int
    item_counts: np.ndarray
    item_words: np.ndarray
    classes: np.ndarray
    bigrams: np.ndarray


def fit(rows: DataFrame) -> Model:
    """Learns from the column ``text`` of ``rows``; nulls count as empty texts."""
    sc = rows.sparkSession.sparkContext
    counts = written(count_words(rows))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = total[0] or 0, total[1]
    least = max(1.0, SHARE * n)
    frequent = counts.where((F.col("n") >= least) & (F.length("word") > 0))
    got = frequent.toArrow()  # at most 1 / SHARE rows, as their counts add up to n at most
    order = sorted(zip((-got["n"].to_numpy()).tolist(), got["word"].to_pylist()))
    words = sc.broadcast((uuid.uuid4().hex, [w for _, w in order]))
    item_counts = np.zeros(TAIL + 1 + len(order))
    item_words = np.ones(TAIL + 1 + len(order))
    item_counts[TAIL + 1 :] = [-c for c, _ in order]
    item_words[: TAIL + 1] = 0
    ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0]
    item_counts[0], item_words[0] = ends or 0, 1
    tail = counts.where((F.col("n") < least) & (F.length("word") > 0))
    tail = tail.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % TAIL + 1).alias("item")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    at = tail["item"].to_numpy()
    item_counts[at], item_words[at] = tail["n"].to_numpy(), tail["v"].to_numpy()
    rank = np.empty(len(item_counts), np.int64)
    rank[np.argsort(-item_counts[1:], kind="stable") + 1] = np.arange(len(item_counts) - 1)
    classes = (1 + rank % (CLASSES - 1)).astype(np.int16)
    classes[0] = 0
    bigrams = written(packed_bigrams(rows, words, n), GROUP)
    classes, m, _ = cluster(bigrams, classes)
    return Model(words, counts, n, v, item_counts, item_words, classes, m)


def tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """log10 of class transitions; of each item's word probability within its class, without
    the numerator for rare items; numerators' log10 of frequent items; the base denominator."""
    b = model.bigrams
    follow = b.sum(0)
    uni = (follow + 1) / (follow.sum() + CLASSES)
    trans = np.log10((b + KAPPA * uni[None]) / (b.sum(1, keepdims=True) + KAPPA))
    size = np.bincount(model.classes, model.item_counts, CLASSES)
    kinds = np.bincount(model.classes, model.item_words, CLASSES)
    under = np.log10(size + DELTA * (kinds + 1))[model.classes]
    own = np.log10(model.item_counts + 0.5)
    own[1 : TAIL + 1] = 0.0
    return trans, -under, own, math.log10(model.n + 0.5 * (model.v + 1))


def _split(lengths: bytes, raw: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _word_rows(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Words dealt by a hash: (their order by bucket, where each bucket's begin and the number of
    words, lengths and letters of each bucket's words)."""
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(words))
    parts = [[words[i] for i in order[a:b].tolist()] for a, b in zip(ends, ends[1:])]
    return order, ends, [np.fromiter(map(len, part), "<u4", len(part)).tobytes() for part in parts], [b"".join(part) for part in parts]


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of ``rows`` (doc_id, text).

    A block of texts deals its rare words and their postings into buckets, which hold the
    counts of their words; the sums for the block's texts come back packed as well.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((model.classes, *tables(model)))
    words = model.words
    # At least one for each partition, as these texts may be more than those learned from.
    buckets = max(_buckets(rows, model.n), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own_fields = "block long, place int, n_tokens long, n_known long, base double, score double"
    fields = [f.split() for f in f"{own_fields}, bucket int, lengths binary, words binary, sizes binary, posts binary".split(", ")]
    schema = rows.select("doc_id", *[F.lit(None).cast(kind).alias(f) for f, kind in fields]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, trans, within, own, base_under = held.value
        item_of = _dictionary(words)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, BLOCK):
            for a in range(0, batch.num_rows, 60_000):
                part = batch.slice(a, 60_000)
                items, sizes, rare, at, which = _sequence(part, item_of)
                n = part.num_rows
                starts = np.cumsum(sizes) - sizes
                cls = classes[items]
                before = np.concatenate([[0], cls[:-1]])
                token = trans[before, cls] + within[items] + own[items]
                known = np.ones(len(items), np.int64)
                known[at] = 0
                if not own[0] > math.log10(0.5):
                    known[items == 0] = 0  # no training text, so no end was seen
                yield _batch(
                    schema, n, doc_id=part.column(0), block=np.full(n, block), place=np.arange(n), n_tokens=sizes, n_known=np.add.reduceat(known, starts),
                    base=np.add.reduceat(own[items], starts) - sizes * base_under, score=np.add.reduceat(token, starts),
                )
                if rare:
                    order, ends, lengths, letters = _word_rows(rare, buckets)
                    rank = np.empty(len(rare), np.int64)
                    rank[order] = np.arange(len(rare))
                    # (rare word, text) pairs with counts, packed as text << 16 | count.
                    text = np.repeat(np.arange(n), sizes)[at]
                    pair, count = np.unique(rank[which] * n + text, return_counts=True)
                    while (big := count > 65535).any():
                        pair, count = np.concatenate([pair, pair[big]]), np.concatenate([np.minimum(count, 65535), count[big] - 65535])
                        o = np.argsort(pair, kind="stable")
                        pair, count = pair[o], count[o]
                    posts = ((pair % n).astype(np.uint32) << 16 | count.astype(np.uint32)).astype("<u4")
                    many = np.bincount(pair // n, minlength=len(rare)).astype("<u4")
                    cuts = np.searchsorted(pair // n, ends)
                    k = len(lengths)
                    yield _batch(
                        schema, k, block=np.full(k, block), bucket=[zlib.crc32(rare[i]) % buckets for i in order[ends[:-1]].tolist()], lengths=lengths, words=letters,
                        sizes=[many[x:y].tobytes() for x, y in zip(ends, ends[1:])], posts=[posts[x:y].tobytes() for x, y in zip(cuts, cuts[1:])],
                    )
                block += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                learned, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                order, ends, lengths, letters = _word_rows(learned, buckets)
                bucket = [zlib.crc32(learned[i]) % buckets for i in order[ends[:-1]].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array(lengths, pa.binary()), pa.array(letters, pa.binary()), pa.array([n[order[x:y]].astype("<i8").tobytes() for x, y in zip(ends, ends[1:])], pa.binary())],
                    ["bucket", "lengths", "words", "sizes"],
                )

    both = written(rows.select("doc_id", "text").mapInArrow(freed(run), schema), GROUP)
    posts = both.where("posts is not null").select("bucket", "block", "lengths", "words", "sizes", "posts")
    learned = model.counts.where(F.length("word") > 0).select("word", "n").mapInArrow(freed(deal), "bucket int, lengths binary, words binary, sizes binary")
    # A bucket's learned words, which have no block, come before those of the blocks.
    met = posts.unionByName(learned, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            cols = {f: batch.column(f).to_pylist() for f in batch.schema.names}
            for at, block, lengths, raw, sizes, post in zip(*(cols[f] for f in ("bucket", "block", "lengths", "words", "sizes", "posts"))):
                if at != bucket:
                    bucket, known = at, {}
                own = _split(lengths, raw)
                if block is None:
                    known.update(zip(own, np.frombuffer(sizes, "<i8").tolist()))
                    continue
                c = np.fromiter((known.get(w, 0) for w in own), np.float64, len(own)).repeat(np.frombuffer(sizes, "<u4"))
                packed = np.frombuffer(post, "<u4")
                count = (packed & 0xFFFF).astype(np.float64)
                place, inv = np.unique(packed >> 16, return_inverse=True)
                t, k = np.bincount(inv, count * np.log10(c + 0.5)), np.bincount(inv, count * (c > 0))
                for o, v in zip(out, (block, at, place.astype("<u2").tobytes(), t.astype("<f8").tobytes(), k.astype("<i8").tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "bucket", "places", "t", "k"])

    # Sums of a block first and in one order, so that they add up to the same digits each time.
    sums = met.mapInArrow(freed(look_up), "block long, bucket int, places binary, t binary, k binary")
    texts_ = both.where("posts is null").select("doc_id", *[f.split()[0] for f in own_fields.split(", ")])
    ordered = texts_.unionByName(sums, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last(), "place")
    final = rows.select("doc_id", *[F.lit(None).cast(kind).alias(f) for f, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, t, k = None, np.zeros(1 << 16), np.zeros(1 << 16, np.int64)
        for batch in slices(batches):
            where = batch.column("block").to_numpy()
            heads = np.flatnonzero(np.diff(where, prepend=-1))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(where)]):
                if where[a] != block:
                    block = where[a]
                    t[:], k[:] = 0, 0
                part = batch.slice(a, b - a)
                n = part.num_rows - part.column("bucket").null_count
                for places, more, known in zip(*(part.column(f).slice(0, n).to_pylist() for f in ("places", "t", "k"))):
                    at = np.frombuffer(places, "<u2")
                    t[at] += np.frombuffer(more, "<f8")
                    k[at] += np.frombuffer(known, "<i8")
                own = part.slice(n)
                at = own.column("place").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("n_tokens"), pa.array(own.column("n_known").to_numpy() + k[at]), pa.array(own.column("base").to_numpy() + t[at]), pa.array(own.column("score").to_numpy() + t[at])], final.names
                )

    out = ordered.mapInArrow(freed(add), final)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _batch(schema, n: int, **cols) -> pa.RecordBatch:
    """``n`` rows of ``schema``, nulls in columns that are not given."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols.get(f), pa.Array) else pa.nulls(n, k) if c is None else pa.array(c, k) for f, k in kinds.items()], list(kinds))


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32(doc_id) mod 5 is not 1. Nulls count as empty texts, which
    have one token, their end. Equal rows are counted and scored each; other columns are
    not read. Without training rows all words are unknown and only smoothing is left.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = fit(rows.where(crc_mod("doc_id", 5) != 1))
    out = score(rows, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
