"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a few neighbouring tokens that ignores some positions. The
three masks below are chosen so that every overlap of twelve tokens or more with up to a
fifth of substitutions, wherever they are, shows at least one seed unharmed (tests
enumerate this for 12 to 20 tokens, and follow it up to 400). Seed hashes of the benchmark and of the
documents are joined by equality, and around every hit the diagonal is verified token by
token.

A Bloom filter of the benchmark's seeds (bounded, whatever the benchmark's size) keeps
seeds that surely meet nothing from leaving the scan; the join decides. What leaves is one
row for each region around hits, and regions of equal tokens and hits, such as a passage
that many documents share, are joined and verified once. A seed that repeats within a region
or an item is one row with its positions, and a region travels once to each item that it
shares a seed with, whatever the number of their common diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.llm.common import cut, freed, join_hot, slices, texts

MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 5, 7, 8), (0, 1, 2, 7, 8, 10))
SHORT = (0, 1, 2, 3, 4)  # for items of fewer than OVERLAP tokens, which must occur unchanged
OVERLAP = 12  # tokens of the shortest overlap
SHARE = 0.8  # of its tokens that must be equal
VERIFIED = 256  # pairs of a region and an item in an Arrow batch
MARGIN = 64  # tokens kept on either side of hits
GAP = 48  # hits further apart make separate regions
BLOOM_BITS = (20, 27)  # smallest and largest size as powers of two
_WORD = regex.compile(r"\w+")
_M = np.random.default_rng(8).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_cache: dict[str, int] = {}
_SEEDS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.list_(pa.int32()))]))
SEEDS = "array<struct<h: long, at: array<int>>>"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of tokens; a bounded table keeps those met before."""
    if len(_cache) > 200_000:
        _cache.clear()
    get = _cache.get
    out = list(map(get, words))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = _cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(out, np.uint64)


def seeds(h: np.ndarray, mask: tuple[int, ...], kind: int) -> np.ndarray:
    """Seed hash at each start position of token hashes ``h``."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(kind + 1))
    for j, o in enumerate(mask):
        out += h[o : o + n] * _M[j]
    out ^= out >> np.uint64(29)
    out *= _M[15]
    return out ^ (out >> np.uint64(32))


def by_seed(h: np.ndarray, at: np.ndarray) -> list[dict]:
    """Each seed hash with its positions."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else []
    return [{"h": x, "at": p.tolist()} for x, p in zip(h[new].tolist(), np.split(at, new[1:]))] if len(h) else []


def diagonals(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distinct differences of positions, in time of the product and space of the sum of both."""
    if len(q) > len(p):
        return -diagonals(q, p)[::-1]
    low = int(p.min()) - int(q.max())
    met = np.zeros(int(p.max()) - int(q.min()) - low + 1, bool)
    for x in q.tolist():
        met[p - x - low] = True
    return np.flatnonzero(met) + low


def _probe(s: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64((1 << power) - 1)
    return s & m, (s >> np.uint64(64 - power)) & m


def item_seeds(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item_id, a key of the tokens, tokens, seeds with their positions) of every item with
    five tokens or more."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys, toks, found = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), texts(batch)):
                h = hashes(tokens(t or ""))
                if len(h) < len(SHORT):
                    continue
                masks = list(enumerate(MASKS)) if len(h) >= OVERLAP else [(len(MASKS), SHORT)]
                got = [seeds(h, mask, kind).view(np.int64) for kind, mask in masks]
                ids.append(i)
                toks.append(h.tobytes())
                keys.append(xxhash.xxh3_128_hexdigest(toks[-1]))
                found.append(by_seed(np.concatenate(got), np.concatenate([np.arange(len(g)) for g in got])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(toks, pa.binary()), pa.array(found, _SEEDS)], ["item_id", "item_key", "item", "seeds"])

    return rows.mapInArrow(freed(run), f"item_id long, item_key string, item binary, seeds {SEEDS}")


def _bloom(seeds_df: DataFrame) -> tuple[np.ndarray, int, bool]:
    """Filter of all seed hashes as bits, its size as a power of two, and whether there are
    short items. The set positions are distinct and bounded by the filter's size."""
    n, short = seeds_df.agg(F.count("*"), F.max(F.col("short").cast("int"))).first()
    power = int(min(BLOOM_BITS[1], max(BLOOM_BITS[0], np.ceil(np.log2(max(n, 1) * 16)))))
    bits = np.zeros(1 << power, bool)
    if n:
        m = (1 << power) - 1
        places = seeds_df.select(F.explode(F.array(F.col("h").bitwiseAND(m), F.shiftrightunsigned("h", 64 - power).bitwiseAND(m))).alias("i"))
        words = places.groupBy(F.shiftright("i", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63 as int))) as b")).toArrow()
        packed = np.zeros((1 << power) // 64, np.int64)
        packed[words["w"].to_numpy()] = words["b"].to_numpy()
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
    return bits, power, bool(short)


def regions_of(h: np.ndarray, doc: np.ndarray, ends: np.ndarray, bloom: np.ndarray, power: int, short: bool) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(document, first token, last token, hit positions, seed hashes) of each region."""
    at, found = [], []
    for kind, mask in enumerate((*MASKS, SHORT) if short else MASKS):
        s = seeds(h, mask, kind)
        a, b = _probe(s, power)
        p = np.flatnonzero(bloom[a])
        p = p[bloom[b[p]]]
        p = p[doc[p] == doc[p + mask[-1]]]
        at.append(p)
        found.append(s[p])
    p, s = np.concatenate(at), np.concatenate(found)
    if not len(p):
        return
    order = np.argsort(p, kind="stable")
    p, s = p[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(p) > GAP) | (doc[p[1:]] != doc[p[:-1]])]))
    for x, y in zip(new.tolist(), [*new[1:].tolist(), len(p)]):
        d = int(doc[p[x]])
        start = int(ends[d - 1]) if d else 0
        yield d, max(start, int(p[x]) - MARGIN), min(int(ends[d]), int(p[y - 1]) + MARGIN), p[x:y], s[x:y]


def overlap(a: np.ndarray, b: np.ndarray, diag: int) -> tuple[int, int, int]:
    """Longest stretch of the diagonal a[i + diag] against b[i] that begins and ends with
    equal tokens, in which at least SHARE are equal: (start in b, length, equal tokens)."""
    lo, hi = max(0, -diag), min(len(b), len(a) - diag)
    if hi <= lo:
        return 0, 0, 0
    eq = a[lo + diag : hi + diag] == b[lo:hi]
    # Longest i..j with equal >= SHARE * length: prefix sums of +1 and, at 80 %, -4.
    score = np.concatenate([[0], np.cumsum(np.where(eq, 1, -round(SHARE / (1 - SHARE))))])
    low = np.minimum.accumulate(score)
    best = (0, 0, 0)
    for j in np.flatnonzero(eq).tolist():
        i = int(np.searchsorted(-low, -score[j + 1], side="left"))
        while i <= j and not eq[i]:
            i += 1
        if j + 1 - i > best[1]:
            best = (lo + i, j + 1 - i, int(eq[i : j + 1].sum()))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Overlaps of documents with benchmark items: doc_id, item_id, n_tokens and n_equal of
    the longest overlap of the two, and start, its first token in the document.

    Tokens are lower-case runs of letters, digits and underscores. An overlap has twelve
    tokens or more, of which at least 80 % are equal on one diagonal; an item of 5 to 11
    tokens must occur unchanged, and shorter items are not searched. Documents without an
    overlap have no row; null and empty texts have none; equal rows give one row; null
    ids of documents and items are kept; items of equal tokens are searched once. Ties go to the earliest start. Other columns are not read.
    """
    named = cut(item_seeds(benchmark, item_text, item_id))
    items = named.groupBy("item_key").agg(F.first("item").alias("item"), F.first("seeds").alias("seeds"))
    flat = items.select("item_key", F.explode("seeds").alias("s"), (F.length("item") < 8 * OVERLAP).alias("short")).select("item_key", "s.at", "s.h", "short")
    bloom, power, short = _bloom(flat)
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bloom))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id", F.lit(0).alias("start"), F.lit("").alias("region"), F.lit(b"").alias("tokens"), F.array(F.struct(F.lit(0).cast("long").alias("h"), F.array(F.lit(0)).alias("at"))).alias("hits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).view(bool)
        for batch in slices(batches):
            found = [tokens(t or "") for t in texts(batch)]
            sizes = np.array([len(f) for f in found], np.int64)
            ends = np.cumsum(sizes)
            h = hashes([w for f in found for w in f])
            del found
            doc = np.repeat(np.arange(len(sizes)), sizes)
            out: list[list] = [[], [], [], [], []]
            for d, a, b, p, s in regions_of(h, doc, ends, bits, power, short):
                raw = h[a:b].tobytes()
                out[0].append(d)
                out[1].append(a - (int(ends[d - 1]) if d else 0))
                # In a short document two groups of hits may widen to the same tokens.
                out[2].append(xxhash.xxh3_128_hexdigest(len(raw).to_bytes(8) + raw + (p - a).tobytes() + s.tobytes()))
                out[3].append(raw)
                out[4].append(by_seed(s.view(np.int64), p - a))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()), pa.array(out[4], _SEEDS)], schema.names
                )
        _cache.clear()

    regions = cut(rows.mapInArrow(freed(run), schema))
    distinct = regions.groupBy("region").agg(F.first("tokens").alias("tokens"), F.first("hits").alias("hits"))
    hits = distinct.select("region", F.explode("hits").alias("x")).select("region", "x.h", F.col("x.at").alias("p"))
    met = hits.join(flat.select("item_key", "h", F.col("at").alias("q")), "h").groupBy("region", "item_key").agg(F.collect_list(F.struct("p", "q")).alias("met"))
    pairs = met.join(distinct.select("region", "tokens"), "region").join(items.select("item_key", "item"), "item_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = dict(zip(batch.schema.names, batch.columns))
            out: list[list] = [[], [], [], [], []]
            for region, i, raw, other, met in zip(*(cols[c].to_pylist() for c in ("region", "item_key", "tokens", "item", "met"))):
                a, b = np.frombuffer(raw, np.int64), np.frombuffer(other, np.int64)
                best = None
                for diag in np.unique(np.concatenate([diagonals(np.array(m["p"]), np.array(m["q"])) for m in met])).tolist():
                    at, n, equal = overlap(a, b, diag)
                    if n >= OVERLAP or (len(b) < OVERLAP and equal == len(b)):
                        now = (n, equal, -(at + diag))
                        best = now if best is None or now > best else best
                if best:
                    for o, v in zip(out, (region, i, -best[2], best[0], best[1])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["region", "item_key", "from_region", "n_tokens", "n_equal"])

    checked = pairs.select("region", "item_key", "tokens", "item", "met").mapInArrow(freed(verify), "region string, item_key string, from_region int, n_tokens int, n_equal int")
    # Rows are of kilobytes here, so batches of the usual number of rows would be large.
    conf, rows_a_batch = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows_a_batch)
    conf.set(rows_a_batch, str(VERIFIED))
    try:
        good = cut(checked.join(named.select("item_key", "item_id").distinct(), "item_key"))
    finally:
        conf.set(rows_a_batch, before)
    # A passage that very many documents share is joined where they are.
    placed = regions.select("doc_id", "start", "region")
    shared = cut(placed.join(good.select("region").distinct(), "region", "left_semi").groupBy("region").agg(F.count("*").alias("n")))
    lists = cut(good.groupBy("region").agg(F.collect_list(F.struct("item_id", "from_region", "n_tokens", "n_equal")).alias("g")).join(shared, "region"))
    placed = join_hot(placed, lists, "region", "n").select("doc_id", "start", F.explode("g").alias("g")).select("doc_id", "start", "g.*")
    best = F.max(F.struct("n_tokens", "n_equal", (-(F.col("start") + F.col("from_region"))).alias("back"))).alias("b")
    return placed.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_tokens", "b.n_equal", (-F.col("b.back")).alias("start"))
