"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in
at most three bits differ in at most one bit of one of the segments, so they share a
variant of that segment with one bit position wiped out. The 64 variants (segment,
position, remaining bits) of every distinct fingerprint are the keys of an equality join,
and what meets under a key is verified. Under a key only a spanning forest of the verified
links is kept, never all pairs; linking keeps every connection, since only links that
close a cycle are left out.

A key under which very many fingerprints meet is cut again: two that share all but one bit
of a segment differ in at most three bits of the other one, so of its four bytes one is equal
in both, and they meet under the key and that byte. A thinned count finds such keys; it
decides where pairs meet, never whether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augur.llm.common import HOT, components, cut, freed, join_hot, slices, sorted_groups, texts, words_of

BITS, DISTANCE, WORDS, SEED = 64, 3, 3, 42
CROWD = 8192  # fingerprints under a key from which it is cut again
THIN = 64  # one fingerprint in THIN is looked at to find such keys


def fingerprint(text: str | None, n_words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - n_words + 1
    if n <= 1:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]]).tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[n_words - 1 :] - 1).tolist())]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64).view(np.uint8)
        total += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts(batch)], pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(freed(run), schema)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits (numpy counts the bits of the absolute value of signed numbers)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of at most ``distance`` bits that span each connected part of ``fp``. Every
    fingerprint that is reached leaves the rest, so linked families take few passes."""
    out: list[tuple[int, int]] = []
    rest = fp
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = differing(rest, x) <= distance
            if near.any():
                found = rest[near]
                out.extend((int(x), int(y)) for y in found)
                reached.extend(found)
                rest = rest[~near]
    return out


def _crowded(fps: DataFrame, keys: Column, crowd: int) -> DataFrame | None:
    """Keys under which about ``crowd`` fingerprints or more meet, HOT at most; None if there
    are none."""
    thin = THIN if crowd >= 16 * THIN else 1
    seen = fps.where(F.pmod(F.xxhash64("fp"), F.lit(thin)) == 0)
    n = seen.count()
    if n * thin < crowd:
        return None
    found = seen.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    found = cut(found.where(F.col("n") > max(crowd / thin, n * BITS / HOT)).select("key"))
    return None if found.isEmpty() else found


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` of at most ``distance`` <= 3
    bits. A fingerprint that repeats or is null links to nothing more."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    keys = []
    for half in range(2):
        seg = F.col("fp") if half == 0 else F.shiftrightunsigned("fp", 32)
        for bit in range(32):
            kept = seg.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)).cast("long"))
            keys.append(kept.bitwiseOR(F.lit((half * 32 + bit) << 32).cast("long")))
    variants = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = _crowded(fps, F.array(*keys), crowd)
    place = ["key"]
    if crowded is not None:
        place = ["key", "sub"]
        # The upper half of a key tells its segment: below 32 it is the lower one.
        other = F.when(F.col("key") >= 32 << 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
        bytes_ = [F.shiftright(other, 8 * i).bitwiseAND(255) + 256 * (i + 1) for i in range(4)]
        few = variants.join(F.broadcast(crowded), "key", "left_anti").withColumn("sub", F.lit(0).cast("long"))
        many = variants.join(F.broadcast(crowded), "key", "left_semi").withColumn("sub", F.explode(F.array(*bytes_)))
        variants = few.unionByName(many)
    ordered = variants.repartition(*place).sortWithinPartitions(*place, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, cols in sorted_groups(batches, place):
            fp = cols["fp"]
            sizes = np.diff(np.append(starts, len(fp))) if starts[-1] != len(fp) else np.diff(starts)
            starts = starts[: len(sizes)]
            two = starts[sizes == 2]
            near = two[differing(fp[two], fp[two + 1]) <= distance]
            a, b = fp[near].tolist(), fp[near + 1].tolist()
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for x, y in forest(fp[s : s + n], distance):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(freed(run), "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    A component joins rows whose fingerprints are linked by chains of at most three
    differing bits; its id is the smallest doc_id in it (null ids count only where there is
    no other). Null and empty texts have fingerprint 0, and link like any other. Equal rows
    and copies collapse to one fingerprint before any linking, and fingerprints that very many
    rows share join back where the rows are. Other columns are not read.
    """
    rows = cut(fingerprints(docs, text, doc_id))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    heads = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(nodes.join(heads, "root").select("fp", "component_id", "n"))
    return join_hot(rows, of, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
