"""Token counts of byte-level BPE without token ids.

A document is cut into pre-tokens, and merges never cross pre-tokens. So the number of
pieces of a document is the sum, over its distinct pre-tokens, of frequency times pieces.

One pass cuts the texts. Blocks of documents share a vocabulary of their distinct pre-tokens;
a document keeps places in it and frequencies, packed into about a byte each. The vocabularies
are dealt by a hash of the pre-token into buckets, a row for each block and bucket. A bucket
builds its table of distinct pre-tokens, counts the pieces of each member once and joins it to
the blocks' rows as they pass, so it holds one bucket's table at a time; there are four buckets
a shuffle partition. The pieces go back to the blocks and there meet the documents'
frequencies. What is shuffled is vocabularies and packed numbers, a part of the text's size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.llm.common import cut, freed, nullable, slices, texts

#: Characters on which the regular expression library and the tokenizer surely agree: scripts
#: and signs that were complete long before either. Others take the library's own cutting.
AGREED = re.compile("[\x00-ͷΑ-ΡΣ-ҁҊ-ԧא-תء-ي -⁣₠-₸℀-ↈ←-⏳─-⚽ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f320]*")
BLOCK = 8 << 20  # bytes of text that share a vocabulary
ENCODED = 20_000  # pre-tokens given to the tokenizer at once
LONG = 64  # bytes from which a table holds a digest in place of the pre-token
_held: dict[bytes, Cutter] = {}


class Cutter:
    """The tokenizer's cutting of texts into pre-tokens, and the pieces of pre-tokens."""

    def __init__(self, blob: bytes):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(blob.decode())
        spec = json.loads(blob)
        pre = spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        #: Fixed value: the published pre-token pattern of byte-level BPE.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def cut(self, text: str) -> list[str]:
        if AGREED.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[int, Counter[str]]:
        """Special strings in the text, which are one piece each, and its other pre-tokens."""
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1, Counter(self.cut(text)) if len(parts) == 1 else Counter(w for p in parts for w in self.cut(p))

    def pieces(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for a in range(0, len(words), ENCODED):
            out += map(len, self.tok.encode_batch(words[a : a + ENCODED], add_special_tokens=False))
        return out


def _cutter(blob: bytes) -> Cutter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if blob not in _held:
        _held.clear()
        _held[blob] = Cutter(blob)
    return _held[blob]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up: a byte each, those from 255 on again in four bytes after them."""
    big = numbers[numbers >= 255]
    return np.minimum(numbers, 255).astype(np.uint8).tobytes() + big.astype("<u4").tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=n)
    return out


def token_counts(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text.

    Nulls and empty texts have no bytes and no tokens; repeated rows are counted again;
    ids are carried as they are, nulls included; further columns of ``docs`` are not read.
    The tokenizer's file is read once here and sent to the workers (its size is fixed).
    """
    with open(tokenizer_file, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    number = F.lit(0).cast("long")
    own = [number.alias("n_bytes"), number.alias("base"), F.lit(0).alias("n"), F.lit(b"").alias("places"), F.lit(b"").alias("counts")]
    schema = nullable(rows.select("doc_id", number.alias("block"), *own, F.lit(0).alias("bucket"), F.lit(b"").alias("words")).schema)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, block = _cutter(blob.value), TaskContext.get().partitionId() << 32
        for batch in slices(batches, BLOCK):
            place: dict[str, int] = {}
            out: list[list] = [[], [], [], [], []]
            for t in texts(batch):
                t = t or ""
                base, count = cutter.frequencies(t)
                at = np.fromiter((place.setdefault(w, len(place)) for w in count), np.int64, len(count))
                order = np.argsort(at)
                many = np.fromiter(count.values(), np.int64, len(count))[order]
                for o, v in zip(out, (len(t.encode()), base, len(at), pack(np.diff(at[order], prepend=0)), pack(many))):
                    o.append(v)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([block] * n, pa.int64()), *map(pa.array, out, kinds), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema.names)
            parts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
            for w, i in place.items():
                raw = w.encode()
                parts[zlib.crc32(raw) % buckets].append((i, raw))
            n, own = len(parts), [[], [], [], []]
            for members in parts.values():
                at, raw = zip(*members)
                # A vocabulary's row has the lengths of its pre-tokens in ``counts``.
                for o, v in zip(own, (len(at), pack(np.diff(at, prepend=0)), pack(np.fromiter(map(len, raw), np.int64, len(raw))), zlib.compress(b"".join(raw), 1))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, batch.column(0).type), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, own[:3], kinds[2:]), pa.array(list(parts), pa.int32()), pa.array(own[3], pa.binary())],
                schema.names,
            )
            block += 1

    both = cut(rows.mapInArrow(freed(run), schema))
    vocabulary = both.where("words is not null").select("bucket", "block", "n", "places", "counts", "words").repartition("bucket").sortWithinPartitions("bucket")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, bucket = _cutter(blob.value), None
        table: dict[bytes, int] = {}
        for batch in slices(batches):
            found = []
            for b, n, lengths, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5))):
                if b != bucket:
                    bucket, table = b, {}
                raw, ends = zlib.decompress(raw), np.cumsum(unpack(lengths, n)).tolist()
                words = [raw[a:e] for a, e in zip([0, *ends], ends)]
                keys = [w if len(w) < LONG else blake2b(w).digest() for w in words]
                new = [i for i, k in enumerate(keys) if k not in table]
                if new:
                    table.update(zip((keys[i] for i in new), cutter.pieces([words[i].decode() for i in new])))
                found.append(pack(np.fromiter((table[k] for k in keys), np.int64, n)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (1, 2, 3)), pa.array(found, pa.binary())], ["block", "n", "places", "counts"])

    # The rows of a block's pieces, which stand in ``counts``, go first, then its documents.
    known = vocabulary.mapInArrow(freed(count), "block long, n int, places binary, counts binary").withColumn("kind", F.lit(0))
    ours = both.where("words is null").select(*schema.names[:7], F.lit(1).alias("kind"))
    ordered = ours.unionByName(known, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    final = rows.select("doc_id", number.alias("n_bytes"), number.alias("n_tokens")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pieces = None, np.zeros(0, np.int64)
        for batch in slices(batches):
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            kind, where, many, base, places, counts = (cols[c].to_pylist() for c in ("kind", "block", "n", "base", "places", "counts"))
            mine, sums = [], []
            for j, n in enumerate(many):
                at, values = np.cumsum(unpack(places[j], n)), unpack(counts[j], n)
                if where[j] != block:
                    block, pieces = where[j], np.zeros(0, np.int64)
                if kind[j] == 0:
                    if at[-1] >= len(pieces):
                        pieces = np.concatenate([pieces, np.zeros(at[-1] + 1, np.int64)])
                    pieces[at] = values
                    continue
                if n and (at[-1] >= len(pieces) or not pieces[at].all()):
                    raise RuntimeError("a document without its vocabulary")
                mine.append(j)
                sums.append(base[j] + int(pieces[at] @ values))
            rest = pa.array(mine, pa.int64())
            yield pa.RecordBatch.from_arrays([cols["doc_id"].take(rest), cols["n_bytes"].take(rest), pa.array(sums, pa.int64())], final.names)

    return ordered.mapInArrow(freed(add), final).withColumn("over_limit", F.col("n_tokens") > limit)
