"""Alignment of two tokenizers over a corpus, by packed pairs of ids.

Both tokenizers write the same bytes, the text behind a space. Where a token of each ends at
the same byte, their last tokens are linked. A link is one int64, the second tokenizer's id
above the first's. Tasks add up their links with np.unique; the partial counts are dealt by
ranges of the second id, sorted, and runs of equal keys are summed. So every range gives
sorted arrays of keys, counts and marks of each second id's best keys, which are stored as
shards in the shared folder. The last pass maps the shards into memory and finds the counts
of each document's links by binary search.

Neither tokenizer joins a space to what stands before it, so a text is cut before a space
behind a letter, digit or ASCII sign, and workers keep a bounded table of the segments met.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.llm.common import freed, nullable, slices, sorted_groups, texts
from augur.sources.shared import new_path, written

#: Where a text is cut: a sign of this class is white space in no library, and more than the space follows.
BORDER = re.compile(r"(?<=[\w!-~])(?= .)", re.S)
CLOSED = re.compile(r"[\w!-~]\Z")
TOGETHER = 1 << 15  # characters of segments that are encoded at once
TABLE = 100_000  # segments of a generation; a worker keeps two
LONG = 256  # longer segments are not kept
HELD = 1_000_000  # links that a task gathers, and pairs that it holds, before it gives them on
SHARD = 1 << 20  # pairs of a shard, 17 bytes each
GROUP = 8 << 20  # bytes of a row group of the table between the passes
_held: dict[bytes, Aligner] = {}
_maps: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

#: What a segment comes to: numbers of tokens of both, groups as text, links as packed keys; None where bytes differ.
Entry = tuple[int, int, str, bytes] | None


def byte_of_sign() -> dict[str, int]:
    """The bytes that stand behind the signs of byte-level vocabularies: printable Latin-1 signs
    stand for themselves, the other bytes, in order, for the signs from U+0100 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


class Aligner:
    def __init__(self, a_blob: bytes, b_blob: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a_blob)
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.a = Tokenizer.from_str(a_blob.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_blob)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if self.b.encode("", out_type=int) or self.b.encode("a", out_type=str)[0][0] != "▁" or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a model that adds a space in front, with white space only in front of pieces, is needed")
        sign = byte_of_sign()
        a_bytes = {i: bytes(sign[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in sign for c in t)}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(1 + max(a_bytes))]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.young: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}

    def _groups(self, a: list[int], b: list[int]) -> tuple[np.ndarray, ...]:
        """Ends of all tokens of both, and the bytes and places at which both end."""
        ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        both = np.intersect1d(*ends, assume_unique=True)
        return *ends, both, np.searchsorted(ends[0], both), np.searchsorted(ends[1], both)

    def learn(self, segs: list[str]) -> list[Entry]:
        """Entries of segments of which none or one may be open: one whose end is no border. They are
        encoded as one text, as tokens cross no border, and cut apart at their ends."""
        text = "".join(segs)
        raw = text.encode()
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return [None] if len(segs) == 1 else [e for s in segs for e in self.learn([s])]
        ends_a, ends_b, both, at_a, at_b = self._groups(a, b)
        stop = np.cumsum([len(s.encode()) for s in segs])
        n_a, n_b, n = (np.searchsorted(x, stop, "right") for x in (ends_a, ends_b, both))
        if not np.array_equal(both[n - 1], stop):
            raise RuntimeError("tokens across a border of segments")
        links = np.array(b, np.int64)[at_b] << 32 | np.array(a, np.int64)[at_a]
        names, groups, i, j = self.names, [], 0, 0
        for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            left = names[a[i]] if p - i == 1 else ",".join([names[x] for x in a[i:p]])
            groups.append(f"{left}|{names[b[j]] if q - j == 1 else ','.join([names[x] for x in b[j:q]])}")
            i, j = p, q
        out, i = [], 0
        for x, y, k in zip(np.diff(n_a, prepend=0).tolist(), np.diff(n_b, prepend=0).tolist(), n.tolist()):
            out.append((x, y, ";".join(groups[i:k]), links[i:k].tobytes()))
            i = k
        return out

    def align(self, batch: list[str]) -> list[list[tuple[int, int, str, bytes]]]:
        """Entries of the segments of each text in order, none if a text's bytes don't come back."""
        cut = [BORDER.split(" " + t) if t else [] for t in batch]
        young, older, new, size = self.young, self.older, [], 0
        for s in set(chain.from_iterable(cut)).difference(young):
            # Segments that are still in use move to the young generation.
            if s in older:
                young[s] = older[s]
                continue
            new.append(s)
            size += len(s)
            if not CLOSED.search(s) or size > TOGETHER:
                young.update(zip(new, self.learn(new)))
                new, size = [], 0
        if new:
            young.update(zip(new, self.learn(new)))
        out = [[young[s] for s in segs] for segs in cut]
        for s in [s for s in set(chain.from_iterable(cut)) if len(s) > LONG]:
            del young[s]
        if len(young) >= TABLE:
            self.older, self.young = young, {}
        return [[] if None in got else got for got in out]


def _aligner(a: bytes, b: bytes) -> Aligner:
    key = hashlib.sha256(a).digest() + hashlib.sha256(b).digest()
    if key not in _held:
        _held.clear()
        _held[key] = Aligner(a, b)
    return _held[key]


class Partial:
    """Counts of pairs, added up with np.unique in bounded memory."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.n = 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes keys in, and gives pairs out where too many are held."""
        self.raw.append(np.stack([keys, counts]))
        self.n += len(keys)
        if self.n > HELD:
            self._merge()
            if len(self.keys) > HELD:
                yield from self.end()

    def _merge(self) -> None:
        both = np.concatenate([np.stack([self.keys, self.counts]), *self.raw], axis=1)
        self.keys, at = np.unique(both[0], return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, at, both[1])
        self.raw, self.n = [], 0

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._merge()
        if len(self.keys):
            yield self.keys, self.counts
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def store(folder: str, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> str:
    """Writes a shard under a name of its own, so that a repeated task overwrites nothing."""
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    path = f"{path}/{uuid.uuid4().hex}"
    with system.open_output_stream(path) as f:
        for x, kind in ((keys, "<i8"), (counts, "<i8"), (best, "u1")):
            f.write(np.ascontiguousarray(x, kind).tobytes())
    return path.rsplit("/", 1)[-1]


def opened(folder: str, name: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and marks of a shard: mapped into memory where the shared folder is mounted,
    else read, one shard at a time."""
    got = _maps.get(name)
    if got is None:
        system, path = _place(f"{folder}/{name}")
        if system.type_name == "local":
            if len(_maps) > 4096:
                _maps.clear()
            raw = np.memmap(path, np.uint8, "r")
        else:
            with system.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        got = raw[: 8 * n].view("<i8"), raw[8 * n : 16 * n].view("<i8"), raw[16 * n :]
        if system.type_name == "local":
            _maps[name] = got
    return got


def looked_up(keys: np.ndarray, folder: str, shards: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and marks of sorted ``keys``, shard after shard in order of first keys."""
    counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for first, last, n, name in shards:
        a, b = np.searchsorted(keys, first), np.searchsorted(keys, last, "right")
        if a == b:
            continue
        own, many, marks = opened(folder, name, n)
        at = np.searchsorted(own, keys[a:b])
        if at[-1] >= n or not np.array_equal(own[at], keys[a:b]):
            raise RuntimeError("a pair without its count")
        counts[a:b], best[a:b] = many[at], marks[at] > 0
    if len(keys) and not counts.all():
        raise RuntimeError("a pair without its count")
    return counts, best


def links_of(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The first pass, written: rows of documents (doc_id, n_a, n_b, n_groups, groups_sha256, and
    the distinct keys with their frequencies as packed numbers), and, with ``key``, partial
    counts of the tasks (key, n)."""
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        blobs = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    number = F.lit(0).cast("long")
    own = [*(number.alias(c) for c in ("n_a", "n_b", "n_groups")), F.lit("").alias("groups_sha256"), F.lit(b"").alias("keys"), F.lit(b"").alias("times"), number.alias("key"), number.alias("n")]
    schema = nullable(rows.select("doc_id", *own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, partial, kind = _aligner(*blobs.value), Partial(), None

        def counted(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                k, m = keys[at : at + 100_000], n[at : at + 100_000]
                none = len(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(none, kind), *(pa.nulls(none, pa.int64()) for _ in range(3)), pa.nulls(none, pa.string()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary()), pa.array(k), pa.array(m)], schema.names
                )

        for batch in slices(batches):
            kind = batch.column(0).type
            out: list[list] = [[], [], [], [], [], []]
            for got in aligner.align(texts(batch)):
                n_a, n_b, groups, packed = zip(*got) if got else ((), (), (), ())
                links = np.frombuffer(b"".join(packed), np.int64)
                keys, times = np.unique(links, return_counts=True)
                yield from chain.from_iterable(counted(*x) for x in partial.add(keys, times))
                sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if got else ""
                for o, v in zip(out, (sum(n_a), sum(n_b), len(links), sha, keys.tobytes(), times.astype("<u4").tobytes())):
                    o.append(v)
            n = batch.num_rows
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema.names)
        yield from chain.from_iterable(counted(*x) for x in partial.end())

    return written(rows.mapInArrow(freed(run), schema), GROUP)


def count_shards(partial: DataFrame, folder: str) -> list[tuple[int, int, int, str]]:
    """Sums partial counts (key, n) and stores them in ``folder`` as sorted shards; gives the
    list of (first key, last key, pairs, name) in order, one a million pairs.

    A second id lies in one range; a task holds the pairs of a shard and of one id, which are
    at most as many as the first vocabulary has ids times the tasks before it."""
    ranged = partial.select(F.shiftright("key", 32).alias("b"), "key", "n").repartitionByRange("b").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            keys, counts, best = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (int(keys[0]), int(keys[-1]), len(keys), store(folder, keys, counts, best))], ["first", "last", "n", "name"])

        for starts, cols in sorted_groups(slices(batches), ["b"]):
            key, n = cols["key"], cols["n"]
            # Runs of equal keys are summed; the best of a second id are those with its largest sum.
            run_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            keys, counts = key[run_at], np.add.reduceat(n, run_at)
            b = keys >> 32
            b_at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            most = np.maximum.reduceat(counts, b_at)
            held.append((keys, counts, counts == np.repeat(most, np.diff(np.append(b_at, len(b))))))
            if sum(len(x[0]) for x in held) >= SHARD:
                yield flush()
        if held:
            yield flush()

    return sorted((r["first"], r["last"], r["n"], r["name"]) for r in ranged.mapInArrow(freed(run), "first long, last long, n long, name string").collect())


def align_corpus(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    ``a_file``: a byte-level tokenizer's JSON, ``b_file``: a sentencepiece model with a space in
    front. Texts that are null or empty, or hold the sign U+2581, which comes back as a space,
    have no tokens: zeros and an empty digest. Ties between a second id's pairs are all best;
    repeated rows count again, also in the corpus's counts; ids are carried as they are,
    nulls included; further columns of ``docs`` are not read; an empty table gives no rows.
    """
    both = links_of(docs, a_file, b_file, text, doc_id)
    folder = new_path(docs.sparkSession, "pairs")
    shards = docs.sparkSession.sparkContext.broadcast(count_shards(both.where("key is not null").select("key", "n"), folder))
    rows = both.where("key is null").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "keys", "times")
    number = F.lit(0).cast("long")
    schema = nullable(rows.select("doc_id", "n_a", "n_b", "n_groups", *(number.alias(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [np.frombuffer(x, "<i8") for x in batch.column(5).to_pylist()]
            times = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(6).to_pylist()]
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts, best = looked_up(known, folder, shards.value)
            out, end = [], 0
            for k, m in zip(keys, times):
                mine = at[end : end + len(k)]
                end += len(k)
                out.append((int(m.sum()), int(m @ best[mine]), int(m @ counts[mine])))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols, batch.column(4)], schema.names)

    return rows.mapInArrow(freed(run), schema)


def pair_counts(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(a, b, n, best): the corpus's links of ids, read back from the shards; odd rows as in
    :func:`align_corpus`."""
    spark = docs.sparkSession
    folder = new_path(spark, "pairs")
    shards = count_shards(links_of(docs, a_file, b_file, text, doc_id).where("key is not null").select("key", "n"), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keys, counts, best = opened(folder, name, n)
                for at in range(0, n, 100_000):
                    k = np.asarray(keys[at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(k & 0xFFFFFFFF), pa.array(k >> 32), pa.array(counts[at : at + 100_000]), pa.array(best[at : at + 100_000] > 0)], ["a", "b", "n", "best"])

    listed = spark.createDataFrame(shards, "first long, last long, n long, name string")
    return listed.mapInArrow(freed(run), "a long, b long, n long, best boolean")
