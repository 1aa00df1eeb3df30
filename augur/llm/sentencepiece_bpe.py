"""SentencePiece BPE, encoded with a prefix table and decoded.

For every prefix of a segment there is exactly one piece that can end its encoding: the
match of the piece automaton ending there whose left neighbour, the last piece of the
remaining prefix, is compatible with it (no merge would have run across the border).
The table of those last pieces is filled from left to right, and the ids are recovered
backwards. The time is linear in the segment whatever it holds.

A text is first cut where no piece of the vocabulary holds the two characters on either
side, that is before the white-space sign after another character; merges cannot cross
such a place. Workers keep a bounded table of segments that they have met.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.llm.common import freed, slices, texts

SPACE = "▁"
TABLE = 150_000  # segments of a generation; a worker keeps two
PAIRS = 400_000  # compatible pairs that a worker keeps
LONG = 256  # longer segments are not kept
_held: dict[bytes, PrefixBpe] = {}


class PrefixBpe:
    def __init__(self, blob: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(blob)
        norm, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        self.prefix = norm.add_dummy_prefix
        pieces = list(enumerate(model.pieces))
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for _, p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte = {int(p.piece[1:-1], 16): i for i, p in pieces if p.type == kind.BYTE}
        self.unk = next(i for i, p in pieces if p.type == kind.UNKNOWN)
        self.ids = {p.piece: i for i, p in pieces if p.type == kind.NORMAL}
        score = {p.piece: p.score for _, p in pieces if p.type == kind.NORMAL}
        # Runs of the white-space sign tie in score; they merge leftmost first, after all else.
        self.runs = {len(p) for p in score if len(p) > 1 and not p.strip(SPACE)}
        order = sorted((p for p in score if len(p) > 1 and p.strip(SPACE)), key=lambda p: -score[p])
        if len({score[p] for p in order}) != len(order) or any(SPACE in p.lstrip(SPACE) or p.startswith(2 * SPACE) for p in order) or any(score[SPACE * n] >= score[order[-1]] for n in self.runs):
            raise ValueError("pieces must have scores of their own and white space only in front")
        self.rank = {p: r for r, p in enumerate(order)}
        # How each piece comes about, found by merging it alone; pieces that no merges reach are unused.
        self.parts: dict[str, tuple[str, str]] = {}
        automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1:
                automaton.add_word(p, p)
        for p in order:
            last = self._merge(p)
            if last is not None:
                if any(self.rank.get(x, -1) >= self.rank[p] for x in last):
                    raise ValueError(f"piece {p!r} comes before its parts")
                self.parts[p] = last
                automaton.add_word(p, p)
        automaton.make_automaton()
        self.automaton = automaton
        self.fits: dict[tuple[str, str], bool] = {}
        self.borders: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.segments: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self._runs: dict[int, list[int]] = {}
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unk_text = model.trainer_spec.unk_surface or " ⁇ "

    def _merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge joins when ``piece`` is merged alone."""
        syms, last = list(piece), None
        while len(syms) > 1:
            best = min(((self.rank[x], i) for i in range(len(syms) - 1) if (x := syms[i] + syms[i + 1]) in self.rank), default=None)
            if best is None:
                return None
            i = best[1]
            last = (syms[i], syms[i + 1])
            syms[i : i + 2] = ["".join(last)]
        return last

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b alone leaves exactly a and b. Follows, in the order of the
        merges, the symbols that touch the border from both sides; a merge of the two that
        would come before either's own next merge crosses the border."""
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, left, right, ok = self.rank, self._border(a, 1), self._border(b, 0), True
        i = j = 0
        while True:
            x, next_left = left[i]
            y, next_right = right[j]
            across = rank.get(x + y)
            # Of merges of the same piece the leftmost comes first.
            if across is not None and across < next_left and across <= next_right:
                ok = False
                break
            if next_left <= next_right:
                i += 1
                if i == len(left):
                    break
            else:
                j += 1
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def _border(self, piece: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one side of ``piece`` while it comes about, first the
        character, each with the rank of the merge that ends it."""
        known = self.borders.get((piece, side))
        if known is None:
            known, nxt, p = [], len(self.rank), piece
            while True:
                known.append((p, nxt))
                if p not in self.parts:
                    break
                nxt = self.rank[p]
                p = self.parts[p][side]
            known.reverse()
            self.borders[piece, side] = known
        return known

    def run_ids(self, n: int) -> list[int]:
        """Ids of n white-space signs in a row: merges of equal score, leftmost first."""
        known = self._runs.get(n)
        if known is not None:
            return known
        size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [i for i in range(n - 1) if 2 in self.runs]
        heapq.heapify(heap)
        while heap:
            i = heapq.heappop(heap)
            if not size[i] or nxt[i] >= n or size[i] + size[nxt[i]] not in self.runs:
                continue
            j = nxt[i]
            size[i] += size[j]
            size[j] = 0
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if size[i] + size[nxt[i]] in self.runs:
                    heapq.heappush(heap, i)
            if prev[i] >= 0 and size[prev[i]] + size[i] in self.runs:
                heapq.heappush(heap, prev[i])
        out = [self.ids[SPACE * s] for s in size if s]
        if n <= LONG:
            self._runs[n] = out
        return out

    def encode_segment(self, seg: str) -> list[int]:
        """Ids of one segment by the prefix table."""
        n = len(seg)
        last: list[str | None] = [None] * (n + 1)  # last[i] ends the encoding of seg[:i]; None: a character without a piece
        done, fits = 0, self.fits
        for end, p in self.automaton.iter(seg):
            end += 1
            if end <= done:
                continue
            before = last[end - len(p)]
            if before is not None:
                ok = fits.get((before, p))
                if not (self.compatible(before, p) if ok is None else ok):
                    continue
            last[end] = p
            done = end
        out: list[int] = []
        i = n
        while i:
            p = last[i]
            if p is None:
                i -= 1
                code = seg[i].encode("utf-8", "surrogatepass")
                out.extend((self.byte[b] for b in reversed(code)) if self.byte else [self.unk])
                continue
            run = 0
            while p == SPACE:
                run, i = run + 1, i - 1
                p = last[i] if i else None
            if run:
                out.extend(reversed(self.run_ids(run)))
            else:
                out.append(self.ids[p])
                i -= len(p)
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of pieces; runs of byte pieces are read as UTF-8, each bad byte as U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            if i == self.unk:
                out.append(self.unk_text)
            elif i >= 0:
                out.append(self.text_of.get(i, ""))
        return "".join(out)

    def known(self, seg: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the text they decode to."""
        got = self.segments.get(seg)
        if got is not None:
            return got
        got = self.older.get(seg)
        if got is None:
            ids = self.encode_segment(seg)
            got = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        if len(seg) <= LONG:
            # Segments that are still in use move to the young generation.
            if len(self.segments) >= TABLE:
                self.older, self.segments = self.segments, {}
            self.segments[seg] = got
        return got

    def cut(self, text: str) -> list[str]:
        """Segments of the normalised text: white-space signs and what follows them."""
        s = text.replace(" ", SPACE)
        if self.prefix:
            s = SPACE + s
        out: list[str] = []
        pad = ""
        head, *rest = s.split(SPACE)
        if head:
            out.append(head)
        for w in rest:
            pad += SPACE
            if w:
                out.append(pad + w)
                pad = ""
        if pad:
            out.append(pad)
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        if not text:
            return 0, "", ""
        known = self.known
        got = [known(s) for s in self.cut(text)]
        plain = "".join([g[2] for g in got])
        if self.prefix and plain.startswith(" "):
            plain = plain[1:]
        return sum([g[0] for g in got]), ",".join([g[1] for g in got]), plain


def utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _model(blob: bytes) -> PrefixBpe:
    if blob not in _held:
        _held.clear()
        _held[blob] = PrefixBpe(blob)
    return _held[blob]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with ``keep_ids``
    also ids (array of int) and decoded (string).

    Nulls and empty texts have no ids and decode to the empty text; repeated rows are encoded
    again; ids of documents are carried as they are; further columns are not read.
    """
    with open(model_file, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = [F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    if keep_ids:
        some += [F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")]
    schema = rows.select("doc_id", *some).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob.value)
        for batch in slices(batches):
            ns, ids, plains = [], [], []
            for t in texts(batch):
                n, x, plain = model.digest(t or "")
                ns.append(n)
                ids.append(x)
                plains.append(plain)
            sha = [[hashlib.sha256(x.encode()).hexdigest() for x in c] for c in (ids, plains)]
            cols = [batch.column(0), pa.array(ns, pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())]
            if keep_ids:
                cols += [pa.array([list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32())), pa.array(plains, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(freed(run), schema)
