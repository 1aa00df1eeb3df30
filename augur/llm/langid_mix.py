"""Language identification by mixtures of character n-gram models.

Each learned language has a table of hashed character trigrams over words. A document's
words are drawn from a mixture of languages; expectation-maximisation estimates the
proportions from the words' trigram likelihoods. Starting from the best single language,
languages are added while the penalised likelihood (BIC) of the mixture grows. The
prediction is the language with the largest proportion.

The tables have a fixed number of cells per language; the counts behind them cover every
training row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.llm.common import crc_mod, freed, slices, texts

CELLS = 1 << 16
MAX_LANGUAGES = 512  # sizes the model: CELLS * 4 bytes for each
ROUNDS = 12
_PAD = 0x20


def _codes(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents, each followed by a blank; lengths. Letters are lower
    case, everything else is a blank."""
    s = "\n".join(docs) + "\n"
    low = s.lower() if s.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in s) if len(s.lower()) != len(s) else s.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[code]
    if (kind == 2).any():
        # Marks belong to a word only with a letter in it.
        at = np.flatnonzero(kind)
        head = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        bare = ~np.logical_or.reduceat(kind[at] == 1, head)
        kind[at[np.repeat(bare, np.diff(np.append(head, len(at))))]] = 0
    code = np.where(kind > 0, code, np.where(code == 10, 10, _PAD)).astype(np.uint32)
    return code, np.array([len(d) + 1 for d in docs], np.int64)


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, which may stand in a word, else 0."""
    if not _table:
        import unicodedata

        _table.append(np.array([" LM".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.int8).clip(0))
    return _table[0]


def trigrams(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each trigram, word of each trigram, document of each word, words' first trigrams)."""
    code, lengths = _codes([d.replace("\n", " ") for d in docs])
    letter = code > _PAD
    prev = np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    before = np.concatenate([[_PAD], code[:-1]])
    after = np.concatenate([code[1:], [_PAD]])
    a = np.where(before[at] > _PAD, before[at], 1).astype(np.uint64)
    c = np.where(after[at] > _PAD, after[at], 1).astype(np.uint64)
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (code[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    cell = (h >> np.uint64(48)).astype(np.int64) % CELLS
    new = letter & ~prev
    word = (np.cumsum(new) - 1)[at]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    doc = np.repeat(np.arange(len(docs)), lengths)[np.flatnonzero(new)]
    return cell, word, doc, first


class Mixture:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: languages by cells. Cells are smoothed by half a count."""
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * CELLS)).T.astype(np.float32).copy()  # cells by languages
        #: What a trigram outside all languages has: an even spread over the cells.
        self.even = -math.log(CELLS)

    def infer(self, docs: list[str]) -> tuple[list[str | None], list[float], list[float], list[dict[str, float]]]:
        """For each document the language, its proportion, the mean gain per trigram over
        the even spread, and the proportions of the chosen set. None: no letter."""
        n, k = len(docs), len(self.langs)
        cell, word, doc, first = trigrams(docs)
        langs: list[str | None] = [None] * n
        share, gain, sets = [0.0] * n, [0.0] * n, [{} for _ in range(n)]
        if not len(cell) or not k:
            return langs, share, gain, sets
        ll = np.add.reduceat(self.log[cell], first, axis=0).astype(np.float64)  # words by languages
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        who = doc[heads]
        n_words = np.diff(np.append(heads, len(doc)))
        row = np.repeat(np.arange(len(who)), n_words)
        n_grams = np.add.reduceat(np.diff(np.append(first, len(cell))), heads)
        peak = ll.max(1, keepdims=True)
        rel = np.exp(ll - peak)
        base = np.add.reduceat(peak[:, 0], heads)
        single = np.add.reduceat(ll, heads, axis=0)
        chosen = np.zeros((len(who), k), bool)
        chosen[np.arange(len(who)), single.argmax(1)] = True
        best, pi = single.max(1), chosen.astype(float)
        live = np.ones(len(who), bool) & (k > 1)
        for _ in range(k - 1):
            # The language that explains the words which the present set explains worst.
            if not live.any():
                break
            mine = live[row]
            r, s = rel[mine], row[mine]
            mix = (r * pi[s]).sum(1)
            lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            over = np.log1p(r / np.maximum(mix, 1e-300)[:, None]) if len(r) else r
            add = np.add.reduceat(over, lead, axis=0)
            ids = s[lead]
            add[chosen[ids]] = -np.inf
            cand = chosen[ids].copy()
            cand[np.arange(len(ids)), add.argmax(1)] = True
            p = cand / cand.sum(1, keepdims=True)
            local = np.repeat(np.arange(len(ids)), n_words[ids])
            for _ in range(ROUNDS):
                w = r * p[local]
                w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
                p = np.add.reduceat(w, lead, axis=0) / n_words[ids][:, None]
            now = np.add.reduceat(np.log(np.maximum((r * p[local]).sum(1), 1e-300)), lead) + base[ids]
            # Penalty of one more proportion: half the logarithm of the number of words.
            better = now - best[ids] > 0.5 * np.log(n_words[ids]) + 1.0
            took = ids[better]
            chosen[took], pi[took], best[took] = cand[better], p[better], now[better]
            live[:] = False
            live[took] = chosen[took].sum(1) < k
        top = pi.argmax(1)
        mean = best / n_grams - self.even
        for j, d in enumerate(who.tolist()):
            langs[d] = self.langs[top[j]]
            share[d] = min(1.0, float(pi[j, top[j]]))
            gain[d] = float(mean[j])
            sets[d] = {self.langs[i]: float(pi[j, i]) for i in np.flatnonzero(chosen[j])}
        return langs, share, gain, sets


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Mixture:
    """Counts trigrams of every row with a language. A task adds up its own rows first, and
    tasks' sums are added by (language, cell), so the shuffle holds at most languages times
    cells rows a task, and the result languages times cells."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1 << 19):
            names = texts(batch, "lang")
            docs = texts(batch)
            for name in set(names):
                cell = trigrams([d for d, x in zip(docs, names) if x == name])[0]
                sums[name] = sums.get(name, 0) + np.bincount(cell, minlength=CELLS)
            if len(sums) > 64:
                yield from emit(sums)
        yield from emit(sums)

    def emit(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while sums:
            name, c = sums.popitem()
            at = np.flatnonzero(c)
            # Languages with rows but no letters still are learned values.
            at = at if len(at) else np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "cell", "n"])

    sums = rows.mapInArrow(freed(run), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # One packed row a language: cells and counts, not rows, reach the driver.
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("c")).select("lang", "c.cell", "c.n")
    found = sorted(packed.limit(MAX_LANGUAGES + 1).toArrow().to_pylist(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(found), CELLS))
    for i, r in enumerate(found):
        counts[i, r["cell"]] = r["n"]
    return Mixture([r["lang"] for r in found], counts)


def identify(docs: DataFrame, model: Mixture, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score (its proportion), gain, languages (map of proportions).

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Each row is judged by itself; ids are carried as they are; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("gain"), F.create_map(F.lit(""), F.lit(0.0)).alias("languages")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, 1 << 19):
            langs, share, gain, sets = model.infer([t or "" for t in texts(batch)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x or "und" for x in langs], pa.string()), pa.array(share, pa.float64()), pa.array(gain, pa.float64()),
                 pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))],
                schema.names,
            )

    return rows.mapInArrow(freed(run), schema)


def keep_known(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a letter and whose trigrams the learned languages explain
    better than an even spread; where no language was learned, those that have a letter."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, 1 << 19):
            got = [t or "" for t in texts(batch, text)]
            if model.langs:
                langs, _, gain, _ = model.infer(got)
                keep = [x is not None and g > 0 for x, g in zip(langs, gain)]
            else:
                keep = [any(map(str.isalpha, t)) for t in got]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)


def predict_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, gain, languages of every row; learns from rows whose
    crc32(doc_id) mod 3 is not 1.

    Null texts and texts without a letter are ``und`` with score 0; rows without text or lang teach
    nothing; repeated ids and rows are judged again; a null id counts as the empty text in
    the crc. Of languages of equal share the first by name is predicted. Without a learned
    language every row is ``und``. Further columns are not read; an empty table gives no rows."""
    model = fit(docs.where(crc_mod(doc_id, 3) != 1), text, lang)
    return identify(docs, model, text, doc_id).withColumn("held_out", crc_mod("doc_id", 3) == 1)
