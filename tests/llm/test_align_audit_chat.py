"""Tokenizer alignment, filter audit and chat formatting against brute force, and on odd inputs."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from augur.llm import alignment, chat_format, filter_audit
from augur.llm.chat_format import escape, unescape

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "\n", "the the the", " \n x\t y\x0b", "É\U0001f600 <|endoftext|> </s> x", "a ▁ b", "word " * 6000, "x" * 3000, "same text here today",
    "same text here today", "don't  we'll go \x1c y 　z", "12345 67890", "ＡＢ ǅ ŀ", "中文 字 符 と", "\x00 \x85   q",
]


def brute_force(texts):
    """What op11 returns, by the libraries over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    sign = alignment.byte_of_sign()
    coded = []
    for t in texts:
        x, y, groups = [], [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xb = [bytes(sign[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
            if b"".join(xb) == b"".join(yb) == (" " + t).encode():
                ends = [np.cumsum([len(z) for z in zs]).tolist() for zs in (xb, yb)]
                i = j = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
                    groups.append((x[i:p], y[j:q]))
                    i, j = p, q
            else:
                x, y = [], []
        coded.append((len(x), len(y), groups))
    count = Counter((p[-1], q[-1]) for _, _, g in coded for p, q in g)
    best = Counter()
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    out = []
    for n_a, n_b, g in coded:
        links = [(p[-1], q[-1]) for p, q in g]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((n_a, n_b, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out, count


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n):
    rng = random.Random(5)
    alphabet = ["a", "the", "The", "'s", " ", " ", "  ", "\n", "\t", "1", "42", ".", "é", "ß", "中", " ", " ", "\U0001f600", "▁", "<s>", "<|endoftext|>", "_", "-", "\x1c", "é"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_alignment(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate([*ODD, *random_texts(1500)])] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "n", "n_a", "keys", "b", "times")})
    want, count = brute_force([t for _, t in rows])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_corpus(docs, A, B).collect()}
    assert len(got) == len(rows) and got == {i: w for (i, _), w in zip(rows, want)}
    assert any(w[0] == 0 for (_, t), w in zip(rows, want) if t)  # a text whose bytes don't come back
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(docs, A, B).collect()}
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_alignment_of_empty_and_linkless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_corpus(none, A, B).count() == 0
    empty = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align_corpus(empty, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.pair_counts(empty, A, B).count() == 0


def test_partial_counts_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 50)
    rng, partial, got, want = random.Random(1), alignment.Partial(), Counter(), Counter()
    for _ in range(40):
        keys = sorted({rng.randrange(200) for _ in range(20)})
        want.update({k: k + 1 for k in keys})
        parts = [*partial.add(np.array(keys), np.array(keys) + 1)]
        for k, n in parts:
            got.update(dict(zip(k.tolist(), n.tolist())))
        assert partial.n <= 70
    for k, n in partial.end():
        got.update(dict(zip(k.tolist(), n.tolist())))
    assert got == want


def test_counts_of_several_shards(tmp_path):
    keys = np.arange(0, 3000, 3, dtype=np.int64)
    shards = []
    for at in range(0, 1000, 300):
        k = keys[at : at + 300]
        shards.append((int(k[0]), int(k[-1]), len(k), alignment.store(str(tmp_path), k, k + 1, k % 2 == 0)))
    ask = keys[::7]
    counts, best = alignment.looked_up(ask, f"file://{tmp_path}", shards)
    assert counts.tolist() == (ask + 1).tolist() and best.tolist() == (ask % 2 == 0).tolist()
    assert isinstance(alignment.opened(str(tmp_path), shards[0][3], 300)[0], np.memmap)
    with pytest.raises(RuntimeError):
        alignment.looked_up(np.array([1]), str(tmp_path), shards)
    assert len(alignment.looked_up(np.zeros(0, np.int64), str(tmp_path), shards)[0]) == 0


def audit(docs, labels):
    """The audit by plain loops over documents (doc_id, text, part)."""
    import re

    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    flags = []
    for i, t, part in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        bad["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        flags.append((part or "", {x for x, b in bad.items() if b}, i in good, i in toxic))
    out = Counter()
    for part in {p for p, *_ in flags}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flags if f[0] == part]
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                rest = [f for f in left if x not in f[1]]
                out[part, order, k + 1] = [len(rest), len(gone), 0, 0, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                mine = [f for f in flags if f[0] == part]
                out[part, order, k + 1][2] = sum(x in f[1] and any(y in f[1] for y in order[:k]) for f in mine)
                out[part, order, k + 1][3] = sum(f[1] == {x} for f in mine)
                left = rest
    share = Counter()
    for (part, order, k), v in out.items():
        share[part, order[k - 1]] += v[1]
    return {(p, o, k, *v, share[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "short", long, long + " #", "THE SHOUTED " * 130, "a b " * 150, long.upper(), long + " x\x0by", "É" * 30, "x\ty\n" * 120]
    docs = [(i if i != 7 else 6, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(60)] + [(None, long, "s"), (None, long, "u"), (-3, long, "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("part", "step", "digest", "good", "fails", "letters", "own", "n")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("text", "good", "fails")})
    got = [tuple(r) for r in filter_audit.audit_filters(d, lab).collect()]
    assert len(got) == len(set(got)) == 4 * 600 and set(got) == audit(docs, labels)
    assert filter_audit.audit_filters(d.limit(0), lab).count() == 0
    assert {tuple(r)[7:9] for r in filter_audit.audit_filters(d, lab.limit(0)).collect()} == {(0, 0)}


def test_audit_of_many_copies(spark, monkeypatch):
    """A text that most rows share meets its smallest id where its rows are."""
    from augur.llm import common

    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "copy").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = filter_audit.flagged(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.where(F.col("fails").bitwiseAND(16) != 0).count() == 20_999 and got.count() == 30_000


text = st.text(alphabet=st.sampled_from("<>/s[]INSTMGDOCAU\\-é\n x"), max_size=40) | st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "-", "<", "[", "a", "\\-"]), max_size=8).map("".join)


@given(text)
def test_escape_is_reversible(t):
    e = escape(t)
    assert unescape(e) == t and not any(c in e for c in chat_format.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<s>"]), text), max_size=5))
def test_turns_come_back(turns):
    sheet = chat_format.Flattener()
    for k, (role, t) in enumerate(turns):
        sheet.message(k, role, [{"type": "text", "text": t}])
    n, formatted, loss, _, _ = sheet.taken()
    assert list(chat_format.turns_of(formatted)) == turns and n == len(turns)
    assert [unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant" and t]


def test_parts_are_flattened_in_order(spark):
    part = lambda **k: tuple(k.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [
        (1, 0, "user", [part(type="text", text="see [IMG] "), part(type="image", ref="i1", width=30, height=14), part(type="text", text=" and"), part(type="document", ref="d", pages=3)]),
        (1, 1, "assistant", [part(type="text", text="one"), part(type="audio", ref="s", seconds=1.5), part(type="text", text=" two</s>"), part(type="image")]),
        (1, 2, "user", None), (2, 0, None, []), (None, None, "assistant", [part(text="x")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}").withColumns({c: F.lit(0) for c in ("chunk", "formatted", "text", "place")})
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    r = got[1]
    assert r.formatted == "<s>[INST]user[/INST]see [\\-IMG] [IMG] and[DOC]</s>[INST]assistant[/INST]one[AUDIO] two<\\-/s>[IMG]</s>[INST]user[/INST]</s>"
    assert [(a.place, a.turn, a.type, a.ref, a.tokens, r.formatted[a.at :].startswith(chat_format.PLACEHOLDER[a.type])) for a in r.attachments] == [(0, 0, "image", "i1", 3, True), (1, 0, "document", "d", 1680, True), (2, 1, "audio", "s", 38, True), (3, 1, "image", None, 1, True)]
    assert r.expanded_tokens == 3 + 1680 + 38 + 1 and r.n_turns == 3
    assert [unescape(r.formatted[x.begin : x.end]) for x in r.loss] == ["one", " two</s>"]
    assert got[2].formatted == "<s>[INST][/INST]</s>" and got[None].formatted == "<s>[INST]assistant[/INST]x</s>"
    with pytest.raises(Exception, match="unknown type"):
        chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", [part(type="video")])], df.select("conv_id", "turn", "role", "parts").schema)).collect()
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_chunks_of_long_conversations(spark, size):
    """Digests do not depend on the size of chunks; ties, repeated rows and nulls are turns."""
    rng = random.Random(size)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(300)]), rng.choice(["user", "assistant", "system"]), rng.choice(["</s>", "[INST] ok [/INST]", "long " * 90, "", None, "é\n"])) for _ in range(900)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    chunks = chat_format.format_conversations(df, size=size)
    assert max(len(r.formatted) for r in chunks.collect()) < size + 600
    got = {r.conv_id: r for r in chat_format.digests(chunks).collect()}
    for c in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert g.formatted_chars == 3 + sum(17 + len(r[2]) + len(escape(r[3] or "")) for r in mine)


