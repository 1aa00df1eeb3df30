"""Secret scans: patterns, and a battery of randomness tests, in DataFrame functions only.

Patterns (``assign``, ``access``, ``hex``) are taken as they are. Besides, every run of at
least twenty characters of encoded data is tested (``random``):

* its encoding is inferred, the smallest of a few alphabets that holds it;
* chi-squared uniformity over that alphabet, runs about its middle and lag-one serial
  correlation, combined by Fisher's method, must not reject that it is random;
* against text stands the likelihood ratio of even symbols of that alphabet to the best of
  a few models of text (prose, capitals, identifiers, numbers, dates). Under any of these
  the ratio exceeds x with probability 1 / x at most, so its inverse, times the number of
  alphabets, is a p-value, and a longer run can have a smaller one. Within classes of
  length, Benjamini and Hochberg's rule over the whole corpus sets the threshold, so that
  of the spans reported at most FDR are expected to be text.

Texts may hold any number of matches: positions are running sums taken in blocks, and work
grows with the matches to the power 1.5 at most.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds. Case matters outside the group of names.
#: Looking ahead and behind only saves attempts that must fail: a run starts at its start.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = "(?=[PpSsTtAa])(?i:(" + NAMES + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # the run is taken whole, so 16 characters and more
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"
FDR = 0.05
RANDOM_P = 0.001  # Fisher's p-value from which randomness isn't rejected
CLASSES = 14  # of length, by powers of two
BINS = 1200  # of -log10 p, a quarter each

#: Alphabets from small to large.
ALPHABETS = {
    "digits": string.digits,
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "lower36": string.digits + string.ascii_lowercase,
    "upper36": string.digits + string.ascii_uppercase,
    "alpha": string.ascii_uppercase + string.ascii_lowercase,
    "alnum": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
    "any": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_",
}
#: Shares of letters a to z in European text, in per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
#: Models of text: shares of small letters, capitals, digits and signs. Letters are
#: spread as LETTERS, digits and signs evenly; a share of 0 still has RARE.
MODELS = {"prose": (0.92, 0.04, 0.02, 0.02), "capitals": (0.04, 0.92, 0.02, 0.02), "names": (0.6, 0.2, 0.15, 0.05), "numbers": (0.0, 0.0, 1.0, 0.0), "dates": (0.0, 0.0, 0.8, 0.2)}
RARE = 1e-6


def text_models() -> list[list[float]]:
    """Of each model of text log10 of the share of every character of ALPHABETS["any"]."""
    total = sum(LETTERS)
    parts = ((string.ascii_lowercase, LETTERS), (string.ascii_uppercase, LETTERS), (string.digits, (total / 10,) * 10), ("+/-_", (total / 4,) * 4))
    out = []
    for shares in MODELS.values():
        p = {c: max(share, RARE) * x / total for share, (chars, spread) in zip(shares, parts) for c, x in zip(chars, spread)}
        out.append([math.log10(p[c]) for c in ALPHABETS["any"]])
    return out


def running(xs: str, step: str) -> str:
    """SQL for the running values of ``step`` (of s, the value before, and x) over the array
    of ints ``xs``, from 0 on. Arrays grow by concatenation, so that is done in blocks of
    about the root of their number."""
    none, block = "cast(array() as array<int>)", "greatest(16, cast(sqrt(size(v)) as int))"
    now = re.sub(r"\bs\b", "c.s", step)
    return f"""element_at(transform(array({xs}), v -> aggregate(sequence(0, (size(v) - 1) div {block}), struct(0 as s, {none} as got),
        (a, j) -> aggregate(slice(v, j * {block} + 1, {block}), struct(a.s as s, {none} as got), (c, x) -> struct({now} as s, concat(c.got, array({now})) as got), c -> struct(c.s as s, concat(a.got, c.got) as got)),
        a -> a.got)), 1)"""


def found(text: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """SQL for the spans (start, end, s) of the pattern's leftmost non-overlapping matches
    that satisfy ``keep`` on x.g, the group: matches and the pieces between them alternate,
    so their lengths in code points add up to positions."""
    q = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    g = f"regexp_extract_all({text}, {q}, {group})"
    m = g if group == 0 else f"regexp_extract_all({text}, {q}, 0)"
    parts = f"filter(zip_with(zip_with(split({text}, {q}, -1), {m}, (b, m) -> struct(length(b) as b, m as m)), {g}, (y, g) -> struct(y.b as b, y.m as m, g as g)), x -> x.m is not null)"
    ends = running("transform(p, x -> x.b + length(x.m))", "s + x")
    return f"""if({text} rlike {q}, element_at(transform(array({parts}), p -> transform(
        filter(zip_with(p, {ends}, (x, e) -> struct(e - length(x.m) as start, e as end, x.m as s, {keep} as ok)), x -> x.ok),
        x -> struct(x.start as start, x.end as end, x.s as s))), 1), cast(array() as array<struct<start: int, end: int, s: string>>))"""


def _outer(x: Column, t: Column) -> Column:
    """log10 of the normal distribution's tail beyond sqrt(2) x, with t = 1 / (1 + x / 2), by
    a Chebyshev fit to seven digits."""
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return F.log10(t * 0.5) + (poly - x * x) / math.log(10)


def encoding(s: Column) -> Column:
    out = F.lit("any")
    for name, letters in reversed(ALPHABETS.items()):
        if name != "any":
            out = F.when(F.translate(s, letters, "") == "", name).otherwise(out)
    return out


def _by(enc: Column, values: dict[str, object]) -> Column:
    """A constant by encoding."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), enc)


def battery(s: Column) -> Column:
    """struct(len_class, log_p_text, p_random) of a string, as one expression that also
    serves inside a lambda: steps are fields of a one-element array, each computed once.
    Padding (``=``) is no symbol; fewer than eight symbols prove nothing."""
    arr, fields = F.array(F.struct(F.regexp_replace(s, "=", "").alias("b"))), ["b"]

    def add(**new) -> None:
        nonlocal arr
        arr = F.transform(arr, lambda r: F.struct(*[r[f].alias(f) for f in fields], *[f(r).alias(k) for k, f in new.items()]))
        fields.extend(new)

    zero, one = F.lit(0.0), F.lit(1.0)

    def log_share(at: Column, model: list[float]) -> Column:
        shares = F.array(*map(F.lit, model))
        return F.aggregate(at, zero, lambda t, x: t + F.element_at(shares, x))

    high = lambda r, x: x > (r["k"] + 1) / 2
    add(n=lambda r: F.length(r["b"]).cast("double"), enc=lambda r: encoding(r["b"]), ch=lambda r: F.filter(F.split(r["b"], ""), lambda c: c != ""))
    add(al=lambda r: _by(r["enc"], ALPHABETS), k=lambda r: _by(r["enc"], {k: float(len(v)) for k, v in ALPHABETS.items()}), at=lambda r: F.transform(r["ch"], lambda c: F.call_function("locate", c, F.lit(ALPHABETS["any"]))))
    add(
        like=lambda r: F.greatest(*[log_share(r["at"], m) for m in text_models()]),
        i=lambda r: F.transform(r["ch"], lambda c: F.call_function("locate", c, r["al"]).cast("double")),
        sq=lambda r: F.aggregate(F.array_distinct(r["ch"]), zero, lambda t, c: t + F.pow(r["n"] - F.length(F.call_function("replace", r["b"], c, F.lit(""))), F.lit(2.0))),
    )
    add(
        m=lambda r: F.coalesce(F.try_divide(F.aggregate(r["i"], zero, lambda t, x: t + x), r["n"]), zero),
        hi=lambda r: F.aggregate(r["i"], zero, lambda t, x: t + F.when(high(r, x), one).otherwise(zero)),
        pairs=lambda r: F.zip_with(F.slice(r["i"], F.lit(1), F.greatest(F.lit(0), F.size(r["i"]) - 1)), F.slice(r["i"], F.lit(2), F.greatest(F.lit(0), F.size(r["i"]) - 1)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        chi=lambda r: F.coalesce(F.try_divide(r["k"] * r["sq"], r["n"]), zero) - r["n"],
    )
    add(
        runs=lambda r: F.aggregate(r["pairs"], one, lambda t, p: t + F.when(high(r, p["x"]) != high(r, p["y"]), one).otherwise(zero)),
        serial=lambda r: F.try_divide(F.aggregate(r["pairs"], zero, lambda t, p: t + (p["x"] - r["m"]) * (p["y"] - r["m"])), F.aggregate(r["i"], zero, lambda t, x: t + F.pow(x - r["m"], F.lit(2.0)))),
    )

    def z_chi(r: Column) -> Column:
        return (r["chi"] - (r["k"] - 1)) / F.sqrt(2 * (r["k"] - 1) * (r["n"] - 1) / r["n"])

    def z_runs(r: Column) -> Column:
        both = 2 * r["hi"] * (r["n"] - r["hi"])
        return F.try_divide(r["runs"] - (both / r["n"] + 1), F.sqrt(F.greatest(zero, both * (both - r["n"]) / (r["n"] * r["n"] * (r["n"] - 1)))))

    # Nothing is divided by n or n - 1 where there are fewer than eight symbols.
    arr = F.filter(arr, lambda r: r["n"] >= 8)
    add(z1=lambda r: -z_chi(r), z2=lambda r: -F.abs(F.coalesce(z_runs(r), F.lit(40.0))), z3=lambda r: -F.abs(F.coalesce(r["serial"] * F.sqrt(r["n"] - 1), F.lit(40.0))))
    add(**{f"x{i}": (lambda r, i=i: F.abs(r[f"z{i}"]) / math.sqrt(2)) for i in range(1, 4)})
    add(**{f"t{i}": (lambda r, i=i: 1 / (1 + 0.5 * r[f"x{i}"])) for i in range(1, 4)})
    add(**{f"o{i}": (lambda r, i=i: _outer(r[f"x{i}"], r[f"t{i}"])) for i in range(1, 4)})
    ten = lambda x: F.pow(F.lit(10.0), x)
    lower = lambda z, o: F.when(z <= 0, o).otherwise(F.log10(F.greatest(1 - ten(o), F.lit(1e-300))))
    nat = lambda x: -F.greatest(x, F.lit(-300.0)) * math.log(10)
    add(
        t=lambda r: nat(lower(r["z1"], r["o1"])) + nat(F.least(zero, r["o2"] + math.log10(2))) + nat(F.least(zero, r["o3"] + math.log10(2))),
        text=lambda r: F.least(zero, r["like"] + r["n"] * F.log10(r["k"]) + math.log10(len(ALPHABETS))),
    )
    return F.element_at(
        F.concat(
            F.transform(arr, lambda r: F.struct(F.least(F.lit(CLASSES), F.floor(F.log2(r["n"]))).cast("int").alias("len_class"), r["text"].alias("log_p_text"), (F.exp(-r["t"]) * (1 + r["t"] + r["t"] * r["t"] / 2)).alias("p_random"))),
            F.array(F.struct(F.lit(0).alias("len_class"), zero.alias("log_p_text"), zero.alias("p_random"))),
        ),
        1,
    )


def random_like(s: Column, limits: dict[int, float]) -> Column:
    def verdict(r: Column) -> Column:
        limit = F.lit(1.0)
        for c, v in limits.items():
            limit = F.when(r["len_class"] == c, v).otherwise(limit)
        return (limit <= 0) & (r["log_p_text"] <= limit) & (r["p_random"] >= RANDOM_P)

    return F.element_at(F.transform(F.array(battery(s)), verdict), 1)


def thresholds(docs: DataFrame, text: str = "text", fdr: float = FDR) -> dict[int, float]:
    """log10 p at or under which a run counts, by class of length, over all runs that are
    not of kind ``hex`` already, so that those do not vouch for others. Only counts by class and
    bin, at most CLASSES times BINS, reach the driver."""
    runs = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("text").rlike(RUN))
    runs = runs.select(F.explode(F.expr(f"regexp_extract_all(text, '{RUN}', 0)")).alias("s")).where(~F.col("s").rlike("^[0-9a-f]{32,}$")).select(battery(F.col("s")).alias("r"))
    counts = runs.groupBy("r.len_class", F.least(F.lit(BINS), F.floor(-F.col("r.log_p_text") * 4)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    out: dict[int, float] = {}
    for c in {r["len_class"] for r in counts}:
        mine = sorted(((r["bin"], r["n"]) for r in counts if r["len_class"] == c), reverse=True)
        m, above = sum(n for _, n in mine), 0
        for b, n in mine:
            above += n
            if m * 10.0 ** (-b / 4) <= fdr * above:
                out[c] = -b / 4
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def scan(docs: DataFrame, text: str = "text", limits: dict[int, float] | None = None, out: str = "secrets") -> DataFrame:
    """``docs`` with a column ``out``: array of (start, ord, kind, end), sorted; positions in
    code points, end exclusive, ``ord`` the place of the kind in KINDS.

    A null text counts as empty and has no secrets. ``random`` spans are left out where
    they touch a span of a base kind. The rule for them looks at all of ``docs`` unless
    ``limits`` of an earlier call are given. A column that is called ``out`` is replaced.
    """
    limits = thresholds(docs, text) if limits is None else limits
    t, base, cand = (fresh(x, [*docs.columns, out]) for x in ("_t", "_base", "_cand"))
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    part = [(found(t, ASSIGN, "length(x.g) >= 8", 2), 0), (found(t, ACCESS), 1), (found(t, HEX), 2)]
    spans = ", ".join(f"transform({sql}, x -> struct(x.start as start, {i} as ord, '{KINDS[i]}' as kind, x.end as end))" for sql, i in part)
    df = df.withColumn(base, F.expr(f"array_sort(concat({spans}))"))
    if not limits:
        return df.withColumn(out, F.col(base)).drop(t, base)
    df = df.withColumn(cand, F.expr(f"filter({found(t, RUN)}, c -> not exists({base}, b -> b.start < c.end and c.start < b.end))"))
    # Within a row there is no explode and join; the battery runs inside a transform.
    tests = F.filter(cand, lambda c: random_like(c["s"], limits))
    extra = F.transform(tests, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("ord"), F.lit("random").alias("kind"), c["end"].alias("end")))
    return df.withColumn(out, F.when(F.size(cand) > 0, F.array_sort(F.concat(base, extra))).otherwise(F.col(base))).drop(t, base, cand)


def redact(scanned: DataFrame, text: str = "text", mark: str = MARK, spans: str = "secrets") -> DataFrame:
    """Replaces every span in the text, overlapping ones together; a text without spans stays
    as it is, null included. The text is cut in blocks of about the root of the number of
    spans first, since each piece is found by walking from the start of what it is cut from."""
    most = running(f"transform({spans}, x -> x.end)", "greatest(s, x)")
    block = "greatest(16, cast(sqrt(size(k)) as int))"
    first, last = "element_at(q, 1).head", "element_at(q, -1).start"
    sql = f"""element_at(transform(array({most}), m -> concat(array_join(flatten(
        element_at(transform(array(filter(transform({spans}, (x, i) -> struct(x.start as start, if(i = 0, 0, element_at(m, greatest(i, 1))) as head)), x -> x.start >= x.head)), k ->
          transform(sequence(0, (size(k) - 1) div {block}), j -> element_at(transform(array(slice(k, j * {block} + 1, {block})), q ->
            element_at(transform(array(substring({text}, {first} + 1, {last} - {first})), c -> transform(q, x -> concat(substring(c, x.head - {first} + 1, x.start - x.head), '{mark}'))), 1)), 1))), 1)), ''),
        substring({text}, element_at(m, -1) + 1))), 1)"""
    return scanned.withColumn(text, F.when(F.size(spans) > 0, F.expr(sql)).otherwise(F.col(text)))


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limits: dict[int, float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row.

    Spans are in order of their start, then of KINDS; base_sha256 covers those of the base
    kinds. Null and empty texts have no spans, and the digest of the empty text; repeated rows
    are scanned each; ids are carried as they are, nulls included; an empty table gives
    an empty result; columns other than the id and the text are not read, whatever their names.
    """
    df = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", limits).select("doc_id", "secrets")
    join = "concat_ws(',', transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)))"
    count = [F.expr(f"cast(size(filter(secrets, x -> x.ord = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *count, F.sha2(F.expr(join.format("filter(secrets, x -> x.ord < 3)")), 256).alias("base_sha256"), F.expr(join.format("secrets")).alias("spans"))
