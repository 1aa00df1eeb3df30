"""Text expressions: urls, normalised tokens, probabilities in completions, prompts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of probabilities in completions and of runaway punctuation.
PROBABILITY = r"(?im)(?:^|assistantfinal|\b)\s*(?:final\s+)?probability\s*:\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)\s*%?)(?:\s|$)"
LOOSE_NUMBER = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+)\s*%?)"
PUNCTUATION_LOOP = r"([!?.;,:\-_=*#])\1{15,}"


def strip(c: Column) -> Column:
    """All white space off both ends; Spark's own trim takes blanks only."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(strip(c)) > 0, c)


def canonical_url(url: Column) -> Column:
    u = F.lower(strip(url))
    u = F.regexp_replace(u, r"\?.*$", "")
    u = F.regexp_replace(u, r"/+$", "")
    u = F.regexp_replace(u, r"^http://", "https://")
    return F.when(F.length(u) > 0, u)


def normalize_text(text: Column) -> Column:
    """Lower case; whatever is neither letter, number, underscore nor white space is a blank."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def token_set(normalized: Column, min_len: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) >= min_len))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def parse_probability(text: Column, allow_loose: bool = False) -> Column:
    """The stated probability, per cent divided by 100; null unless finite and within [0, 1]."""
    t = F.coalesce(text, F.lit(""))
    raw = F.regexp_extract(t, PROBABILITY, 1)
    if allow_loose:
        raw = F.when(t.rlike(PROBABILITY), raw).otherwise(F.regexp_extract(t, LOOSE_NUMBER, 1))
    raw = strip(raw)
    number = F.regexp_replace(raw, r"\s*%$", "").try_cast("double")
    value = F.when(raw.endswith("%"), number / F.lit(100.0)).otherwise(number)
    return F.when(value.between(0.0, 1.0), value)


def has_punctuation_loop(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(PUNCTUATION_LOOP)


def has_placeholder(text: Column) -> Column:
    """A template field in braces is left in the text."""
    return text.rlike(r"\{[a-z_]+\}")


def render_question_dates(text: Column, freeze_date: Column, resolved_at: Column) -> Column:
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.replace(F.replace(text, F.lit("{resolution_date}"), day(resolved_at)), F.lit("{forecast_due_date}"), day(freeze_date))


def render_chat_prompt(messages: Column) -> Column:
    """``ROLE:`` and content of each message, then an open assistant turn."""
    parts = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), F.coalesce(m["content"], F.lit(""))))
    return F.concat(F.array_join(F.array_append(parts, F.lit("ASSISTANT:\n")), "\n\n"))


def usable_messages(messages: Column) -> Column:
    """Messages of known roles, role trimmed; null where none is left."""
    kept = F.filter(
        F.transform(messages, lambda m: F.struct(strip(F.coalesce(m["role"], F.lit(""))).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))),
        lambda m: m["role"].isin("system", "user", "assistant"),
    )
    return F.when(F.size(kept) > 0, kept)


def request_key(request: Column) -> Column:
    """Content address of a request: sha-256 of its JSON with keys in order."""
    return F.sha2(F.to_json(request, {"ignoreNullFields": "false"}), 256)


def classify_response(text: Column) -> Column:
    """``context`` for objects that open with a base rate, ``paraphrase`` for lists, else ``?``."""
    s = strip(text)
    inner = F.split(s, "```", 3)[1]
    inner = strip(F.regexp_replace(inner, "^json", ""))
    s = F.when(s.startswith("```"), inner).otherwise(s)
    return F.when(s.startswith("["), "paraphrase").when(s.startswith("{") & F.substring(s, 1, 300).contains("base_rate"), "context").otherwise("?")


def fmt_eta(remaining: Column, per_minute: Column) -> Column:
    minutes = remaining / per_minute
    return (
        F.when(F.coalesce(per_minute <= 0, F.lit(True)), "—")
        .when(minutes < 60, F.format_string("%.1f min", minutes))
        .otherwise(F.format_string("%.2f h (%.0f min)", minutes / 60, minutes))
    )


def fmt_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return F.format_string("$%.2f", tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out)


def flatten_richtext_py(node: object) -> str:
    """Text of a rich-text tree, depth first over ``text``, ``content`` and ``children``."""
    stack, found = [node], []
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            stack.extend(x[k] for k in ("children", "content") if k in x)
            if isinstance(x.get("text"), str):
                stack.append(x["text"])
    return " ".join(t for t in found if t)


def flatten_richtext(tree_json: Column) -> Column:
    """Of a JSON string. The tree's depth is not bounded, so this is an Arrow-batched UDF."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else flatten_richtext_py(json.loads(x))
            except ValueError:
                return None

        return s.map(one)

    return run(tree_json)
