"""Column functions on values given in tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from augur.functions import dates, entities, scores
from augur.functions import text as X


def evaluate(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_probability(spark):
    texts = ["Probability: 0.37\nbecause", "final probability: 37%", "assistantfinal probability: 0.4", "probability : 5 %", "I say 0.4", "Probability: 1.7", "Probability: 0.37.", None, "x probability: .5"]
    assert evaluate(spark, X.parse_probability, texts) == [0.37, 0.37, 0.4, 0.05, None, None, None, None, 0.5]
    assert evaluate(spark, lambda c: X.parse_probability(c, True), ["I say 0.4", "40 % maybe", "nothing"]) == [0.4, 0.4, None]


def test_punctuation_loop(spark):
    assert evaluate(spark, X.has_punctuation_loop, ["!" * 16, "!" * 15, "=" * 30, "?!" * 20, None]) == [True, False, True, False, False]


def test_canonical_url(spark):
    urls = [" HTTP://A.b/C/?q=1 ", "https://a.b//", "https://a.b/#top", "", "?x", None]
    assert evaluate(spark, X.canonical_url, urls) == ["https://a.b/c", "https://a.b", "https://a.b/#top", None, None, None]


def test_normalize_and_jaccard(spark):
    assert evaluate(spark, X.normalize_text, ["Will  X, happen?", "Été² — oui_non", ""]) == ["will x happen", "été² oui_non", ""]
    df = spark.createDataFrame([("one two three", "two three four"), ("a b", "a b"), ("", "one")], "a string, b string")
    assert [r.j for r in df.select(X.jaccard(X.token_set(F.col("a")), X.token_set(F.col("b"))).alias("j")).collect()] == [0.5, 0.0, 0.0]


def test_dates(spark):
    values = ["2025-08-01", "2025-08-01T23:30:00Z", "2025-08-01T23:30:00-02:00", "2025-08-01T23:30:00+0530", "2025-08-01 10:00", "2025-08-01junk", "N/A", " n/a ", "", None, "2025", "2025-13-01", "not a date"]
    d = dt.date(2025, 8, 1)
    assert evaluate(spark, dates.parse_iso_date, values) == [d, d, dt.date(2025, 8, 2), d, d, d] + [None] * 7
    assert evaluate(spark, dates.parse_any_date, ["1754006400", "1754006400000", "1754006400.5", "x"]) == [d, d, d, None]
    # seconds of eight digits are seconds too
    assert evaluate(spark, dates.parse_any_date, ["9999000", "10000000", "99999000", "100000000"]) == [dt.date(1970, 4, 26), dt.date(1970, 4, 26), dt.date(1973, 3, 3), dt.date(1973, 3, 3)]
    assert evaluate(spark, dates.is_iso_date, ["2025-08-01", "2025-8-1", "2025-02-30", "2025-08-01T"]) == [True, False, False, False]
    with pytest.raises(ValueError):
        dates.stratify_key(F.col("v"), "week")


def test_scores(spark):
    df = spark.createDataFrame([(0.2, 1), (0.0, 0), (1.0, 0)], "p double, o int")
    r = df.select(scores.brier(F.col("p"), F.col("o")).alias("b"), scores.log_loss(F.col("p"), F.col("o")).alias("l"), scores.logit(F.col("p")).alias("g")).collect()
    assert r[0].b == pytest.approx(0.64) and r[0].l == pytest.approx(1.6094379) and r[1].l == pytest.approx(1e-6, rel=1e-3) and r[2].l == pytest.approx(13.8155, rel=1e-4) and r[0].g == pytest.approx(-1.3862943)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert same.agg(scores.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None
    assert same.limit(1).agg(scores.pearson(F.col("y"), F.col("y")).alias("r")).first().r is None
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (3.0,)], "x double")
    assert nan.agg(scores.mean(F.col("x")).alias("m")).first().m == 2.0
    assert spark.createDataFrame([(4.0,)], "x double").agg(scores.population_std(F.col("x")).alias("s")).first().s == 0.0


def test_prediction_text(spark):
    df = spark.createDataFrame([("0.3", "True"), ("0.3", "False"), ("1.2", "1"), ("nan", "true"), ("0", "true"), (None, "1"), ("x", "1")], "p string, ok string")
    assert [r.x for r in df.select(scores.prediction_from_text(F.col("p"), F.col("ok")).alias("x")).collect()] == [0.3, None, None, None, 1e-6, None, None]


def test_entities(spark):
    t = "Will Acme Corp reach $5.2k or 10% by September 1, 2025? Before 2025-09-01, I ask Jane O'Neil."
    assert set(evaluate(spark, entities.extract_dates, [t])[0]) == {"September 1, 2025", "2025-09-01", "2025"}
    assert {"$5.2k", "10%"} <= set(evaluate(spark, entities.extract_numbers, [t])[0])
    assert {"Acme Corp", "Jane O'Neil"} <= set(evaluate(spark, entities.extract_proper_nouns, [t])[0])


PAIRS = [
    ("Will Acme close above $5 by 2025-09-01?", "By 2025-09-01, will Acme end above $5?", True, ""),
    ("Will Acme close above $5 by 2025-09-01?", "Will Acme end above $5?", False, "missing date"),
    ("Will Acme close above $5 in 2025?", "In 2025, will Acme end above $6?", False, "missing number"),
    ("Will Acme close higher in 2025?", "In 2025, will the firm end higher?", False, "missing proper noun"),
    ("will it rain?", "  ", False, "empty"), ("will it rain?", "will it rain? ", False, "identical"),
]


def test_validate_paraphrase(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(PAIRS)], "i int, a string, b string")
    got = df.select("i", entities.validate_paraphrase(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    for r, (a, b, ok, reason) in zip(got, PAIRS):
        assert r.v.ok == ok and r.v.reason.startswith(reason)


def test_entities_of_all_scripts(spark):
    row = lambda t: spark.createDataFrame([(t,)], "t string").select(entities.extract_proper_nouns(F.col("t")).alias("names"), entities.extract_numbers(F.col("t")).alias("numbers"), entities.extract_dates(F.col("t")).alias("dates")).first()
    r = row("Will São Paulo beat Müller FC by ٢٠ or 12,5 % before Sept 3, 2026?")
    assert r.names[:2] == ["São Paulo", "Müller FC"]
    assert "٢٠" in r.numbers and "12,5 %" in r.numbers and "2026" in r.dates
    # letters of any script join a word, so neither digit here stands alone
    assert row("é5 5é").numbers == [] and row("ÉA Zé").names == ["Zé"]
    bad = spark.range(1).select(entities.validate_paraphrase(F.lit("Rise by ٢٠?"), F.lit("Rise by much?")).alias("v")).first().v
    assert not bad.ok and bad.reason.startswith("missing number")


def test_messages_and_prompts(spark):
    kind = "array<struct<role: string, content: string>>"
    m = [[(" user ", "hi"), ("tool", "x"), ("assistant", None)], [("tool", "x")], []]
    got = evaluate(spark, X.usable_messages, m, kind)
    assert [tuple(x) for x in got[0]] == [("user", "hi"), ("assistant", "")] and got[1:] == [None, None]
    assert evaluate(spark, X.render_chat_prompt, [[("user", "hi")]], kind) == ["USER:\nhi\n\nASSISTANT:\n"]


def test_small_texts(spark):
    assert evaluate(spark, X.classify_response, ['{"base_rate": 1}', "```json\n[1]\n```", "[]", "{}", "x"]) == ["context", "paraphrase", "paraphrase", "?", "?"]
    eta = lambda c: X.fmt_eta(c, F.lit(2.0))
    assert evaluate(spark, eta, [10.0, 600.0], "double") == ["5.0 min", "5.00 h (300 min)"]
    assert evaluate(spark, lambda c: X.fmt_eta(c, F.lit(0.0)), [10.0], "double") == ["—"]
    assert evaluate(spark, lambda c: X.fmt_cost(c, c, 3.0, 15.0), [1e6], "double") == ["$18.00"]
    tree = '{"type": "doc", "content": [{"text": "a", "content": [{"text": "b"}]}, {"children": [{"text": "c"}, "d"]}]}'
    assert evaluate(spark, X.flatten_richtext, [tree, "broken", None]) == ["a b c d", None, None]
    assert evaluate(spark, X.has_placeholder, ["x {resolution_date}", "{A}", "{}"]) == [True, False, False]
