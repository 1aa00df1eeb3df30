"""Operators on small fixtures with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from augur.operators import assemble, audit, coherence, dedupe, generate, metrics, rewards, split
from augur.sources import schema as S

PRED = "id string, variant_index int, split string, outcome int, prediction double, parseable boolean"


def preds(spark, rows):
    return spark.createDataFrame([(i, v, "test", o, p, p is not None) for i, v, o, p in rows], PRED)


def test_summary_golden(spark):
    df = preds(spark, [("a", 0, 1, 0.2), ("a", 1, 1, 0.4), ("b", 0, 0, 0.1), ("b", 1, 0, 0.1)])
    r = metrics.summary(df).first()
    assert r.mean_brier == pytest.approx(0.255) and r.mean_parasd == pytest.approx(0.05) and r.frie_lambda_1 == pytest.approx(0.305)
    assert r.variant_coverage == 1.0 and r.group_full_coverage == 1.0 and r.n_groups == 2 and r.yes_rate == 0.5
    g = {x.id: x for x in metrics.group_metrics(df).collect()}
    assert g["a"].mean_prob == pytest.approx(0.3) and g["a"].parasd == pytest.approx(0.1) and g["a"].mean_brier == pytest.approx(0.5)


def test_summary_without_predictions(spark):
    r = metrics.summary(preds(spark, [("a", 0, 1, None), ("a", 1, 1, None)])).first()
    assert r.variant_coverage == 0 and r.mean_brier is None and r.mean_parasd is None and r.frie_lambda_1 is None and r.ece_10 is None and r.mean_log_loss is None
    e = metrics.summary(preds(spark, []).limit(0)).first()
    assert e.n_groups == 0 and e.variant_coverage == 0 and e.group_full_coverage == 0 and e.yes_rate is None


def test_calibration_bins(spark):
    df = preds(spark, [("a", 0, 1, 1.0), ("b", 0, 1, 0.95), ("c", 0, 0, 0.3), ("d", 0, 0, 0.0)])
    assert metrics.expected_calibration_error(df).first().ece == pytest.approx((abs(1.95 - 2) + 0.3 + 0) / 4)


def training(spark, groups, k=5, value=0.8):
    rows = [(f"q{i}", v, sp, o, (value,), "text") for i, (sp, o) in enumerate(groups) for v in range(k)]
    return spark.createDataFrame(rows, "id string, variant_index int, split string, outcome int, base_rate struct<value: double>, question string")


def test_evaluate_modes(spark):
    rows = training(spark, [("test", 1), ("test", 0), ("test", 1), ("train", 1)])
    made, groups, summary = metrics.evaluate(rows, "test", "constant", 0.5, limit_groups=2)
    assert made.count() == 10 and {r.id for r in groups.collect()} == {"q0", "q1"} and summary.first().mean_brier == 0.25
    assert made.first().completion == "Probability: 0.500000"
    assert metrics.evaluate(rows.where("outcome = 1"), "test", "context-base-rate")[2].first().mean_brier == pytest.approx(0.04)
    assert metrics.evaluate(rows, "test", "train-base-rate")[0].first().prediction == 1.0
    bad = training(spark, [("test", 1)], value=1.5)
    r = metrics.predict(bad, "context-base-rate").first()
    assert r.prediction is None and not r.parseable and r.completion == ""
    with pytest.raises(ValueError):
        metrics.predict(rows, "tinker")


def test_coherence(spark):
    rows = training(spark, [("test", 1), ("test", 0)], k=2, value=0.5)
    p = spark.createDataFrame([("q0", "0", "0.8", "True"), ("q0", "1", "0.6", "True"), ("q1", "0", "0.2", "True"), ("q1", "1", "x", "True"), ("zz", "0", "0.5", "True")], "id string, variant_index string, prediction string, parseable string")
    r = coherence.summary(p, rows).first()
    assert (r.n_variant_predictions, r.n_joined_parseable, r.n_groups, r.missing_training_rows) == (5, 3, 2, 1)
    assert r.brier_improvement_vs_prior > 0 and r.update_direction_accuracy == 1.0 and r.update_outcome_correlation > 0.9
    flat = coherence.summary(p.where("id = 'q1'"), rows).first()
    assert flat.update_outcome_correlation is None
    none = coherence.summary(p.limit(0), rows).first()
    assert none.coverage == 0 and none.mean_prior_brier is None and none.brier_improvement_vs_prior is None


def completions(spark, texts, outcome=1):
    return spark.createDataFrame([("g", i, outcome, t) for i, t in enumerate(texts)], "id string, variant_index int, outcome int, completion string")


def test_reward_goldens(spark):
    two = completions(spark, ["Probability: 0.2", "Probability: 0.4"])
    assert [r.reward for r in rewards.group_rewards(two).orderBy("variant_index").collect()] == pytest.approx([-0.64, -0.36])
    one = rewards.group_rewards(two, rewards.RewardConfig(lambda_invariance=1.0)).orderBy("variant_index").collect()
    assert [r.reward for r in one] == pytest.approx([-0.65, -0.37]) and [r.invariance_penalty for r in one] == pytest.approx([0.01, 0.01])
    odd = rewards.group_rewards(completions(spark, ["no number", "!" * 26 + " Probability: 0.5"]), rewards.RewardConfig(punctuation_loop_reward=-3.0)).orderBy("variant_index").collect()
    assert [r.reward for r in odd] == [-2.0, -3.0] and odd[1].punctuation_loop and not odd[1].parseable and odd[1].prediction == 0.5


def test_advantages(spark):
    same = spark.createDataFrame([("g", 1.0)] * 3, "id string, reward double")
    assert {(r.advantage, r.zero_std) for r in rewards.advantages(same).collect()} == {(0.0, True)}
    some = spark.createDataFrame([("g", float(x)) for x in [0, 0, 0, 1]], "id string, reward double")
    got = [r.advantage for r in rewards.advantages(some, clip=1.0).collect()]
    assert max(got) == 1.0
    free = [r.advantage for r in rewards.advantages(some, clip=None, scale=2.0).collect()]
    assert sum(free) == pytest.approx(0, abs=1e-9) and max(free) == pytest.approx(2 * 0.75 / (0.4330127 + 1e-6), rel=1e-5)


def test_training_groups(spark):
    rows = training(spark, [("train", 1), ("train", 0), ("test", 1)], k=3).withColumn("messages", F.lit("m"))
    rows = rows.unionByName(rows.limit(1).withColumn("id", F.lit("single")))
    assert sorted(r.id for r in rewards.training_groups(rows, "train").collect()) == ["q0", "q1"]
    pre = rewards.preflight(rows, "train").first()
    assert pre.groups == 2 and pre.group_sizes == [3] and pre.yes_rate == 0.5
    bad = rows.withColumn("outcome", F.when(F.col("variant_index") == 1, 0).otherwise(1))
    with pytest.raises(Exception, match="inconsistent outcomes"):
        rewards.training_groups(bad, "train").collect()


def test_train_loop(spark, tmp_path):
    rows = training(spark, [("train", 1)] * 4, k=2).withColumn("messages", F.lit("m"))
    sample = lambda b: b.withColumn("completion", F.lit("Probability: 0.3")).withColumn("stop_reason", F.lit("stop"))
    seen = []

    def learn(scored):
        if scored is None:
            return "path"
        seen.append(scored.select("id").distinct().count())
        return {"ppo_kl": 0.5 * len(seen)}

    stop = rewards.train(rows, "train", 5, 3, 1, sample, learn, str(tmp_path), safety=rewards.SafetyConfig(max_ppo_kl=0.7), save_every=1)
    assert stop == "PPO KL" and seen == [3, 3]
    assert spark.read.json(f"{tmp_path}/metrics").count() == 2 and spark.read.parquet(f"{tmp_path}/rollouts").count() == 12 and spark.read.json(f"{tmp_path}/checkpoints").count() == 1


def questions(spark, rows):
    out = []
    for i, (id_, source, text, day, url) in enumerate(rows):
        out.append((id_, text, 1, dt.date(2025, 1, 1), dt.date.fromisoformat(day), source, url, None, None, [], "{}"))
    return spark.createDataFrame(out, S.QUESTION)


def test_deduplicate(spark):
    same = "Will the central bank raise rates before the summer meeting"
    q = questions(spark, [
        ("metaculus::1", "metaculus", "A", "2025-09-01", "https://x.y/q?a=1"), ("manifold::1", "manifold", "B", "2025-09-01", "http://X.y/q/"), ("manifold::2", "manifold", "C", "2025-09-01", "http://z"), ("manifold::3", "manifold", "D", "2025-09-01", "http://z"),
        ("polymarket::1", "polymarket", same, "2025-09-05", None), ("forecastbench::1", "forecastbench", same + "?", "2025-09-15", None), ("forecastbench::2", "forecastbench", same, "2025-12-15", None), ("polymarket::2", "polymarket", same, "2025-09-06", None),
    ])
    kept = dedupe.deduplicate(q).collect()
    assert [r.id for r in kept] == ["manifold::2", "manifold::3", "metaculus::1", "polymarket::1", "polymarket::2", "forecastbench::2"]
    st = dedupe.dedupe_stats(q).first()
    assert (st.input, st.url_duplicates_dropped, st.text_duplicates_dropped, st.kept) == (8, 1, 1, 6)
    assert dedupe.deduplicate(spark.createDataFrame(kept, q.schema)).count() == 6


def test_similar_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    words = [f"word{i}" for i in range(30)]
    rows = [(str(i), "ab"[i % 2], " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(150)]
    for i in range(40):
        a = rows[rng.randrange(150)][2].split()
        rows.append((str(200 + i), "ab"[i % 2], " ".join(a[: max(1, len(a) - rng.randint(0, 3))])))
    sets = {i: set(t.split()) for i, _, t in rows}
    want = {(a, b) for a, sa, _ in rows for b, sb, _ in rows if sa < sb and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    got = dedupe.similar_pairs(spark.createDataFrame(rows, "id string, source string, question string"), 0.7)
    assert {(r.a, r.b) for r in got.collect()} == want and want


def test_greedy_replay():
    order = {"a": (0,), "b": (1,), "c": (2,)}
    assert dedupe.greedy_losers([("a", "b"), ("b", "c")], order) == {"b"}


def test_split(spark):
    q = spark.range(1000).select(F.concat(F.lit("metaculus::"), "id").alias("id"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("resolved_at"))
    s = split.split_ids(q).cache()
    assert s.count() == 1000 and split.overlap(s).count() == 0
    n = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(n["train"] - 800) <= 2 and abs(n["validation"] - 100) <= 2
    assert sorted(map(tuple, split.split_ids(q.orderBy(F.desc("id"))).collect())) == sorted(map(tuple, s.collect()))
    fixed = spark.createDataFrame([("mantic_q2_aib::5",), ("metaculus::7",)], "id string")
    f = {r.id: r.split for r in split.split_ids(q, fixed_test=fixed).collect()}
    assert f["metaculus::5"] == f["metaculus::7"] == "test" and len(f) == 1000
    assert split.split_ids(q, split.SplitConfig(stratify_by="none")).where("split = 'train'").count() == 800


def par(spark, rows):
    return spark.createDataFrame([(i, [(v, t, o) for v, t, o in p], 0, [], 1, False) for i, p in rows], S.PARAPHRASES)


def test_assemble(spark):
    q = questions(spark, [(f"s::{i}", "s", "Original?", "2025-09-01", None) for i in range(6)])
    good = [(1, "one", False), (0, "Original? ", True), (2, " ", False), (3, "three", False)]
    p = par(spark, [("s::0", good), ("s::1", good[:1]), ("s::2", [(0, "x", False), *good[2:], (5, "y", False)]), ("s::3", [(0, "Other?", True), *good[2:]]), ("s::4", good)])
    news = [("2024-12-01", "h", "s"), ("2025-01-01", "late", "")]
    c = spark.createDataFrame([(f"s::{i}", (0.25, 4, 2, "e"), news if i == 0 else [], 0, False) for i in (0, 1, 2, 3, 5)], S.CONTEXT)
    sp = spark.createDataFrame([("s::0", "train")], "id string, split string")
    rows = assemble.assemble(q, c, p, sp, 3).orderBy("variant_index").collect()
    assert [(r.id, r.variant_index, r.question, r.is_original, r.split) for r in rows] == [("s::0", 0, "Original?", True, "train"), ("s::0", 1, "one", False, "train")]
    prompt = rows[0].messages[1].content
    assert prompt.startswith("Forecast date: 2025-01-01\nResolution date: 2025-09-01\nSource: s\n\nQuestion:\nOriginal?\n\nBackground:\n(none provided)\n\nBase-rate prior: 0.250 (reference class size: 4; window: 2 years)\nBase-rate reasoning: e\n\nRelevant news")
    assert "  [2024-12-01] h — s\n" in prompt and prompt.endswith("Then add a short rationale on the following lines.")
    stats = {r.name: r.n for r in assemble.assembly_stats(assemble.checked(q, c, p, sp, 3)).collect()}
    assert stats == {"groups_emitted": 1, "groups_emitted_train": 1, "paraphrase_group_too_small": 1, "original_not_first": 1, "original_text_mismatch": 1, "missing_context": 1, "missing_paraphrase": 1, "empty_variant_text": 1}


def test_leakage(spark):
    news = [("2024-12-31", "a", ""), ("2025-01-01", "b", ""), (None, "c", ""), ("bad", "d", ""), ("2024-01-01", " ", ""), ("2024-12-31T23:00:00-05:00", "e", "")]
    df = spark.createDataFrame([(news, dt.date(2025, 1, 1)), (None, dt.date(2025, 1, 1))], "news array<struct<date: string, headline: string, summary: string>>, d date")
    a, b = (r.l for r in df.select(assemble.leakage_filter(F.col("news"), F.col("d")).alias("l")).collect())
    assert [n.headline for n in a.kept] == ["a"] and a.filtered == 5 and (b.kept, b.filtered) == ([], 0)


def test_leakage_reads_a_text_once(spark):
    """Within functions of arrays Spark computes again whatever is named again."""
    df = spark.range(1).select(F.array(F.struct(F.lit(" 2024-12-31 ").alias("date"), F.lit(" a ").alias("headline"), F.lit(None).cast("string").alias("summary"))).alias("news"), F.to_date(F.lit("2025-01-01")).alias("d"))
    used = df.select(assemble.leakage_filter(F.col("news"), F.col("d")).alias("l"))
    assert used._jdf.queryExecution().analyzed().toString().count("^\\s+") == 3
    assert [tuple(n) for n in used.first().l.kept] == [("2024-12-31", "a", "")] and used.first().l.filtered == 0


def test_audit(spark):
    q = questions(spark, [("a::1", "a", "x", "2025-01-05", None), ("b::1", "b", "x", "2025-02-05", None), ("b::2", "b", "x", "2025-02-06", None)]).withColumn("categories", F.array("source", F.lit("z")))
    r = audit.report(q).first()
    assert r.n == 3 and r.by_source == {"a": 1, "b": 2} and r.resolved_months == {"2025-01": 1, "2025-02": 2} and r.top_categories == {"z": 3, "b": 2, "a": 1}
    assert audit.report(q.limit(0)).first().n == 0
    e = spark.createDataFrame([(dt.datetime(2025, 1, 1, 0, 0, s),) for s in (0, 1, 1, 30)], "ts timestamp")
    assert {r.per_minute for r in audit.rolling_rate(e, 60).collect()} == {1.0, 3.0, 4.0}


class Scripted:
    """Answers in turn, by what the request holds."""

    def __init__(self, answers, fail=0):
        self.answers, self.fail, self.n = answers, fail, 0

    def complete(self, system, user):
        self.n += 1
        if self.n <= self.fail:
            raise generate.Retryable("slow down")
        for part, text in self.answers:
            if part in user:
                return text, 10, 5
        raise ValueError("no answer")


CONTEXT = {"base_rate": {"value": 0.3, "n_reference_events": 9, "reference_window_years": 3, "explanation": "x"}, "news_snapshot": [{"date": "2024-12-01", "headline": "h", "summary": "s"}, {"date": "2025-01-01", "headline": "late"}, "odd"]}


def test_contexts(spark):
    q = questions(spark, [("s::1", "s", "First?", "2025-09-01", None), ("s::2", "s", "Second?", "2025-09-01", None), ("s::3", "s", "Third?", "2025-09-01", None), ("s::4", "s", "Fourth?", "2025-09-01", None)])
    c = Scripted([("First?", json.dumps(CONTEXT)), ("Second?", "sure: " + repr(CONTEXT) + " ok"), ("Third?", "garbage")])
    got = {r.question_id: r for r in generate.contexts(q, c, "m", workers=1).collect()}
    for i in ("s::1", "s::2"):
        assert got[i].base_rate.value == 0.3 and [n.headline for n in got[i].news_snapshot] == ["h"] and got[i].leakage_filtered_count == 2 and got[i].error is None
    assert got["s::3"].error == "no JSON object" and got["s::4"].error.startswith("ERROR: ValueError")
    done = spark.createDataFrame([("s::1",), ("s::3",)], "question_id string")
    assert {r.question_id for r in generate.contexts(q, c, "m", done=done, workers=1).collect()} == {"s::2", "s::4"}


def test_cache_and_retry(spark):
    req = spark.createDataFrame([("a", "s", "one"), ("b", "s", "two"), ("c", "s", "two")], "id string, system string, user string")
    c = Scripted([("one", "1"), ("two", "2")])
    first = generate.ask(req, c, "m", 10, 0.0, workers=1).collect()
    assert {r.id: r.text for r in first} == {"a": "1", "b": "2", "c": "2"} and not any(r.cached for r in first)
    key = next(r.key for r in first if r.id == "a")
    assert key != next(r.key for r in generate.ask(req, c, "m", 11, 0.0, workers=1).collect() if r.id == "a")
    cache = spark.createDataFrame([(key, ("cached", (1, 1), None))], f"key string, response struct<text: string, usage: struct<input_tokens: long, output_tokens: long>, stop_reason: string>")
    again = {r.id: r for r in generate.ask(req, c, "m", 10, 0.0, cache, workers=1).collect()}
    assert again["a"].text == "cached" and again["a"].cached and not again["b"].cached
    naps = []
    retry = generate.Retry(attempts=3, sleep=naps.append)
    assert retry.call(lambda c=Scripted([("x", "y")], fail=2): c.complete("", "x"))[0] == "y" and len(naps) == 2
    with pytest.raises(generate.Retryable):
        generate.Retry(attempts=2, sleep=naps.append).call(lambda c=Scripted([("x", "y")], fail=5): c.complete("", "x"))


def test_cache_is_written(spark, tmp_path):
    req = spark.createDataFrame([(str(i), "s", f"ask {i % 4}") for i in range(8)] + [("x", "s", "fails")], "id string, system string, user string")
    path = str(tmp_path / "cache")
    first = generate.ask(req, Scripted([("ask", "yes")]), "m", 10, 0.0, path, workers=2, batch=1).collect()
    assert spark.read.parquet(path).count() == 4 and sum(r.error is None for r in first) == 8
    again = {r.id: r for r in generate.ask(req, Scripted([("fails", "now")]), "m", 10, 0.0, path, workers=1).collect()}
    assert len(again) == 9 and all(again[str(i)].text == "yes" and again[str(i)].cached for i in range(8)) and again["x"].text == "now" and not again["x"].cached
    assert spark.read.parquet(path).count() == 5
    rows = training(spark, [("test", 1), ("test", 0)], k=2).withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("id").alias("content"))))
    for client in (Scripted([("q", "Probability: 0.7")]), Scripted([])):
        assert {r.prediction for r in generate.predictions(rows, client, model="p", workers=1, cache=path).collect()} == {0.7}


def test_first_rows(spark):
    q = questions(spark, [(f"s::{i}", "s", "Q?", f"2025-09-0{9 - i}", None) for i in range(5)])
    done = spark.createDataFrame([("s::4",)], "question_id string")
    assert {r.id for r in generate.first_rows(q, 3, done).collect()} == {"s::3", "s::2"} and generate.first_rows(q, None).count() == 5


def test_last_row(spark):
    rows = spark.createDataFrame([("a", "f1", 5, "x"), ("a", "f2", 1, "y"), ("a", "f1", 9, "z"), ("b", "f1", 0, "w")], "k string, _file string, _row long, v string")
    assert {(r.k, r.v) for r in assemble.last_row(rows, "k").collect()} == {("a", "y"), ("b", "w")}
    assert assemble.last_row(rows.drop("_row").where("v in ('x', 'w')"), "k").count() == 2
    with pytest.raises(Exception, match="no order"):
        assemble.last_row(rows.drop("_row"), "k").collect()


def test_paraphrases(spark):
    q = questions(spark, [("s::1", "s", "Will Acme rise above $5?", "2025-09-01", None), ("s::2", "s", "Will Beta fall?", "2025-09-01", None)])
    c = Scripted([("Rejected:", '["Shall Acme go past $5?", "Will Acme rise above $5? "]'), ("Acme", '```json\n["Does Acme pass $5?", "Will it rise?"]\n```'), ("Beta", "no list")])
    got = {r.question_id: r for r in generate.paraphrases(q, c, k=3, rounds=3, workers=1).collect()}
    assert [p.text for p in got["s::1"].paraphrases] == ["Will Acme rise above $5?", "Does Acme pass $5?", "Shall Acme go past $5?"] and got["s::1"].rounds == 2 and got["s::1"].rejected_count == 2 and got["s::1"].error is None
    assert got["s::2"].error.startswith("ERROR: ValueError")


def test_parsers():
    assert generate.parse_paraphrases('text ["a", {"text": " b "}, 3, ""] end') == ["a", "b"]
    with pytest.raises(ValueError):
        generate.parse_paraphrases('{"a": 1}')
    assert generate.extract_json("x {'a': True, 'b': None} y") == {"a": True, "b": None}
    assert generate.extract_json("[1]") is None and generate.extract_json("{broken") is None
    assert generate._context_of('{"base_rate": {"value": 1.5}}')["error"].startswith("base_rate.value outside") and generate._context_of("{}")["error"] == "no base_rate object"


def test_api_predictions(spark):
    rows = training(spark, [("test", 1), ("test", 0)], k=1).withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("id").alias("content"))))
    got = {r.id: r for r in generate.predictions(rows, Scripted([("q0", "Probability: 0.7")]), workers=1).collect()}
    assert got["q0"].prediction == 0.7 and got["q1"].prediction is None and got["q1"].completion.startswith("ERROR: ValueError")


def visited(rows, ranks, similar, window):
    """Ids that go when pairs are visited one after another. rows: (id, source, key, day, score)
    in order of input."""
    months = sorted({r[3][:7] for r in rows})
    gone = set()
    for i, m in enumerate(months):
        cohort = [r for n in months[i : i + 2] for r in rows if r[3][:7] == n]
        for j, a in enumerate(cohort):
            if a[0] in gone:
                continue
            for b in cohort[j + 1 :]:
                apart = abs((dt.date.fromisoformat(a[3]) - dt.date.fromisoformat(b[3])).days)
                if b[0] in gone or a[1] == b[1] or apart > window or not similar(a[2], b[2]):
                    continue
                x, y = ((ranks.get(r[1], 99), -r[4]) for r in (a, b))
                gone.add(b[0] if x <= y else a[0])
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_deduplicate_in_order(spark, seed):
    """Many small worlds at once, each with words of its own, chains of similar questions, sources
    of equal rank, urls, and several months."""
    import random

    from augur.operators import visits

    rng, rows, want = random.Random(seed), [], set()
    words = [f"w{i}" for i in range(10)]
    sims = [set(words[i : i + 8]) for i in range(3)]  # neighbours are similar, the ends are not
    similar = lambda x, y: len(x & y) / len(x | y) >= 0.7
    assert similar(sims[0], sims[1]) and not similar(sims[0], sims[2])
    n = 0
    for world in range(60):
        own = []
        for _ in range(rng.randint(2, 14)):
            day = str(dt.date(2025, 1, 1) + dt.timedelta(days=rng.randint(0, rng.choice([10, 75]))))
            k, source, score = rng.randrange(3), rng.choice(["metaculus", "polymarket", "manifold", "x", "y"]), rng.randint(0, 2)
            own.append((f"id{n}", source, k, day, score, n))
            n += 1
        rng.shuffle(own)
        for pos, (i, source, k, day, score, _) in enumerate(own):
            rows.append((i, source, " ".join(f"{w}of{world}" for w in sorted(sims[k])), dt.date.fromisoformat(day), "b" * score, world * 1000 + pos))
        want |= visited([(i, s, frozenset(sims[k]), d, c) for i, s, k, d, c, _ in own], dedupe.PRIORITY, similar, 14)
    df = spark.createDataFrame([(i, s, t, d, b, p) for i, s, t, d, b, p in rows], "id string, source string, question string, resolved_at date, background string, pos int")
    df = df.withColumns({"url": F.lit(None).cast("string"), "resolution_criteria": F.lit(None).cast("string"), "categories": F.array().cast("array<string>")})
    bare = [("none", "x", "some words here", None, None, -1), ("blank", "metaculus", "", dt.date(2025, 1, 1), None, -2), ("null", "manifold", None, dt.date(2025, 1, 1), None, -3)]
    df = df.unionByName(spark.createDataFrame(bare, "id string, source string, question string, resolved_at date, background string, pos int"), allowMissingColumns=True)
    kept = {r.id for r in visits.deduplicate_in_order(df, ["pos"]).collect()}
    assert {r[0] for r in rows} - kept == want and {"none", "blank", "null"} <= kept
    # the rule without order drops rows that are kept here
    assert len({r.id for r in dedupe.deduplicate(df).collect()}) < len(kept)
    assert visits.deduplicate_in_order(df.limit(0), ["pos"]).count() == 0


def test_urls_give_the_order_of_visits(spark):
    """Rows of one url are visited together, at the first of them, and those without url too."""
    from augur.operators import visits

    rows = [(1, None), (2, "http://a"), (3, None), (4, "https://a/"), (5, "b"), (6, None)]
    df = spark.createDataFrame([(p, u, dt.date(2025, 1 + p % 2, 1)) for p, u in rows], "pos int, url string, resolved_at date")
    got = visits.with_place(df, ["pos"]).orderBy("o").select("pos", "m").collect()
    assert [r.pos for r in got] == [6, 2, 4, 1, 3, 5] and [r.m for r in got] == [0, 0, 0, 1, 1, 1]


def test_equal_questions_over_years(spark):
    """A hundred thousand equal questions of two sources over ten years meet only those near in time."""
    from augur.operators import visits

    n = 100_000
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") % 3650).cast("int"))
    df = spark.range(n).select(F.concat(F.lit("q"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "metaculus").otherwise("manifold").alias("source"), F.lit("Will the same thing happen again").alias("question"), day.alias("resolved_at"), F.col("id").alias("pos"))
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("url", "background", "resolution_criteria")}).withColumn("categories", F.array().cast("array<string>"))
    _, groups, pairs = visits._groups(visits.written(df), 0.7, 14, dedupe.PRIORITY, ["pos"])
    assert pairs.count() <= 29 * groups.count() < 29 * 2 * 3650 + 1
    for kept in (visits.deduplicate_in_order(df, ["pos"]), dedupe.deduplicate(df)):
        assert kept.groupBy("source").count().collect() == [("metaculus", n // 3 + 1)]
    links = dedupe.similar_links(df).groupBy("class_id", "n_links").count().collect()
    assert sorted((r.class_id, r.n_links, r["count"]) for r in links) == [("q0", n // 3 + 1, n - n // 3 - 1), ("q0", n - n // 3 - 1, n // 3 + 1)]


def test_similar_links_against_all_pairs(spark, monkeypatch):
    import random

    from augur.operators import similarity

    rng = random.Random(4)
    words = [f"word{i}" for i in range(25)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(60)]
    texts += [" ".join(t.split()[: max(1, len(t.split()) - 1)]) for t in texts] + [None, "", "a b"]
    rows = [(i, rng.choice("abc"), rng.choice(["en", "de", None]), rng.choice(texts)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source string, lang string, question string").withColumns({c: F.lit(1) for c in ("key", "n", "x")})
    sets = {i: frozenset(w for w in (t or "").split() if len(w) > 2) for i, _, _, t in rows}
    near = lambda x, y: sets[x] and sets[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.7
    want = {(i, min([j for j in sets if sets[i] and sets[j] == sets[i]] or [i]), sum(1 for j, t, m, _ in rows if t != s and g is not None and m == g and near(i, j))) for i, s, g, _ in rows}
    for crowd in (2000, 3):  # few and many tokens are split by a second one
        monkeypatch.setattr(similarity, "CROWD", crowd)
        assert {tuple(r) for r in dedupe.similar_links(df, same=("lang",)).collect()} == want
        pairs = {(r.a, r.b) for r in dedupe.similar_pairs(df, same=("lang",)).collect()}
        assert pairs == {(i, j) for i, s, g, _ in rows for j, t, m, _ in rows if s < t and g is not None and g == m and near(i, j)}


def test_similar_sets_are_sifted_before_they_are_shuffled(spark, monkeypatch):
    """Long sets that share rare tokens and little else are no candidates; the pairs found are the same
    where sketches are not broadcast and where the dictionary has no room for rare tokens."""
    import random

    from augur.operators import similarity

    rng = random.Random(5)
    rare = [f"rare{i}" for i in range(40)]
    texts = [" ".join([*rng.sample(rare, 20), *(f"common{i}" for i in rng.sample(range(4000), 700))]) for _ in range(20)]
    texts += [" ".join(t.split()[: len(t.split()) - rng.randint(1, 250)]) for t in texts]
    df = spark.createDataFrame([(i, "ab"[i % 3 % 2], t) for i, t in enumerate(texts)], "id long, source string, question string")
    sets = [frozenset(t.split()) for t in texts]
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(40) for b in range(40) if a < b}
    near = {p for p, v in j.items() if v >= 0.7}
    want = {tuple(sorted(p)) for p in near if "ab"[p[0] % 3 % 2] != "ab"[p[1] % 3 % 2]}
    assert len(near) > 10 and len(want) > 3
    for room, sent in ((similarity.DICTIONARY, similarity.SKETCHED), (similarity.DICTIONARY, 0), (3000, 0), (0, similarity.SKETCHED)):
        monkeypatch.setattr(similarity, "DICTIONARY", room)
        monkeypatch.setattr(similarity, "SKETCHED", sent)
        _, own = similarity.token_sets(df, "question", 3, [F.col("id")])
        assert len(near) <= similarity.candidates(own, 0.7).count() <= len(near) + 2
        assert {tuple(sorted((r.a, r.b))) for r in dedupe.similar_pairs(df).collect()} == want


def test_candidates_are_sifted_where_they_meet(spark, monkeypatch):
    """Sketches beyond what is broadcast at once meet by parts of the sets: no pair is shuffled that they
    tell apart, and the pairs are those of one part."""
    import random

    from augur.operators import similarity

    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.sample(words, rng.randint(5, 60))) for _ in range(150)]
    texts += [" ".join(t.split()[: rng.randint(3, 60)]) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, question string")
    _, sets = similarity.token_sets(df, "question", 3, [F.col("id")])
    rows = {r.sid: (r.n, frozenset(r.s)) for r in sets.collect()}
    common = {(a, b): len(rows[a][1] & rows[b][1]) for a in rows for b in rows if a < b}
    near = {(a, b) for (a, b), c in common.items() if c / (rows[a][0] + rows[b][0] - c) >= 0.7}
    assert len(near) > 20
    room = sets.agg(F.sum(F.length("k") + 16)).first()[0]
    raw = []
    monkeypatch.setattr(similarity, "_sifted", lambda pairs, sets: raw.append(pairs) or pairs.select("x", "y").distinct())
    found = []
    for most in (room, room // 2):
        monkeypatch.setattr(similarity, "SKETCHED", most)
        got = [(r.x, r.y) for r in similarity.candidates(sets, 0.7).collect()]
        assert len(got) == len(set(got)) and near <= set(got) and not raw
        found.append(set(got))
    assert found[0] == found[1]


def test_cuts_by_ranges(spark):
    """Parts by ranges of the hash are those of sorted rows: strata of any size, null among them,
    fractions that add up to one, repeated and equal hashes."""
    import random
    from decimal import ROUND_HALF_EVEN, Decimal

    rng = random.Random(6)
    rows = [(f"i{i}", b, f"{rng.choice([rng.randrange(1 << 16), 77]):04x}") for i, b in enumerate(rng.choice(["a", "a", "b", None]) for _ in range(700))]
    rows += [("x", "one", "0000"), ("y", "three", "ffff"), ("z", "three", "ffff"), ("w", "three", "0001")]
    df = spark.createDataFrame(rows, "id string, bucket string, h string").withColumn("b", F.shiftright(F.conv("h", 16, 10).cast("int"), 2))
    for fractions in ([0.8, 0.1], [0.5, 0.5], [0.0, 0.3], [1.0, 0.0], [0.1]):
        want = {}
        for b in {r[1] for r in rows}:
            mine = sorted((r for r in rows if r[1] == b), key=lambda r: (r[2], r[0]))
            ends, up = [], 0
            for f in fractions:
                up += int(Decimal(str(len(mine) * f)).quantize(Decimal(1), ROUND_HALF_EVEN))
                ends.append(up)
            want |= {r[0]: sum(k + 1 > e for e in ends) for k, r in enumerate(mine)}
        assert {r.id: r.part for r in split.place_by_ranges(df, fractions).collect()} == want
    assert split.place_by_ranges(df.limit(0), [0.8]).count() == 0


class Dies:
    """Notes what it is asked in a folder, and dies, not with an answer, at one request."""

    def __init__(self, folder, at=None):
        self.folder, self.at = folder, at

    def complete(self, system, user):
        import os
        import uuid

        if user == self.at:
            os._exit(3)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(user)
        return f"to {user}", 1, 1


def test_stored_answers_are_not_asked_again(spark, tmp_path):
    """A worker that dies half way loses the batch at hand; all else is in the cache."""
    asked, path = tmp_path / "asked", str(tmp_path / "cache")
    asked.mkdir()
    req = spark.createDataFrame([(str(i), "s", f"ask {i}") for i in range(60)], "id string, system string, user string")
    with pytest.raises(Exception):
        generate.ask(req, Dies(str(asked), "ask 31"), "m", 10, 0.0, path, workers=2, batch=5).collect()
    stored = spark.read.schema(generate.CACHE).parquet(path).count()
    first = [f.read_text() for f in asked.iterdir()]
    assert 0 < stored < 60 and len(first) - stored <= 2 * 5
    got = generate.ask(req, Dies(str(asked)), "m", 10, 0.0, path, workers=3, batch=7)
    assert {(r.id, r.text) for r in got.collect()} == {(str(i), f"to ask {i}") for i in range(60)}
    assert got.where("cached").count() == stored
    every = [f.read_text() for f in asked.iterdir()]
    assert len(every) == len(first) + 60 - stored
    # a repeated task finds the batches that it stored itself
    key, uri = "k", f"file:{tmp_path}/cache/answers-x.parquet"
    generate.store_batch(uri, {key: ("a", 1, 2)})
    assert generate.stored_batch(uri) == {key: ("a", 1, 2)} and generate.stored_batch(uri + "-none") == {}


class SaysWhere:
    """Answers with the number of the task that asks."""

    def complete(self, system, user):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId()), 1, 1


def test_requests_go_to_all_workers(spark):
    """Also where Spark has as many shuffle partitions as there are workers."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        req = spark.createDataFrame([(str(i), "s", f"ask {i}") for i in range(60)], "id string, system string, user string")
        assert {r.text for r in generate.ask(req, SaysWhere(), "m", 10, 0.0, workers=4).collect()} == {"0", "1", "2", "3"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_batches_become_few_files(spark, tmp_path):
    """The driver lists the files of a cache, so they must not grow with the batches."""
    asked, path = tmp_path / "asked", str(tmp_path / "cache")
    asked.mkdir()
    req = spark.createDataFrame([(str(i), "s", f"ask {i}") for i in range(300)], "id string, system string, user string")
    for most in (2, 2, 4):  # other batches find the same answers
        got = generate.ask(req, Dies(str(asked)), "m", 10, 0.0, path, workers=most, batch=4 + most)
        assert {(r.id, r.text) for r in got.collect()} == {(str(i), f"to ask {i}") for i in range(300)}
        assert len([f for f in (tmp_path / "cache").iterdir() if f.name.endswith(".parquet")]) <= 2
    assert len(list(asked.iterdir())) == 300 and spark.read.schema(generate.CACHE).parquet(path).count() == 300


class CountsFiles:
    """Answers with the number of files in a folder."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, system, user):
        import os

        return str(len(os.listdir(self.folder)) if os.path.exists(self.folder) else 0), 1, 1


def test_a_batch_takes_no_file_of_its_own(spark, tmp_path):
    """Files that come and go with every batch made most of the time of a run over many questions."""
    path = str(tmp_path / "cache")
    req = spark.createDataFrame([(str(i), "s", f"ask {i}") for i in range(300)], "id string, system string, user string")
    got = generate.ask(req, CountsFiles(path), "m", 10, 0.0, path, workers=2, batch=5).collect()
    assert len(got) == 300 and max(int(r.text) for r in got) <= 4
    assert not [f for f in (tmp_path / "cache").iterdir() if "jsonl" in f.name]


def test_journals_of_the_dead_are_stored(spark, tmp_path):
    req = spark.createDataFrame([(str(i), "s", f"ask {i}") for i in range(8)], "id string, system string, user string")
    path, client = str(tmp_path / "cache"), Scripted([("ask", "new")])
    keys = sorted(r.key for r in generate.ask(req, client, "m", 10, 0.0, path, workers=1).collect())
    for f in (tmp_path / "cache").iterdir():
        f.unlink()
    log = generate.journal_file(f"file:{path}", keys)
    generate.journal(log, {keys[0]: ("kept \n \u00df", 1, 2), keys[1]: ("kept", 3, 4)})
    with open(log.removeprefix("file:"), "a") as f:
        f.write(f'["{keys[2]}", "torn')
    generate.journal(log, {keys[3]: ("kept", 5, 6)})
    got = {r.key: r for r in generate.ask(req, client, "m", 10, 0.0, path, workers=1).collect()}
    assert [got[k].text for k in keys] == ["kept \n \u00df", "kept", "new", "kept"] + ["new"] * 4 and [k for k in keys if got[k].cached] == [keys[0], keys[1], keys[3]]
    assert got[keys[0]].output_tokens == 2 and generate.journalled(log) == {} and spark.read.schema(generate.CACHE).parquet(path).count() == 8


def test_extract_json_is_the_plain_search():
    import ast
    import re

    def plain(text):
        text = generate.unfenced(text)
        wide = re.search(r"\{.*\}", text, re.S)
        for read in (json.loads, ast.literal_eval):
            for part in (text, wide.group(0) if wide else text):
                try:
                    found = read(part)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(found, dict):
                    return found
        return None

    body = {"a": [1, None, {"b": "}"}], "c": "{"}
    texts = ["", "nothing", "{", "}{", "set()", "dict()", "5", "'{}'", "[{}]", "{1, 2}", "{*{}}", "# {\n{'a': 1}", "({'a': 1})", "\\\n{'a': 1}", "x{'a': 1}y{'b': 2}", "9 {}", "_{}", "\ufeff{'a': 1}", "(1, {'a': 1})"]
    for b in (json.dumps(body), repr(body), json.dumps(body, indent=1)):
        texts += [b, f"Here: {b} as asked", f"```json\n{b}\n```", f"({b})", f"# no\n{b}", f"{b} {b}", f"\u00e9{b}"]
    assert [generate.extract_json(t) for t in texts] == [plain(t) for t in texts]


def test_each_question_has_its_context(spark):
    """Also where questions share an id."""
    q = questions(spark, [("s::1", "s", "First?", "2025-09-01", None), ("s::1", "s", "Second?", "2025-09-01", None)])
    got = generate.contexts(q, Scripted([("First?", json.dumps(CONTEXT)), ("Second?", "garbage")]), "m", workers=1).collect()
    assert sorted(str(r.error) for r in got) == ["None", "no JSON object"]


def test_a_broken_run_goes_on(spark, tmp_path):
    rows = training(spark, [("train", 1)] * 6, k=2).withColumn("messages", F.lit("m"))
    folder, sampled, learned, saved = str(tmp_path / "run"), [], [], []

    def sample(b):
        sampled.append(1)
        return b.withColumn("completion", F.lit("Probability: 0.3")).withColumn("stop_reason", F.lit("stop"))

    def learn(fail_at=None):
        def f(scored):
            if scored is None:
                saved.append(1)
                return f"path{len(saved)}"
            step = scored.first()["step"]
            if step == fail_at:
                raise RuntimeError("lost")
            learned.append(step)
            return {"ppo_kl": "nan" if step == 2 else 0.1}

        return f

    go = lambda f, steps=4, **k: rewards.train(rows, "train", steps, 3, 1, sample, f, folder, safety=rewards.SafetyConfig(max_ppo_kl=0.7), save_every=2, **k)
    assert rewards.run_state(spark, folder) == (0, None)
    with pytest.raises(RuntimeError):
        go(learn(3))
    assert rewards.run_state(spark, folder) == (2, None) and learned == [1, 2] and len(sampled) == 3
    assert go(learn()) is None
    # the rollouts of the broken step were kept; finished steps were not repeated
    assert learned == [1, 2, 3, 4] and len(sampled) == 4 and len(saved) == 2
    assert spark.read.json(f"{folder}/metrics").count() == 4 and sorted(r.step for r in spark.read.json(f"{folder}/checkpoints").collect()) == [2, 4]
    assert spark.read.parquet(f"{folder}/rollouts").groupBy("step").count().collect() and go(learn()) is None and learned == [1, 2, 3, 4]
    rewards.export_rollouts(folder, spark, str(tmp_path / "csv"))
    out = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert out.columns == ["step", *rewards.ROLLOUT] and out.count() == 4 * 3 * 2
    # a run that stopped stays stopped
    stop = rewards.train(rows, "train", 3, 3, 1, sample, lambda s: {"ppo_kl": float("inf")}, str(tmp_path / "b"), safety=rewards.SafetyConfig(max_ppo_kl=0.7))
    n = len(sampled)
    assert stop == "PPO KL" == rewards.train(rows, "train", 3, 3, 1, sample, learn(), str(tmp_path / "b")) and len(sampled) == n


def test_near_copies_are_sent_to_few_blocks(spark, monkeypatch):
    """A set is not sent with each of its pairs: a family of near-equal texts meets in one block, and a
    large one in blocks of bounded size. Pairs stay those of a plain comparison."""
    from augur.operators import similarity

    texts = [" ".join([*(f"common{i}" for i in range(30)), f"f{a % 2}one", f"f{a % 2}two", f"own{a % 5}", f"word{a}"]) for a in range(120)] + ["lone words stand here", "lone words stand there", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, question string").withColumn("source", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    sets = [frozenset((t or "").split()) for t in texts]
    sim = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i % 3 == 0 and j % 3 and a and b}
    want = {(i, j, v) for (i, j), v in sim.items() if v >= 0.7}
    _, own = similarity.token_sets(df, "question", 3, [F.col("id")])
    pairs = similarity.candidates(own, 0.7).localCheckpoint()
    assert pairs.count() >= 120 * 119 / 2
    for block, most in ((similarity.BLOCK, 130), (500, 120 * 10)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        rows = similarity.dealt(pairs, own).withColumn("is_set", F.col("y") < 0).localCheckpoint()
        assert rows.where("is_set").count() <= most
        assert rows.where("not is_set").groupBy("block").count().agg(F.max("count")).first()[0] <= 3 * block
        assert {tuple(r) for r in dedupe.similar_pairs(df).collect()} == want
    monkeypatch.setattr(similarity, "DICTIONARY", 0)  # tokens are known by their hashes
    assert {tuple(r) for r in dedupe.similar_pairs(df).collect()} == want


def test_near_copies_are_given_out_once_a_run_of_tokens(spark, monkeypatch):
    """Texts that share all of their prefixes meet under each of its tokens and are shuffled for the first alone."""
    from augur.operators import similarity

    texts = [" ".join([*(f"word{i:03}" for i in range(100)), f"own{a}one", f"own{a}two"]) for a in range(20)]
    _, own = similarity.token_sets(spark.createDataFrame(list(enumerate(texts)), "id long, question string"), "question", 3, [F.col("id")])
    met, distinct = [], type(own).distinct
    monkeypatch.setattr(type(own), "distinct", lambda self: (met.append(self) if self.columns == ["x", "y"] else None) or distinct(self))
    assert similarity.candidates(own, 0.7).count() == 20 * 19 / 2
    assert [m.count() for m in met] == [20 * 19 / 2]
