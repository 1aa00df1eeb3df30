"""Flows from files to files, and their command line."""

import datetime as dt
import json

import pytest

from augur import flows
from augur.sources import files
from augur.sources import schema as S
from test_sources import Api

SAME = "Will the central bank raise rates before the summer meeting"


def question(i, source, text, day, url=None):
    return (f"{source}::{i}", text, 1, dt.date(2025, 1, 1), dt.date.fromisoformat(day), source, url, None, None, [], "{}")


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_from_questions_to_metrics(spark, tmp_path):
    a = [question(1, "polymarket", SAME, "2025-09-05"), question(2, "polymarket", "Something else entirely happens soon", "2025-09-07", "http://a/x")]
    b = [question(1, "metaculus", SAME + "?", "2025-09-06"), question(3, "metaculus", "A third question of its own kind", "2025-10-06"), question(4, "metaculus", "Fourth of them all", "2025-10-07", "https://A/x/?q=1")]
    for name, rows in (("a", a), ("b", b)):
        files.write_jsonl(spark.createDataFrame(rows, S.QUESTION), str(tmp_path / name))
    (tmp_path / "a" / "more.json").write_text('{"id": "x", "extra": 1}\n')
    out = str(tmp_path / "pool")
    args = ["unify", "--inputs", str(tmp_path / "a"), str(tmp_path / "none"), str(tmp_path / "b"), "--output", out, "--audit-output", str(tmp_path / "audit")]
    assert flows.main(args, spark) == 0
    kept = [json.loads(r.value)["id"] for r in spark.read.text(out).collect()]
    assert sorted(kept) == ["metaculus::1", "metaculus::3", "metaculus::4"]
    report = flows.unify(spark, [str(tmp_path / "a"), str(tmp_path / "none"), str(tmp_path / "b")], out, str(tmp_path / "audit"))
    assert report["dedupe"] == {"input": 5, "url_duplicates_dropped": 1, "text_duplicates_dropped": 1, "kept": 3}
    assert report["rejected"]["counts"] == {"unknown_column": 1} and report["missing"] == [str(tmp_path / "none")]

    context = lambda i: {"question_id": i, "base_rate": {"value": 0.25, "n_reference_events": 3, "reference_window_years": 2, "explanation": "e"}, "news_snapshot": [], "leakage_filtered_count": 0, "cache_hit": False}
    text = {r["id"]: r["question"] for r in spark.read.json(out).collect()}
    group = lambda i: {"question_id": i, "paraphrases": [{"variant_index": k, "text": text[i] if k == 0 else f"{text[i]} {k}", "is_original": k == 0} for k in range(3)]}
    contexts, groups = lines(tmp_path / "c.jsonl", map(context, kept)), lines(tmp_path / "p.jsonl", map(group, kept[:2]))
    rows = str(tmp_path / "rows")
    fixed = lines(tmp_path / "fixed.jsonl", [])
    built = flows.build_training_set(spark, out, contexts, groups, rows, str(tmp_path / "built"), fixed, k=3, config=flows.split.SplitConfig(train_frac=0.0, val_frac=0.0))
    assert built["training_rows"]["n"] == 6 and built["split_group_counts"]["counts"] == {"test": 3} and built["assembly_stats"]["counts"]["missing_paraphrase"] == 1

    folder = str(tmp_path / "run")
    summary = flows.evaluate(spark, rows, folder, "test", "context-base-rate", model="m")
    assert summary["n_groups"] == 2 and summary["mean_brier"] == 0.5625 and summary["mode"] == "context-base-rate"
    assert json.loads("".join(r.value for r in spark.read.text(f"{folder}/summary", wholetext=True).collect()))["summary"]["n_variant_predictions"] == 6
    assert files.read_predictions_csv(spark, f"{folder}/variant_predictions").count() == 6
    moved = flows.check_coherence(spark, f"{folder}/variant_predictions", rows, str(tmp_path / "coherence"))
    assert moved["n_groups"] == 2 and moved["mean_log_odds_update"] == 0
    assert spark.read.csv(str(tmp_path / "coherence/group_coherence"), header=True).count() == 2

    class Client:
        def complete(self, system, user):
            return "Probability: 0.9", 1, 1

    asked = flows.evaluate(spark, rows, folder, "test", "api", client=Client(), cache=str(tmp_path / "answers"))
    assert asked["mean_brier"] == pytest.approx(0.01) and asked["mode"] == "api"
    with pytest.raises(ValueError, match="client"):
        flows.evaluate(spark, rows, folder, "test", "tinker")
    with pytest.raises(ValueError, match="no rows"):
        flows.evaluate(spark, rows, folder, "train", "constant")
    assert flows.main(["evaluate", "--training", rows, "--folder", folder, "--split-name", "test", "--mode", "constant", "--limit-groups", "1"], spark) == 0
    assert files.read_predictions_csv(spark, f"{folder}/variant_predictions").count() == 3


def test_pulls(spark, tmp_path):
    sets = tmp_path / "sets"
    for name, doc in (
        ("question_sets/s.json", {"question_set": "s.json", "questions": [{"id": "q1", "source": "fred", "question": "Will it rise?", "freeze_datetime": "2025-01-01T00:00:00Z", "url": "u"}, {"id": "q2", "source": "fred", "question": "Will it fall?", "freeze_datetime": "2025-01-01T00:00:00Z", "url": "u"}]}),
        ("resolution_sets/r.json", {"question_set": "s.json", "resolutions": [{"id": "q1", "source": "fred", "resolution_date": "2025-09-01", "resolved_to": 1.0, "resolved": True}, {"id": ["q1", "q2"], "source": "fred", "resolution_date": "2025-09-01", "resolved_to": 1.0, "resolved": True}]}),
    ):
        (sets / name).parent.mkdir(parents=True, exist_ok=True)
        (sets / name).write_text(json.dumps(doc))
    got = flows.pull_sets(spark, str(sets), str(tmp_path / "fb"))
    assert got["written"] == 1 and sum(got["skipped"].values()) == 1
    ms = 1_756_684_800_000
    with Api(25) as api:
        api.items = [{"id": i, "slug": f"s{i}", "creatorUsername": "u", "question": f"Will {i}?", "textDescription": "d", "outcomeType": "BINARY", "isResolved": True, "resolution": "YES" if i % 2 else "MKT", "volume": 500.0, "closeTime": ms, "resolutionTime": ms, "groupSlugs": []} for i in range(25)]
        got = flows.pull_platform(spark, "manifold", str(tmp_path / "mf"), api.url, page_size=10, throttle=0)
    assert got["written"] == 12 and sum(got["skipped"].values()) == 13
    assert files.read_questions(spark, str(tmp_path / "mf"))[0].count() == 12


def test_progress(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", json.dumps({"text": '{"base_rate": 1}' if i < 4 else "[]", "usage": {"input_tokens": 10, "output_tokens": 1}})) for i in range(7)], "key string, body string")
    files.store_cache(rows, str(tmp_path / "c"))
    got = flows.progress(spark, str(tmp_path / "c"), {"context": 10, "paraphrase": 3}, 2.0, str(tmp_path / "report"))
    assert [(r["kind"], r["calls"], r["remaining"]) for r in got] == [("context", 4, 6), ("paraphrase", 3, 0)]
