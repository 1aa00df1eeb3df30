"""Whole runs, from files to files: questions of the sources, the unified pool, training rows,
predictions and their metrics, coherence, and a report on progress.

``python -m augur.flows NAME ...`` runs those that need no model. Every flow is a chain of the
operators; what comes to the driver are one-row reports.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.operators import assemble, audit, coherence, generate, metrics, split, visits
from augur.operators.dedupe import PRIORITY, url_arbitration
from augur.sources import files, paged, platforms
from augur.sources import schema as S
from augur.sources.shared import written

GROUP_FIELDS = ["id", "split", "outcome", "n_variants", "n_parseable", "coverage", "mean_prob", "parasd", "mean_brier"]
VARIANT_FIELDS = [c.split()[0] for c in S.PREDICTION_CSV.split(", ")]


def _report(spark: SparkSession, path: str, **parts: DataFrame) -> dict:
    """Writes one-row frames as one JSON report, each under its name, and gives it back."""
    row = spark.range(1).select(F.lit(True).alias("_one"))
    for name, frame in parts.items():
        row = row.crossJoin(F.broadcast(frame.select(F.struct(*frame.columns).alias(name))))
    row = row.drop("_one")
    files.write_report(row, path)
    return json.loads(row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"})).first()[0])


def _counts(frame: DataFrame, name: str, n: str = "n") -> DataFrame:
    """Counts by name as one row with a map; ``frame`` has a row for each of few names."""
    return frame.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, n)))).alias("counts"))


def pull_platform(spark: SparkSession, platform: str, output: str, url: str, cutoff: str = S.CUTOFF, cache: str | None = None, **options: object) -> dict:
    """Questions of a platform's API as line JSON, and what was left out by reason."""
    limits = {"min_volume": float(options.pop("min_volume"))} if "min_volume" in options else {}
    items = written(paged.scan(spark, cache=cache, preset=platform, url=url, **options))
    good, skipped = platforms.pull(items, platform, cutoff, **limits)
    good = written(good)
    files.write_jsonl(good, output)
    return {"written": good.count(), "skipped": {r["reason"]: r["n"] for r in skipped.collect()}}


def pull_sets(spark: SparkSession, folder: str, output: str, cutoff: str = S.CUTOFF) -> dict:
    """Questions of a folder of question sets and resolution sets as line JSON."""
    questions = files.read_question_sets(spark, f"{folder}/question_sets/*.json")
    mapped = written(platforms.forecastbench(files.read_resolution_sets(spark, f"{folder}/resolution_sets/*.json"), questions, cutoff))
    good = platforms.accepted(mapped)
    files.write_jsonl(good, output)
    return {"written": good.count(), "skipped": {r["reason"]: r["n"] for r in platforms.skip_counts(mapped).collect()}}


def unify(spark: SparkSession, inputs: list[str], output: str, audit_output: str, threshold: float = 0.7, window_days: int = 14, ranks: dict[str, int] = PRIORITY) -> dict:
    """One pool of the questions of all inputs that are there, without duplicates between sources,
    and a report on it. Pairs are visited in the order of inputs and lines."""
    good, bad, missing = files.read_present(spark, inputs, ordered=True)
    rows = written(good)
    first = written(url_arbitration(rows, ranks))
    kept = written(visits.without_losers(first, ["_input", "_file", "_row"], threshold, window_days, ranks).select(*S.QUESTION.names))
    files.write_jsonl(kept, output)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    steps = n(rows, "input").crossJoin(n(first, "_first")).crossJoin(n(kept, "kept"))
    steps = steps.select("input", (F.col("input") - F.col("_first")).alias("url_duplicates_dropped"), (F.col("_first") - F.col("kept")).alias("text_duplicates_dropped"), "kept")
    out = _report(spark, audit_output, dedupe=steps, pool=audit.report(kept), rejected=_counts(bad.groupBy("reject_reason").agg(F.count("*").alias("n")), "reject_reason"))
    return {**out, "missing": missing}


def build_training_set(spark: SparkSession, unified: str, contexts: str, paraphrases: str, output: str, audit_output: str, fixed_test: str | None = None, k: int = 5, config: split.SplitConfig = split.SplitConfig()) -> dict:
    """Training rows from the pool, its contexts and its paraphrases, and a report."""
    questions, _ = files.read_questions(spark, unified)
    questions = written(questions)
    fixed = files.read_questions(spark, fixed_test)[0].select("id") if fixed_test and files.exists(spark, fixed_test) else None
    splits = written(split.split_ids(questions, config, fixed))
    c, p = (files.read_rows(spark, path, schema, ordered=True) for path, schema in ((contexts, S.CONTEXT), (paraphrases, S.PARAPHRASES)))
    checked = written(assemble.checked(questions, c, p, splits, k))
    rows = written(assemble.training_rows(checked))
    files.write_jsonl(rows, output)
    groups = _counts(splits.groupBy("split").agg(F.count("*").alias("n")), "split")
    return _report(spark, audit_output, split_group_counts=groups, assembly_stats=_counts(assemble.assembly_stats(checked), "name"), training_rows=rows.agg(F.count("*").alias("n")))


def evaluate(spark: SparkSession, training: str, folder: str, split_name: str, mode: str, constant: float = 0.5, limit_groups: int | None = None, model: str = "", client: generate.Client | None = None, cache: str | None = None, **call: object) -> dict:
    """Predictions of a split, metrics of its groups and a summary, in ``folder``. ``mode``:
    constant, context-base-rate, train-base-rate, or one that asks ``client`` (api, tinker)."""
    rows = spark.read.schema(S.TRAINING).json(training)
    chosen = metrics.filter_rows(rows, split_name, limit_groups)
    if chosen.isEmpty():
        raise ValueError(f"no rows of the split {split_name!r} in {training}")
    if mode in ("api", "tinker"):
        if client is None:
            raise ValueError(f"mode {mode!r} needs a client")
        made = generate.predictions(chosen, client, mode, model, cache=cache, **call)
        bundle = made, None, None
    else:
        bundle = metrics.evaluate(rows, split_name, mode, constant, limit_groups, model)
    made = written(bundle[0])
    files.write_csv(made, f"{folder}/variant_predictions", VARIANT_FIELDS)
    files.write_csv(metrics.group_metrics(made), f"{folder}/group_metrics", GROUP_FIELDS)
    summary = metrics.summary(made).withColumns({"split": F.lit(split_name), "mode": F.lit(mode), "model": F.lit(model), "limit_groups": F.lit(limit_groups).cast("int")})
    if mode == "train-base-rate":
        summary = summary.crossJoin(F.broadcast(metrics.train_base_rate(rows)))
    return _report(spark, f"{folder}/summary", summary=summary)["summary"]


def check_coherence(spark: SparkSession, predictions: str, training: str, folder: str) -> dict:
    """How predictions move from the base rate, by group and in all, in ``folder``."""
    p, t = files.read_predictions_csv(spark, predictions), files.read_training_index(spark, training)
    found = written(coherence.groups(coherence.updates(coherence.matched(p, t))))
    files.write_csv(found, f"{folder}/group_coherence")
    return _report(spark, f"{folder}/summary", summary=coherence.summary(p, t))["summary"]


def progress(spark: SparkSession, cache: str, targets: dict[str, int], rate_per_minute: float, output: str) -> list[dict]:
    """Calls and tokens of a cache of responses by kind, and what is left to do and to pay."""
    totals = audit.token_totals(files.read_cache(spark, cache))
    wanted = spark.createDataFrame(list(targets.items()), "kind string, target long")
    rows = audit.projection(totals, wanted, rate_per_minute)
    files.write_jsonl(rows, output)
    return [r.asDict() for r in rows.orderBy("kind").collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="augur.flows", description=__doc__.splitlines()[0])
    flows = parser.add_subparsers(dest="flow", required=True)

    def flow(name: str, run: Callable[..., object], **arguments: dict) -> None:
        sub = flows.add_parser(name)
        for a, how in arguments.items():
            sub.add_argument(f"--{a.replace('_', '-')}", **how)
        sub.set_defaults(run=run)

    need, text, number, whole = {"required": True}, {}, {"type": float}, {"type": int}
    flow("pull-sets", pull_sets, folder=need, output=need, cutoff={"default": S.CUTOFF})
    flow("pull-platform", pull_platform, platform={"required": True, "choices": sorted(paged.PRESETS)}, output=need, url=need, cutoff={"default": S.CUTOFF}, cache=text, partitions={"type": int, "default": 1})
    flow("unify", unify, inputs={"required": True, "nargs": "+"}, output=need, audit_output=need, threshold={**number, "default": 0.7}, window_days={**whole, "default": 14})
    flow("build", lambda s, train_frac, val_frac, seed, stratify_by, **a: build_training_set(s, config=split.SplitConfig(train_frac, val_frac, seed, stratify_by), **a), unified=need, contexts=need, paraphrases=need, output=need, audit_output=need, fixed_test=text, k={**whole, "default": 5},
         train_frac={**number, "default": 0.8}, val_frac={**number, "default": 0.1}, seed={**whole, "default": 17}, stratify_by={"choices": ("resolved_month", "none"), "default": "resolved_month"})
    flow("evaluate", evaluate, training=need, folder=need, split_name={"default": "validation"}, mode={"required": True, "choices": ("constant", "context-base-rate", "train-base-rate")}, constant={**number, "default": 0.5}, limit_groups=whole, model={"default": ""})
    flow("coherence", check_coherence, predictions=need, training=need, folder=need)
    flow("drop-templated", lambda s, path: files.drop_templated_in_place(s, path).first().asDict(), path=need)
    args = vars(parser.parse_args(argv))
    run, _ = args.pop("run"), args.pop("flow")
    own = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run(own, **args), indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
