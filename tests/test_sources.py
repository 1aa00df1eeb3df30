"""Sources: fixtures of each payload with mutations, files, paging, streaming."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from augur.sources import config, files, paged, platforms
from augur.sources import schema as S
from augur.streaming import incremental


def read(spark, rows, ddl):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", ddl).alias("r")).select("r.*")


def reasons(df):
    return [r.reason for r in df.collect()]


POST = {
    "id": 11, "title": "Post?", "description": "bg", "projects": {"category": [{"name": "Econ"}, {"name": ""}]},
    "question": {"id": 22, "type": "binary", "status": "resolved", "title": "Will it?", "resolution": "yes", "resolution_criteria": "rc", "fine_print": "fp", "scheduled_close_time": "2025-08-01T00:00:00Z", "actual_resolve_time": "2025-09-01T10:00:00Z"},
}


def post(**q):
    return {**POST, "question": {**POST["question"], **q}}


def test_metaculus(spark):
    got = platforms.metaculus(read(spark, [POST], platforms.METACULUS), tournament="t").first()
    assert (got.reason, got.id, got.question, got.outcome, got.freeze_date, got.resolved_at) == ("ok", "metaculus::11_22", "Will it?", 1, dt.date(2025, 8, 1), dt.date(2025, 9, 1))
    assert got.resolution_criteria == "rc\n\nFine print: fp" and got.categories == ["Econ", "tournament:t"] and got.url.endswith("/questions/11/") and json.loads(got.raw)["metaculus_post_id"] == "11"
    rows = [post(resolution="no"), post(resolution=True), post(resolution="annulled"), post(type="numeric"), post(status="open"), post(scheduled_close_time="2024-01-01"), post(scheduled_close_time="2025-10-01"), post(actual_resolve_time=None), {**post(title=""), "title": " "}]
    df = platforms.metaculus(read(spark, rows, platforms.METACULUS))
    assert reasons(df) == ["ok", "ok", "unclear_outcome", "not_binary", "not_resolved", "pre_cutoff", "freeze_after_resolution", "unparseable_dates", "no_title"]
    assert [r.outcome for r in platforms.accepted(df).collect()] == [0, 1]
    assert {r.reason: r.n for r in platforms.skip_counts(df).collect()}["no_title"] == 1


MARKET = {"id": "1", "conditionId": "0xa", "slug": "s", "question": " Will it? ", "description": "d", "outcomes": '["Yes", "No"]', "outcomePrices": '["1", "0"]', "closed": True, "active": False, "volumeNum": 5000.0, "endDate": "2025-08-01T00:00:00Z", "umaEndDate": "2025-08-05T00:00:00Z", "tags": [{"label": "Econ"}, "x"]}


def test_polymarket(spark):
    m = lambda **f: {**MARKET, **f}
    rows = [MARKET, m(outcomePrices='["0", "1"]'), m(outcomes=["No", "Yes"], outcomePrices=["0", "1"]), m(outcomePrices='["0.5", "0.5"]'), m(outcomes='["A", "B"]'), m(closed=False), m(active=True), m(volumeNum=5, volume=None), m(volumeNum=None, volume="2000"), m(endDate="2025-09-01T00:00:00Z"), m(endDate="2024-01-01"), m(outcomePrices="broken"), m(question="", title="")]
    got = platforms.polymarket(read(spark, rows, platforms.POLYMARKET)).collect()
    assert [r.reason for r in got] == ["ok", "ok", "ok", "unclear_outcome", "not_yes_no", "not_closed", "active", "low_volume", "ok", "ok", "pre_cutoff", "unclear_outcome", "no_title"]
    assert [r.outcome for r in got[:3]] == [1, 0, 1]
    assert got[0].categories == ["Econ", "x"] and got[0].question == "Will it?" and got[0].id == "polymarket::0xa" and got[9].freeze_date == got[9].resolved_at == dt.date(2025, 8, 5)
    low = platforms.polymarket(read(spark, [m(volumeNum=5)], platforms.POLYMARKET), min_volume=1)
    assert reasons(low) == ["ok"]


BET = {"id": "m1", "slug": "will", "creatorUsername": "u", "question": "Will it?", "textDescription": "d", "outcomeType": "BINARY", "isResolved": True, "resolution": "YES", "volume": 500.5, "closeTime": 1754006400000, "resolutionTime": 1756684800000, "groupSlugs": ["econ"]}


def test_manifold(spark):
    m = lambda **f: {**BET, **f}
    tree = {"type": "doc", "content": [{"type": "p", "content": [{"text": "rich"}, {"text": "text"}]}]}
    rows = [BET, m(resolution="NO"), m(resolution="MKT"), m(volume=5), m(outcomeType="FREE"), m(isResolved=False), m(closeTime=1759276800000), m(textDescription=None, description=tree), m(closeTime=1600000000000)]
    got = platforms.manifold(read(spark, rows, platforms.MANIFOLD)).collect()
    assert [r.reason for r in got] == ["ok", "ok", "unclear_outcome", "low_volume", "not_binary", "not_resolved", "ok", "ok", "pre_cutoff"]
    assert got[0].url == "https://manifold.markets/u/will" and got[0].freeze_date == dt.date(2025, 8, 1) and got[0].resolved_at == dt.date(2025, 9, 1) and got[6].freeze_date == dt.date(2025, 9, 1) and got[7].background == "rich text"


def sets(tmp_path, questions, resolutions, name="2025-08-01"):
    (tmp_path / "q").mkdir(exist_ok=True)
    (tmp_path / "r").mkdir(exist_ok=True)
    (tmp_path / "q" / f"{name}-llm.json").write_text(json.dumps({"questions": questions}))
    (tmp_path / "r" / f"{name}_resolution_set.json").write_text(json.dumps({"question_set": f"{name}-llm.json", "resolutions": resolutions}))


def test_forecastbench(spark, tmp_path):
    q = lambda i, **f: {"id": i, "source": "fred", "question": "Up by {resolution_date}?", "freeze_datetime": "2025-08-01T00:00:00Z", "url": "u", **f}
    r = lambda i, **f: {"id": i, "source": "fred", "resolution_date": "2025-09-01", "resolved_to": 1.0, "resolved": True, **f}
    sets(tmp_path, [q("a", question="old"), q("a"), q("b"), q("c"), q("d", freeze_datetime="2024-01-01"), q("e", question="{odd_field}?"), "odd", {"x": 1}, q("f", freeze_datetime="2025-10-01"), q("g", question=" ")],
         [r("a"), r("b", resolved=False), r("c", resolved_to=0.5), r(["a", "b"]), r("a,b"), r("zz"), r("d"), r("e"), r("f"), r("b", resolved_to="No"), r("b", resolution_date="N/A"), r("g")])
    sets(tmp_path, [q("a")], [r("a", resolved_to=0)], "2025-09-01")
    (tmp_path / "r" / "2025-10-01_resolution_set.json").write_text(json.dumps({"question_set": "missing.json", "resolutions": [r("a")]}))
    df = platforms.forecastbench(files.read_resolution_sets(spark, f"{tmp_path}/r/*_resolution_set.json"), files.read_question_sets(spark, f"{tmp_path}/q/*.json"))
    assert Counter(reasons(df)) == Counter({"ok": 2, "not_resolved": 1, "non_binary_outcome": 1, "combo_question": 2, "question_missing_for_resolution": 1, "pre_cutoff": 1, "unresolved_placeholder": 1, "freeze_after_resolution": 1, "unparseable_dates": 1, "duplicate_question_id": 1, "question_set_file_missing": 1, "schema_reject:question": 1})
    a = next(x for x in df.where("reason = 'ok'").collect() if x.id.endswith("::a"))
    assert a.question == "Up by 2025-09-01?" and a.outcome == 1 and a.categories == ["fred"] and json.loads(a.raw)["forecastbench_resolution_snapshot"] == "2025-08-01_resolution_set.json"


def test_drop_in(spark, tmp_path):
    q = platforms.accepted(platforms.metaculus(read(spark, [POST, {**post(id=33), "id": 12}], platforms.METACULUS)))
    for name, text in {"a.json": "[11, {\"id\": 99}]", "b.json": '{"questions": [{"id": null, "post_id": "11"}]}', "c.jsonl": '{"id": 11}\n\n{"post_id": 99}', "d.csv": "id,post_id\n,11\n99,\n", "e.txt": " 11 \n\n99\n"}.items():
        (tmp_path / name).write_text(text)
        matched, missing = platforms.drop_in(q, files.read_drop_in_ids(spark, str(tmp_path / name)))
        assert [r.id for r in matched.collect()] == ["mantic_q2_aib::11_22"]
        assert [r.id for r in missing.collect()] == ([] if name == "b.json" else ["99"])
    m = platforms.drop_in(q, spark.createDataFrame([("33",)], "id string"))[0].first()
    assert m.source == "mantic_q2_aib" and m.categories[-1] == "tournament:mantic_q2_aib"


def test_questions_round_trip(spark, tmp_path):
    good = platforms.accepted(platforms.metaculus(read(spark, [POST], platforms.METACULUS)))
    files.write_jsonl(good, str(tmp_path / "q"))
    line = spark.read.text(str(tmp_path / "q")).first().value
    assert list(json.loads(line)) == sorted(S.QUESTION.names)
    bad = [line, "", "{broken", line.replace('"outcome"', '"other"'), line.replace("metaculus::", "metaculus-"), line.replace("2025-08-01", "2025-8-1")]
    (tmp_path / "in.jsonl").write_text("\n".join(bad))
    ok, rejected = files.read_questions(spark, str(tmp_path / "in.jsonl"))
    assert ok.count() == 1 and ok.schema.names == S.QUESTION.names and sorted(r.reject_reason for r in rejected.collect()) == ["freeze_date", "id", "json", "unknown_column"]


def test_csv_and_index(spark, tmp_path):
    p = spark.createDataFrame([("a", "0", 'line\n"two", x')], "id string, variant_index string, completion string").withColumns({c: F.lit("1") for c in ("split", "outcome", "prediction", "parseable", "mode", "model", "question", "extra")})
    files.write_csv(p, str(tmp_path / "csv"), [c.split()[0] for c in S.PREDICTION_CSV.split(", ")])
    assert files.read_predictions_csv(spark, str(tmp_path / "csv")).first().completion == 'line\n"two", x'
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"id": "a", "variant_index": v, "question": t}) for v, t in [(0, "first"), (1, "x"), (0, "last")]))
    assert {(r.variant_index, r.question) for r in files.read_training_index(spark, str(tmp_path / "t.jsonl")).collect()} == {(0, "last"), (1, "x")}


def test_cache_and_lines(spark, tmp_path):
    (tmp_path / "k1.json").write_text(json.dumps({"text": "[1]", "usage": {"input_tokens": 3, "output_tokens": 2}}))
    (tmp_path / "k2.json").write_text("{broken")
    got = files.read_cache(spark, str(tmp_path)).collect()
    assert [(r.key, r.response.usage.input_tokens) for r in got] == [("k1", 3)] and got[0].modified is not None
    (tmp_path / "x.txt").write_text("a\n \n\nb\n")
    assert files.count_lines(spark, str(tmp_path / "x.txt")) == 2 and files.count_lines(spark, str(tmp_path / "none.txt")) == 0


def test_drop_templated(spark, tmp_path):
    lines = ['{"a": ["by {resolution_date}"]}', '{"{resolution_date}": 1}', "{broken {resolution_date}", '{"a": 1}', ""]
    (tmp_path / "in").write_text("\n".join(lines))
    r = files.drop_templated(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert (r.total, r.dropped) == (4, 1) and {x.value for x in spark.read.text(str(tmp_path / "out")).collect()} == set(lines[1:4])


def test_append_new(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    path = str(tmp_path / "out")
    assert files.append_new(rows.limit(1), path, "id", "id string, n int").count() == 1
    files.append_new(rows, path, "id", "id string, n int")
    assert sorted(r.id for r in spark.read.json(path).collect()) == ["a", "b"]


def test_paging(spark, tmp_path):
    items = [{"id": i} for i in range(7)]
    calls = []

    def offset(url, token):
        calls.append(url)
        at = int(url.split("offset=")[1].split("&")[0])
        return items[at : at + 3]

    naps = []
    o = {"url": "http://x", "page_size": "3", "until_short": "true", "throttle": "0.5"}
    assert [i["id"] for p in paged.pages(o, offset, naps.append) for i in p] == list(range(7)) and len(calls) == 3 and naps == [0.5, 0.5]
    assert sum(map(len, paged.pages({**o, "max_pages": "1"}, offset, naps.append))) == 3

    def keyset(url, token):
        before = int(url.split("before=")[1]) if "before=" in url else 7
        return [{"id": i} for i in range(before - 1, max(-1, before - 4), -1)]

    assert [i["id"] for p in paged.pages({"url": "u", "style": "keyset", "page_size": "3", "until_short": "true"}, keyset, naps.append) for i in p] == list(range(6, -1, -1))
    body = lambda url, token: {"results": items[:2], "next": None}
    cached = {"url": "http://y", "preset": "metaculus", "cache": str(tmp_path / "c")}
    assert sum(map(len, paged.pages(cached, body, naps.append))) == 2
    assert sum(map(len, paged.pages(cached, lambda u, t: pytest.fail("not cached"), naps.append))) == 2
    paged.register(spark)
    df = spark.read.format("paged_api").options(**cached).load()
    assert [json.loads(r.value)["id"] for r in df.collect()] == [0, 1]


class Api:
    """A local server of ``items`` with offset and keyset pages, which fails as it is told to."""

    def __init__(self, n, fail=None):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from urllib.parse import parse_qs, urlparse

        api = self
        self.items, self.seen, self.fail = [{"id": i, "text": f"é{i}"} for i in range(n)], [], fail or (lambda k: None)

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                api.seen.append(q)
                bad = api.fail(len(api.seen))
                self.send_response(bad[0] if bad else 200)
                for k, v in (bad[1] if bad else {}).items():
                    self.send_header(k, v)
                self.end_headers()
                if "offset" in q:
                    found = api.items[int(q["offset"]) :]
                else:
                    found = [x for x in reversed(api.items) if "before" not in q or x["id"] < int(q["before"])]
                if not bad:
                    self.wfile.write(json.dumps(found[: int(q["limit"])]).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/x"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.server.shutdown()
        self.server.server_close()


def ids(df):
    return sorted(json.loads(r.value)["id"] for r in df.collect())


def test_offset_pages_in_partitions(spark):
    with Api(95) as api:
        for n in (1, 4):
            api.seen.clear()
            df = paged.scan(spark, url=api.url, page_size=10, until_short="true", partitions=n)
            assert df.rdd.getNumPartitions() == n and ids(df) == list(range(95))
            assert len(api.seen) <= 10 + n
        assert ids(paged.scan(spark, url=api.url, page_size=10, until_short="true", partitions=4, max_pages=3)) == list(range(30))
        assert ids(paged.scan(spark, url=api.url, page_size=10, style="keyset", until_short="true", partitions=4)) == list(range(95))
    scan = paged.Scan({"url": "u", "page_size": "10"}, lambda url, token: [{"id": 1}])
    with pytest.raises(ValueError, match="one partition"):
        next(scan.share(0, 2))
    naps = []
    list(paged.Scan({"url": "u", "page_size": "1", "throttle": "0.5"}, lambda url, token: [{"id": 1}] if "offset=0" in url else [], naps.append).share(0, 4))
    assert naps == [2.0]


@pytest.mark.parametrize("style", ["offset", "keyset"])
def test_a_stopped_scan_goes_on(spark, tmp_path, style):
    """The server breaks down in the middle: pages of finished batches are not asked for again,
    and no item is lost or doubled; items added later are found by the next run."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "ck")
    options = {"page_size": 10, "style": style, "until_short": "true", "batch_pages": 2, "attempts": 1}
    with Api(75, fail=lambda k: (500, {}) if k == 6 else None) as api:
        with pytest.raises(Exception, match="500"):
            paged.scan_into(spark, out, mark, url=api.url, **options)
        done = spark.read.text(out).count()
        assert 0 < done < 75
        before = len(api.seen)
        paged.scan_into(spark, out, mark, url=api.url, **options)
        assert ids(spark.read.text(out)) == list(range(75))
        places = [q.get("offset", q.get("before")) for q in api.seen]
        first = places[before]
        assert int(first) == (done if style == "offset" else 75 - done)
        if style == "offset":
            api.items += [{"id": i} for i in range(75, 78)]
            paged.scan_into(spark, out, mark, url=api.url, **options)
            assert ids(spark.read.text(out)) == list(range(78))


def test_batches_grow_with_a_cache(spark, tmp_path):
    """A long scan has few batches; a run that is stopped asks for no page again."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "ck")
    options = {"page_size": 1, "style": "keyset", "until_short": "true", "batch_pages": 1, "attempts": 1, "cache": str(tmp_path / "pages")}
    with Api(60, fail=lambda k: (500, {}) if k == 20 else None) as api:
        with pytest.raises(Exception, match="500"):
            paged.scan_into(spark, out, mark, url=api.url, **options)
        assert 0 < spark.read.text(out).count() < 20
        assert paged.scan_into(spark, out, mark, url=api.url, **options) <= 12
        assert ids(spark.read.text(out)) == list(range(60))
        places = [q.get("before") for q in api.seen]
        assert len(places) == len(set(places)) + 1  # the one that failed
    paged.BATCH_BYTES, was = 10, paged.BATCH_BYTES
    try:
        stream = paged.PagedStream({**options, "url": api.url, "batch_pages": "2"})
        place, sizes = stream.initialOffset(), []
        for _ in range(3):
            rows, place = stream.read(place)
            sizes.append(len(list(rows)))
        assert sizes == [2, 2, 2]
    finally:
        paged.BATCH_BYTES = was


def test_throttled_pages_are_tried_again(spark):
    import email.utils

    answers = {1: (429, {"Retry-After": "0"}), 2: (503, {}), 4: (429, {"Retry-After": email.utils.formatdate(0, usegmt=True)})}
    with Api(25, fail=answers.get) as api:
        naps = []
        got = [x["id"] for p in paged.pages({"url": api.url, "page_size": "10", "until_short": "true"}, sleep=naps.append) for x in p]
        assert got == list(range(25)) and len(api.seen) == 6
        assert naps[0] == 0 and 1 <= naps[1] <= 2 and naps[3] == 0
    with Api(5, fail=lambda k: (502, {})) as api:
        with pytest.raises(paged.Throttled, match="502"):
            list(paged.pages({"url": api.url, "attempts": "3"}, sleep=naps.append))
        assert len(api.seen) == 3
    for code, kind in ((401, paged.PermissionRefused), (403, paged.PermissionRefused), (404, ValueError)):
        with Api(5, fail=lambda k, code=code: (code, {})) as api, pytest.raises(kind):
            list(paged.pages({"url": api.url}))
        assert len(api.seen) == 1
    with pytest.raises(paged.Throttled):
        list(paged.pages({"url": "http://127.0.0.1:9/x", "attempts": "2"}, sleep=naps.append))
    assert paged.retry_after("3") == 3 and paged.retry_after("soon") is None and paged.retry_after(None) is None
    assert 8 < paged.retry_after(email.utils.formatdate(110, usegmt=True), lambda: 100) < 11


def test_pages_are_kept_in_the_shared_folder(spark, tmp_path):
    from augur.sources.shared_files import read_bytes, write_bytes

    with Api(25) as api:
        options = {"url": api.url, "page_size": 10, "until_short": "true", "partitions": 3}
        for _ in range(2):
            assert ids(paged.scan(spark, cache="shared", **options)) == list(range(25))
        assert len(api.seen) == 5  # three pages and two ends; all from the cache at the second time
        assert ids(paged.scan(spark, cache=f"file:{tmp_path}/c", **options)) == list(range(25)) and len(api.seen) == 10
    path = paged.page_file(str(tmp_path / "c"), f"{api.url}?limit=10&offset=0")
    assert len(json.loads(read_bytes(path))) == 10
    write_bytes(path, b"[{")  # a page that was cut off is got again
    with pytest.raises(paged.Throttled):
        list(paged.pages({"url": api.url, "page_size": "10", "cache": str(tmp_path / "c"), "attempts": "1"}))
    found = spark.createDataFrame([(f"{api.url}?limit=10&offset=0", '[{"id": 7}]')], "url string, body string")
    assert paged.store_pages(found, str(tmp_path / "c")) == 1 and read_bytes(str(tmp_path / "none")) is None
    assert ids(paged.scan(spark, cache=str(tmp_path / "c"), url=api.url, page_size=10, until_short="true")) == [7]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# run\nname: x\ntraining:\n  seed: 3\n  lambda_invariance: 0.5\n  split: train\n  other: {}\n".replace("  other: {}\n", ""))
    c = config.load_config(str(tmp_path / "c.yaml"))
    assert c.seed == 3 and c.lambda_invariance == 0.5 and c.max_steps == 100
    assert config._plain("a: 1\nb:\n  c: yes it is\n  d: null\n") == {"a": 1, "b": {"c": "yes it is", "d": None}}


def test_report(spark):
    assert json.loads(files.report_json(spark.createDataFrame([(1, None)], "b int, a string")).first().value) == {"a": None, "b": 1}


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"id": i, "ts": f"2025-01-01T00:0{i % 3}:00"}) for i in ("0", "1", "0") for i in [int(i)]))
    rows = incremental.read_jsonl_stream(spark, str(src), "id string, ts timestamp")
    for _ in range(2):
        incremental.append_stream(incremental.first_seen(rows, "id", "ts"), out, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.json(out).collect()) == ["0", "1"]
    q = incremental.windowed_rates(rows).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rates").agg(F.max("n")).first()[0] == 3


def test_drop_templated_in_place(spark, tmp_path):
    lines = ['{"a": ["by {resolution_date}"]}', '{"{resolution_date}": 1}', "{broken {resolution_date}", '{"a": 1}', ""]
    path = tmp_path / "in.jsonl"
    assert tuple(files.drop_templated_in_place(spark, str(path)).first()) == (0, 0)
    path.write_text("\n".join(lines))
    for _ in range(2):  # the second run reads the original again
        assert tuple(files.drop_templated_in_place(spark, str(path)).first()) == (4, 1)
        assert [x.value for x in spark.read.text(str(path)).collect()] == lines[1:4]
        assert (tmp_path / "in.jsonl.bak").read_text() == "\n".join(lines)
    # a run that died before the end left only the original
    import shutil

    shutil.rmtree(path)
    assert tuple(files.drop_templated_in_place(spark, str(path)).first()) == (4, 1) and spark.read.text(str(path)).count() == 3


def test_cache_entries_of_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", json.dumps({"text": f"t{i}", "usage": {"input_tokens": i, "output_tokens": 1}})) for i in range(9)] + [("bad", "{broken")], "key string, body string")
    assert files.store_cache(rows.repartition(3), str(tmp_path / "c")) == 10
    assert {(r.key, r.response.text) for r in files.read_cache(spark, str(tmp_path / "c")).collect()} == {(f"k{i}", f"t{i}") for i in range(9)}


def odd_json(rng, depth=0):
    """A random JSON value with strings full of structure, quotes and backslashes."""
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", ":", "a", "é", " ", "\n", "questions"]) for _ in range(rng.randrange(9)))
    if kind == 2:
        return rng.choice([None, True, -1.5e3, 7])
    if kind == 3:
        return rng.choice([[], {}, ""])
    if kind < 6:
        return {f'k"{i}\\' if rng.random() < 0.5 else "questions": odd_json(rng, depth + 1) for i in range(rng.randrange(4))}
    return [odd_json(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_arrays_of_cut_documents(spark, tmp_path):
    """Cut at every few bytes, a document has the elements that it has as a whole."""
    import random

    from augur.sources import json_parts

    rng, want, heads = random.Random(8), {}, {}
    for i in range(12):
        items = [odd_json(rng) for _ in range(rng.randrange(12))]
        doc = items if i % 3 == 0 else {'odd"\\': odd_json(rng), "set": f'n"{i}', "other": [odd_json(rng) for _ in range(3)], "questions": items, "more": {"questions": [1, 2]}, "last": [[3]]}
        text = json.dumps(doc, ensure_ascii=i % 2 == 0, indent=None if i % 4 else 2)
        (tmp_path / f"{i}.json").write_text(text)
        want[f"{i}.json"] = items
        heads[f"{i}.json"] = {} if isinstance(doc, list) else {k: None if isinstance(v, list | dict) else v for k, v in doc.items()}
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "text.json").write_text('"questions"')
    for size in (7, 61, 1 << 20):
        rows = json_parts.read_array(spark, f"{tmp_path}/*.json", "questions", size).collect()
        got = {f: [json.loads(r.value) for r in sorted((r for r in rows if r.file.endswith("/" + f)), key=lambda r: (r.part, r.n))] for f in want}
        assert got == want and len(rows) == sum(map(len, want.values()))
        keys = json_parts.document_keys(spark, f"{tmp_path}/*.json", size).collect()
        for f, head in heads.items():
            assert {r.key: None if r.value is None else json.loads(r.value) for r in keys if r.file.endswith("/" + f)} == head
    assert json_parts.read_array(spark, f"{tmp_path}/none*.json", "questions").count() == 0


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    from augur.sources import json_parts

    with open(tmp_path / "big.json", "w") as f:
        f.write('{"question_set": "s", "questions": [')
        f.write(",".join(json.dumps({"id": i, "question": "x, [\"" * 40}) for i in range(60_000)))
        f.write("]}")
    rows = json_parts.read_array(spark, str(tmp_path / "big.json"), "questions", 1 << 20)
    n = rows.groupBy("part").count().collect()
    assert len(n) >= 16 and sum(r["count"] for r in n) == 60_000 and max(r["count"] for r in n) < 6_000
    assert rows.select(F.get_json_object("value", "$.id").alias("id")).distinct().count() == 60_000


def test_intermediate_tables_belong_to_calls(spark):
    from concurrent.futures import ThreadPoolExecutor

    from augur.sources import shared

    assert shared.shared_dir(spark).startswith("file:")
    kept = shared.written(spark.range(3))
    with shared.own_tables(spark) as outer:
        mine = shared.written(spark.range(4))
        with shared.own_tables(spark) as inner, ThreadPoolExecutor(1) as pool:
            other = pool.submit(lambda: shared.written(spark.range(5))).result()
            shared.written(spark.range(6))
            assert len(inner) == 1
        assert len(outer) == 1 and mine.count() == 4 and not files.exists(spark, inner[0])
    assert not files.exists(spark, outer[0]) and kept.count() == 3 and other.count() == 5
