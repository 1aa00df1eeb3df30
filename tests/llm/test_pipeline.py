"""The pipeline's stages: what goes, what stays, and odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from augur.llm import decontam, secrets, simhash

SF = "/root/testdata/sf0.001"


def steps(spark, docs, tmp, until=4):
    out = [docs]
    for i, (_, f) in enumerate(cp.STAGES[:until]):
        f(spark, out[-1], SF).write.mode("overwrite").parquet(f"{tmp}/{i}")
        out.append(spark.read.parquet(f"{tmp}/{i}"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base = d.where("doc_id = 1").first().text
    more = [
        (9001, None, "en", "s", 0), (9002, "12 34 --", "en", "s", 8), (9003, base, "en", "s", 1), (9004, base + " tail", "en", "s", 1),
        (9005, " ".join(base.split()[:80]) + " " + bench, "en", "s", 1), (9006, "the of and in " + " ".join(base.split()[20:90]) + ' token = "0123456789abcdef0123456789abcdef"', "en", "s", 1),
    ]
    return d.unionByName(spark.createDataFrame(more, d.schema)).withColumns({c: F.lit("kept") for c in ("score", "secrets", "_row", "_t", "_base", "fp", "word", "row")})


def test_stages(spark, docs, tmp_path):
    out = steps(spark, docs, str(tmp_path))
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in out]
    assert all(o.columns == docs.columns for o in out)
    # language: only texts without letters go
    assert ids[0] - ids[1] == {9001, 9002}
    # near duplicates: exactly one row of each component stays, the smallest id
    groups = simhash.near_groups(out[1]).collect()
    assert ids[2] == {r.component_id for r in groups} and out[2].count() == len(ids[2]) and 9003 not in ids[2]
    # leaks: what the operator finds goes, and nothing else
    hit = {r.doc_id for r in decontam.contaminated(out[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert 9005 in hit and ids[2] - ids[3] == hit
    # secrets: all stay, spans are marked, other texts are untouched
    assert ids[4] == ids[3]
    before = {r.doc_id: r for r in out[3].collect()}
    found = {r.doc_id: r.secrets for r in secrets.scan(out[3]).collect()}
    for r in out[4].collect():
        if found[r.doc_id]:
            assert secrets.MARK in r.text and r.n_chars == len(r.text) and "0123456789abcdef0123456789abcdef" not in r.text
        else:
            assert r == before[r.doc_id]


def test_repeated_and_null_ids(spark, docs, tmp_path):
    rows = docs.where("doc_id < 30").select([F.when(F.col("doc_id") < 10, F.lit(None)).when(F.col("doc_id") < 20, F.lit(7)).otherwise(F.col("doc_id")).alias("doc_id"), *docs.columns[1:]])
    rows = rows.union(rows)
    out = steps(spark, rows, str(tmp_path), 3)
    assert out[2].count() == simhash.near_groups(out[1]).select("fingerprint").distinct().count()
    texts = [r.text for r in out[2].collect()]
    assert len(texts) == len(set(texts))


def test_empty(spark, docs, tmp_path):
    out = steps(spark, docs.limit(0), str(tmp_path))
    assert [o.count() for o in out] == [0] * 5
    assert cp.tokens(spark, out[-1], SF).count() == 0


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_queries_in_threads(spark):
    """Queries of one session at once leave each other's tables alone."""
    from concurrent.futures import ThreadPoolExecutor

    from augur.llm.queries import QUERIES
    from augur.plans import catalog

    calls = [cp.run, QUERIES["op7_simhash"], catalog.QUERIES["J6_fuzzy_pairs"]]
    go = lambda f: sorted(map(repr, f(spark, SF).collect()))
    alone = [go(f) for f in calls]
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(go, calls)) == alone
