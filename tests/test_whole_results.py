"""No row, fold, page or answer is lost, at any size of bucket."""

import json

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.operators import backtest, extract, ordered, regress, vectors
from tidemark.sources import corpora, feeds, tables


def test_every_cut_runs_in_buckets_without_a_single_partition(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7 % 5000).alias("at"))
    out = ordered.row_index(df, "at", cut=ordered.balanced(500))
    assert {r.ix for r in out.collect()} == set(range(5000))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ordered.BUCKET in plan
    # Only the few summary rows may meet in one task.
    for line in plan.splitlines():
        if "windowspecdefinition" in line and "unspecifiedframe" not in line:
            assert ordered.BUCKET in line


def test_a_crowded_instant_is_asked_once(spark):
    steps = spark.createDataFrame([(10, 1.0), (20, 2.0)], "t long, v double")
    grid = spark.range(3000).select(F.lit(15).cast("long").alias("t"), "id")
    got = ordered.step_lookup(steps, grid, "t", "v", cut=ordered.balanced(100))
    assert got.count() == 3000 and {r.v for r in got.select("v").distinct().collect()} == {1.0}


def _frame(spark, null_until):
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(i % 5) if i >= null_until else None, 2.0 * i) for i in range(60)]
    return spark.createDataFrame(rows, "ix long, t string, x double, y double").select(
        "ix", F.to_timestamp("t").alias("timestamp_utc"), "x", "y"
    )


def test_folds_without_a_fit_are_named_not_lost(spark):
    split = backtest.RollingOrigin(20, 5, 5)
    model = backtest.LinearModel("linear", ("x",))
    whole, _ = backtest.evaluate(model, _frame(spark, 0), split, "y")
    assert whole.count() == len(split.folds(60)) if hasattr(split.folds(60), "__len__") else whole.count() > 0
    with pytest.raises((SparkRuntimeException, PythonException), match="no prediction in fold 0"):
        backtest.evaluate(model, _frame(spark, 25), split, "y")[0].collect()


def test_a_group_without_complete_rows_keeps_its_place(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.5), ("b", None, 1.0)], "g string, x double, y double")
    fits = {r.g: r for r in regress.fit_ols(df, ["x"], "y", ["g"]).collect()}
    assert fits["b"].coefficients is None and fits["b"].n_obs == 0
    predicted = regress.apply_fit(df, regress.fit_ols(df, ["x"], "y", ["g"]), ["x"], ["g"])
    assert predicted.count() == 4


def test_a_robust_fit_that_does_not_settle_is_an_error(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(3 * x + rng.standard_t(1))) for x in rng.standard_normal(200)]
    with pytest.raises(regress.NotConverged):
        regress.fit_robust(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", "huber", iterations=1)


def _page(records, total, success=True):
    return json.dumps({"success": success, "result": {"records": records, "total": total}})


def test_pages_must_add_up_to_their_total(spark):
    def rows(*pages):
        df = spark.createDataFrame(list(pages), "r string, payload string")
        return feeds.paged_records(df, ("a",), resource="r").count()

    one, two = {"a": "1"}, {"a": "2"}
    assert rows(("p", _page([one], 2)), ("p", _page([two], 2)), ("q", _page([one], 1))) == 3
    for bad, message in (
        ([("p", _page([one], 2)), ("q", _page([one], 1))], "1 records received, total is 2"),
        ([("p", _page([], 500))], "no records"),
        ([("p", _page([], 0))], "no records"),
        ([("p", _page(None, 0))], "no records"),
        ([("p", _page([one], 1, False))], "success=false"),
    ):
        with pytest.raises(SparkRuntimeException, match=message):
            rows(*bad)
    with pytest.raises(SparkRuntimeException, match="no records in the page"):
        feeds.paged_records(spark.createDataFrame([(_page([], 3),)], "payload string"), ("a",)).count()


def test_one_bad_text_costs_only_itself():
    asked = []

    def answer(texts):
        asked.append(len(texts))
        if "bad" in texts:
            raise ValueError("bad")
        return [{"event_type": t} for t in texts]

    texts = [f"t{k}" for k in range(99)]
    texts.insert(41, "bad")
    got = extract._answers(answer, texts)
    assert [g and g["event_type"] for g in got] == [None if t == "bad" else t for t in texts]
    assert len(asked) < 20
    assert extract._answers(lambda t: [{}], ["a", "b", "c"]) == [{}, {}, {}]


def test_labels_without_a_message_count(spark):
    kinds = "mrid string, revision_number int, " + ", ".join(
        f"{f} {'double' if f == 'affected_capacity_mw' else 'timestamp' if f.startswith('effective') else 'string'}" for f in extract.FIELDS
    )
    row = [None if f.startswith("effective") or f == "affected_capacity_mw" else "x" for f in extract.FIELDS]
    labels = spark.createDataFrame([("a", 0, *row), ("b", 0, *row)], kinds)
    answers = labels.where("mrid = 'a'")
    totals = {r.field: (r.total, r.exact_match) for r in extract.agreement(extract.compare(labels, answers)).collect()}
    assert totals["event_type"] == (2, 1)


def test_equal_vectors_give_exactly_k_rows_a_batch(spark):
    corpus = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    matrix = np.array([[1.0, 2.0]])
    import pyarrow as pa

    score = vectors._score_batches(matrix, ["q"], 3, pa.string())
    out = corpus.mapInArrow(score, "query_id string, id long, score double")
    assert out.count() <= 3 * corpus.rdd.getNumPartitions()
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vector array<double>")
    assert [r.id for r in vectors.top_k(corpus, asked, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_many_questions_meet_the_corpus_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, 4)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asked = corpus.selectExpr("id as query_id", "vector")
    few = vectors.top_k(corpus, asked.where("query_id < 40"), 5).collect()
    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 16)
    monkeypatch.setattr(vectors, "LEAST_BLOCK", 50)
    many = vectors.top_k(corpus, asked, 5).where("query_id < 40").collect()
    assert sorted(few) == sorted(many)
    assert vectors.top_k(corpus, asked, 5).count() == 1500


def test_tiny_fractions_sample(spark):
    got = corpora.bernoulli_sample(spark.range(200_000), "id", 2e-5, 5).count()
    assert 0 < got < 20


def test_a_crash_between_key_and_vectors_never_serves_the_wrong_ones(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")

    def make(value):
        return lambda: spark.range(2).withColumn("v", F.lit(value))

    tables.cached_vectors(spark, path, "one", "m", make(1))
    real = tables.replace_table

    def crash(df, where, sort=()):
        if where.endswith("/key"):
            raise OSError("crash")
        return real(df, where, sort)

    monkeypatch.setattr(tables, "replace_table", crash)
    with pytest.raises(OSError, match="crash"):
        tables.cached_vectors(spark, path, "two", "m", make(2))
    monkeypatch.undo()
    got, hit = tables.cached_vectors(spark, path, "one", "m", make(1))
    assert not hit and {r.v for r in got.collect()} == {1}


def test_feature_hash_is_canonical_json(spark):
    import hashlib

    rows = [(0.0001, "é", 1), (1e-5, "a\"b\\\n\x01\x7f", 2), (1e16, "😀", 3), (1 / 3, None, 4), (-1.5e22, "", 5), (123456.0, "x", 6)]
    df = spark.createDataFrame(rows, "a double, b string, c long")
    got = [r[0] for r in df.select(textfn.feature_hash(["c", "a", "b"])).collect()]
    want = [hashlib.sha256(json.dumps({"a": a, "b": b, "c": c}).encode()).hexdigest()[:16] for a, b, c in rows]
    assert got == want
