"""Exact quantiles, the clustered index, drift tables and robust fits against plain versions."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, diagnose, drift, quantiles, regress, smooth, vectors

# --- exact quantiles ---------------------------------------------------------------------------


def spiked_values(n):
    """Groups with ties, outliers, infinities, one value, and one that holds most rows."""
    rng = random.Random(n)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3 * n)]
    rows += [("ties", float(rng.randint(0, 3))) for _ in range(n)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(n)]
    rows += [("near", 1.0 + k * 2.0**-50) for k in range(n)]
    rows += [("odd", v) for v in (float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.5)]
    rows += [("one", 7.0), ("nan", float("nan")), ("nan", 1.0), ("nan", float("nan")), (None, 2.0), (None, 4.0)]
    return rows + [("hot", None), ("empty", None)]


def plain_quantile(values, p):
    values = sorted(values, key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0.0))
    at = p * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high else values[low] * (high - at) + values[high] * (at - low)


@pytest.mark.parametrize("small", [1, 50, 2048])
def test_quantiles_are_exact(spark, small):
    rows = spiked_values(400)
    levels = [0.0, 0.1, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", levels, small).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n_values == len(values)
        for p, q in zip(levels, got[g].q, strict=True):
            want = plain_quantile(values, p)
            assert q == want or (math.isnan(q) and math.isnan(want)) or q == pytest.approx(want, rel=1e-12)


def test_quantiles_of_no_group_and_of_nothing(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.quantiles(df, [], "v", [0.25]).first().q == [250.0]
    assert quantiles.quantiles(df.limit(0), [], "v", [0.25]).collect() == []
    with pytest.raises(ValueError, match="levels"):
        quantiles.quantiles(df, [], "v", [1.5])


def test_error_bands_have_no_buffer_of_values(spark):
    df = spark.createDataFrame([(h, float(k % 7)) for h in (1, 2) for k in range(100)], "horizon_h int, error double")
    band = diagnose.error_band(df)
    plan = band._jdf.queryExecution().toString()
    assert "percentile" not in plan
    assert {tuple(r) for r in band.collect()} == {(1, 0.0, 6.0), (2, 0.0, 6.0)}


def test_order_statistics_of_a_hot_group_read_few_values(spark, monkeypatch):
    """Narrowing leaves cells of a bounded number of values before any is put in order."""
    seen = []
    plain = quantiles._read_small
    monkeypatch.setattr(quantiles, "_read_small", lambda rows, cells: seen.append(cells.agg(F.max("n")).first()[0]) or plain(rows, cells))
    df = spark.range(60_000).select(F.lit("a").alias("g"), F.sin(F.col("id").cast("double")).alias("v"))
    quantiles.quantiles(df, ["g"], "v", [0.1, 0.9], small=100).collect()
    assert all(n is None or n <= 100 for n in seen) and any(n for n in seen)


# --- clustered index ---------------------------------------------------------------------------


def bunched(n, dim=16, bunches=6, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(bunches, dim))
    rows = middle[rng.integers(0, bunches, n)] + 0.15 * rng.normal(size=(n, dim))
    rows[:3] = 0.0
    rows[3:9] = rows[9]
    return [(int(k), row.astype("float32").tolist()) for k, row in enumerate(rows)]


def plain_top_k(rows, asked, k):
    x, q = (np.array([v for _, v in part], float) for part in (rows, asked))
    x, q = vectors._unit(x), vectors._unit(q)
    scores = np.round(q @ x.T, 6) + 0.0
    out = set()
    for i, (query_id, _) in enumerate(asked):
        order = sorted(range(len(rows)), key=lambda j: (-scores[i, j], rows[j][0]))[:k]
        out |= {(query_id, rows[j][0], scores[i, j], r + 1) for r, j in enumerate(order)}
    return out


ROWS = "id long, vector array<float>"
ASKED = "query_id long, vector array<float>"


def found_rows(found):
    return {(r.query_id, r.id, round(r.score, 6), r.rank) for r in found}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_clustered_search_is_exact(spark, tmp_path, k):
    rows = bunched(600)
    asked = [(100 + i, v) for i, (_, v) in enumerate(bunched(40, seed=3))] + [(1, rows[20][1])]
    index = clusters.build_index(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"))
    got = clusters.search(index, spark.createDataFrame(asked, ASKED), k).collect()
    assert found_rows(got) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(rows, asked, k)}


def test_bounds_skip_clusters_and_vectors(spark, tmp_path):
    rows = bunched(3000, bunches=30)[10:]
    asked = rows[::60]
    index = clusters.build_index(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"), clusters=30)
    got = clusters.search(index, spark.createDataFrame(asked, ASKED), 4).collect()
    assert found_rows(got) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(rows, asked, 4)}
    assert np.mean([r.vectors_read for r in got]) < 0.02 * len(rows)
    assert np.mean([r.clusters_read for r in got]) < 0.5 * 30


def test_appended_rows_are_found(spark, tmp_path):
    first, more = bunched(300), [(1000 + k, v) for k, v in bunched(200, bunches=9, seed=8)]
    index = clusters.build_index(spark.createDataFrame(first, ROWS), str(tmp_path / "index"))
    bigger = clusters.append_rows(index, spark.createDataFrame(more, ROWS))
    asked = [(k, v) for k, v in more[::10]]
    got = clusters.search(bigger, spark.createDataFrame(asked, ASKED), 3).collect()
    assert found_rows(got) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(first + more, asked, 3)}
    # The first index is as it was.
    old = clusters.search(index, spark.createDataFrame(asked, ASKED), 3).collect()
    assert found_rows(old) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(first, asked, 3)}


def test_large_clusters_are_searched_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "CODE_BLOCK", 40)
    monkeypatch.setattr(clusters, "QUERIES_PER_PASS", 8)
    rows = [(k, v) for k, v in bunched(500, bunches=2)]
    index = clusters.build_index(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"), clusters=2)
    asked = rows[::9]
    got = clusters.search(index, spark.createDataFrame(asked, ASKED), 4).collect()
    assert found_rows(got) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(rows, asked, 4)}


def test_questions_meet_the_centres_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    centres = vectors._unit(rng.normal(size=(400, 64)))
    index = clusters.ClusteredIndex(None, "", (), centres, np.full(400, 3.2), np.full(400, 500))
    asked = rng.normal(size=(10_000, 64)).astype("float32")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(10_000)), pa.array(list(asked)), pa.array(np.full(10_000, 0.9))], names=["query_id", "vector", "floor"]
    )
    tracemalloc.start()
    got = {True: 0, False: 0}
    for nearest in got:
        for out in clusters._asked_clusters(index, 4, nearest)([batch]):
            # A question's vector is copied once for each group of clusters, not for each cluster.
            assert out.num_rows <= vectors.QUERIES_PER_PASS * 25
            got[nearest] += sum(map(len, out.column("clusters").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {True: 10_000, False: 399 * 10_000}
    assert peak < 100e6


def test_every_vector_a_question_through_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "CODE_BLOCK", 90)
    monkeypatch.setattr(clusters, "QUESTION_BLOCK", 60)
    rows = bunched(400, bunches=3)
    index = clusters.build_index(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"), clusters=12)
    got = clusters.search(index, spark.createDataFrame(rows, ASKED), 4).collect()
    assert found_rows(got) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(rows, rows, 4)}


def test_index_refuses_what_it_cannot_hold(spark, tmp_path):
    with pytest.raises(ValueError, match="at least one row"):
        clusters.build_index(spark.createDataFrame([], ROWS), str(tmp_path / "none"))
    index = clusters.build_index(spark.createDataFrame(bunched(30), ROWS), str(tmp_path / "index"))
    for bad in ([1.0, 2.0], None):
        with pytest.raises(Exception, match="corpus 2, query 16|null in vector"):
            clusters.search(index, spark.createDataFrame([(1, bad)], ASKED), 1).collect()


# --- exact search by blocks ----------------------------------------------------------------------


@pytest.mark.parametrize("rows", [100_000, 1_000_000])
def test_blocks_copy_vectors_few_times(rows):
    blocks, q_blocks = vectors.block_counts(rows, rows, 100)
    assert rows / blocks <= 16384 and rows / q_blocks <= 16384
    # Once for each block of the other side: 400 and 3900 of them for a million questions with blocks of 256.
    assert rows * (blocks + q_blocks) <= rows * max(60, 2 * rows / 16384 + 2)


@pytest.mark.parametrize("k", [1, 4, 500])
def test_blocks_give_the_best_of_all(spark, monkeypatch, k):
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 150)
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 100)
    monkeypatch.setattr(vectors, "FIRST_ROWS", 20)
    # Many copies of one vector tie, and a third of a bunch nearly does.
    rows = bunched(420, bunches=3)
    rows += [(1000 + i, rows[30][1]) for i in range(60)]
    got = vectors.top_k(spark.createDataFrame(rows, ROWS), spark.createDataFrame(rows, ASKED), k).collect()
    assert found_rows(got) == {(q, i, round(float(s), 6), r) for q, i, s, r in plain_top_k(rows, rows, k)}


def test_a_block_of_copies_gives_the_smallest_ids():
    import pyarrow as pa

    unit = vectors._unit(np.tile(np.arange(1.0, 9.0), (3000, 1)))
    ids = pa.array(range(3000, 0, -1))
    r, q, scores = vectors._best_of_block(unit, unit[:300], ids, 3)
    assert {(int(a), ids[int(b)].as_py()) for a, b in zip(q, r, strict=True)} == {(a, b) for a in range(300) for b in (1, 2, 3)}
    assert (scores == 1.0).all()


# --- drift -------------------------------------------------------------------------------------


def drift_rows(seed):
    rng = random.Random(seed)
    ref = [("a", rng.gauss(0, 1)) for _ in range(700)] + [("b", float(rng.randint(0, 2))) for _ in range(300)]
    ref += [("c", 5.0)] * 50 + [("a", None), ("lone", 1.0)]
    cur = [("a", w, rng.gauss(w * 0.4, 1 + w)) for w in range(3) for _ in range(300)]
    cur += [("b", w, float(rng.randint(0, 3))) for w in (0, 1, None) for _ in range(90)]
    cur += [("c", 0, 5.0)] * 20 + [("c", 1, 6.0)] * 9 + [("new", 0, 1.0), ("a", 9, None)]
    return ref, cur


REF, CUR = "feature string, value double", "feature string, window int, value double"


def grouped(ref, cur):
    base, out = {}, {}
    for f, v in ref:
        if v is not None:
            base.setdefault(f, []).append(v)
    for f, w, v in cur:
        if v is not None and f in base:
            out.setdefault((f, w), []).append(v)
    return base, out


def test_distribution_drift(spark):
    ref, cur = drift_rows(1)
    got = {(r.feature, r.window): r for r in drift.distribution_drift(spark.createDataFrame(ref, REF), spark.createDataFrame(cur, CUR)).collect()}
    base, windows = grouped(ref, cur)
    assert set(got) == set(windows)
    for (f, w), values in windows.items():
        edges = sorted({plain_quantile(base[f], i / 10) for i in range(1, 10)})
        hist = [np.bincount(np.searchsorted(edges, np.array(v), "left"), minlength=len(edges) + 1) / len(v) for v in (base[f], values)]
        p, q = (np.maximum(h, drift.LEAST_SHARE) for h in hist)
        r = got[f, w]
        assert r.n == len(values)
        assert r.psi == pytest.approx(float(((q - p) * np.log(q / p)).sum()), abs=1e-9)
        assert r.overlap == pytest.approx(float(np.minimum(*hist).sum()), abs=1e-9)


@pytest.mark.parametrize("part_rows", [3, 100, 200_000])
def test_ks_distance(spark, part_rows):
    ref, cur = drift_rows(2)
    out = drift.ks_distance(spark.createDataFrame(ref, REF), spark.createDataFrame(cur, CUR), part_rows).collect()
    base, windows = grouped(ref, cur)
    assert {(r.feature, r.window) for r in out} == set(windows)
    for r in out:
        a, b = np.sort(base[r.feature]), np.sort(windows[r.feature, r.window])
        at = np.union1d(a, b)
        gap = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert (r.n, r.n_reference) == (len(b), len(a)) and r.ks == pytest.approx(gap, abs=1e-12)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rolling_error(spark, keys):
    rng = random.Random(3)
    start = datetime(2024, 2, 20)
    rows = []
    for _ in range(700):
        # Bursts, gaps of weeks, and instants on the edge of a frame.
        t = start + timedelta(days=rng.choice([0, 0, 1, 2, 30, 31, 95]), hours=rng.choice([0, 6, 23]), microseconds=rng.choice([0, 1, 5]))
        rows.append((rng.choice("xy"), t, rng.choice([None, rng.gauss(0, 3), rng.gauss(0, 3)])))
    df = spark.createDataFrame(rows, "k string, timestamp_utc timestamp, error double").drop(*({"k"} - set(keys)))
    got = {(r[0] if keys else "", r.timestamp_utc): r for r in drift.rolling_error(df, [1, 28, 90], keys).collect()}
    wanted = {(k if keys else "", t) for k, t, _ in rows}
    assert set(got) == wanted
    for k, t in wanted:
        for d in (1, 28, 90):
            e = [v for j, s, v in rows if v is not None and (not keys or j == k) and t - timedelta(days=d) < s <= t]
            r = got[k, t]
            assert r[f"n_{d}"] == len(e)
            if e:
                assert r[f"mae_{d}"] == pytest.approx(np.mean(np.abs(e)), rel=1e-9, abs=1e-9)
                assert r[f"rmse_{d}"] == pytest.approx(np.sqrt(np.mean(np.square(e))), rel=1e-6, abs=1e-6)
            else:
                assert r[f"mae_{d}"] is None and r[f"rmse_{d}"] is None


# --- robust fits -------------------------------------------------------------------------------


@pytest.mark.parametrize("loss", ["huber", "soft_l1", "cauchy"])
def test_robust_fit_needs_few_passes(spark, loss):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(size=(2, 900)) * [[1.0], [400.0]]
    y = 3000 + 50 * x1 - 2 * x2 + rng.standard_t(1.5, 900) * 200
    rows = [tuple(map(float, r)) for r in zip(x1, x2, y, strict=True)] + [(None, 1.0, 1.0), (1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    steps = regress.robust_steps(df, ["x1", "x2"], "y", loss)
    assert steps.passes <= (12 if loss != "cauchy" else 30) and steps.gradient <= 1e-8
    fit = regress.fit_robust(df, ["x1", "x2"], "y", loss)
    assert np.allclose(fit.first().coefficients, steps.coefficients, rtol=1e-5, atol=1e-4)
    complete = df.where("x1 is not null and y is not null")
    for r in regress.robust_gradient(complete, fit, ["x1", "x2"], "y", loss).collect():
        assert abs(r.gradient) < (1e-3 if r.parameter == "x2" else 1e-5)


def test_robust_fit_of_collinear_columns(spark):
    rows = [(float(k), 2.0 * k, 5.0 + 3 * k + (100.0 if k == 7 else 0.0)) for k in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    beta = regress.robust_steps(df, ["a", "b"], "y", "huber").coefficients
    assert beta[1] + 2 * beta[2] == pytest.approx(3.0, abs=0.02)


# --- local regression --------------------------------------------------------------------------


@pytest.mark.parametrize("by", [(), ("g",)])
def test_local_line(spark, by):
    rng = np.random.default_rng(6)
    x = rng.uniform(-4, 9, 500).round(2)
    g = rng.integers(0, 2, 500)
    y = np.sin(x) * 5 + g
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)] + [(0, None, 1.0), (1, 1.0, None)]
    got = smooth.local_line(spark.createDataFrame(rows, "g int, x double, y double"), "x", "y", 0.5, 2.0, 0.25, by).collect()
    for key in (0, 1) if by else (None,):
        mine = np.ones(500, bool) if key is None else g == key
        cells = np.floor(x[mine] / 0.25)
        points = np.arange(math.ceil(cells.min() * 0.25 / 0.5), math.floor((cells.max() + 1) * 0.25 / 0.5) + 1) * 0.5
        found = {r.x: r for r in got if key is None or r.g == key}
        assert set(found) == set(points)
        for p in points:
            d = np.abs((cells + 0.5) * 0.25 - p) / 2.0
            w = np.where(d < 1, (1 - np.minimum(d, 1) ** 3) ** 3, 0.0)
            slope, level = np.polyfit(x[mine], y[mine], 1, w=np.sqrt(w))
            assert found[p].fitted == pytest.approx(slope * p + level, abs=1e-6)
            assert found[p].rows_near == (d < 1).sum()


def test_local_line_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0, 3.0), (2.0, 5.0)], "x double, y double")
    rows = smooth.local_line(df, "x", "y").collect()
    assert [(r.x, r.fitted, r.slope) for r in rows] == [(2.0, 4.0, None)]
    assert smooth.local_line(df.limit(0), "x", "y").collect() == []
