import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import metrics as M
from tessella.operators.packing import exact_medians, next_fit, numbered, plan_shards
from tessella.operators.splitting import folds, holdout


def sample(seed=0, n=400):
    r = np.random.default_rng(seed)
    return r.integers(0, 2, n), np.round(r.random(n), 2)


def frame(spark, y, p):
    return spark.createDataFrame([("g", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "g string, i long, y int, p double")


def test_auc_equals_counting_pairs(spark):
    y, p = sample()
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    want = ((a > b).sum() + (a == b).sum() / 2) / (a.size * b.size)
    assert M.auc(frame(spark, y, p), ["g"], "y", "p").first().auc == pytest.approx(want)
    assert M.auc(frame(spark, y * 0, p), ["g"], "y", "p").first().auc is None


def test_threshold_grid_equals_comparing(spark):
    y, p = sample(1)
    for r in M.threshold_grid(frame(spark, y, p), ["g"], "y", "p").collect():
        assert (r.tp, r.fp) == (int(((p >= r.threshold) & (y == 1)).sum()), int(((p >= r.threshold) & (y == 0)).sum()))


def test_best_threshold_prefers_the_middle(spark):
    grid = spark.createDataFrame([("g", t, f) for t, f in ((0.1, 0.9), (0.4, 0.9), (0.6, 0.9), (0.5, 0.8))], "g string, threshold double, f1 double")
    assert M.best_threshold(grid, ["g"], "f1").first().threshold == 0.4


def test_pooling(spark):
    df = frame(spark, [1, 0, 1], [0.2, 0.9, 0.9])
    assert M.top_k_pool(df, ["g"], 2, "p").first().y_prob == 0.9
    assert M.top_k_pool(df, ["g"], 9, "p").first().y_prob == pytest.approx(2 / 3, abs=1e-6)
    w = np.exp((np.array([0.2, 0.9, 0.9]) - 0.9) / 0.1)
    assert M.attention_pool(df, ["g"], 0.1, "p").first().y_prob == pytest.approx(float((w * [0.2, 0.9, 0.9]).sum() / w.sum()), abs=1e-6)


def test_calibration_edges(spark):
    rows = M.calibration_bins(frame(spark, [0, 1, 1, 1], [0.0, 0.1, 0.30000000000000004, 1.0]), ["g"], "y", "p").collect()
    assert sorted((r.bin, r.n) for r in rows) == [(0, 1), (2, 1), (9, 1)]


def test_bootstrap_contains_the_estimate(spark):
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 300)
    df = frame(spark, y, np.clip(y * 0.2 + r.random(300) * 0.8, 0, 1)).withColumn("k", F.col("i").cast("string"))
    auc, ci = M.auc(df, ["g"], "y", "p").first().auc, M.bootstrap_auc(df, ["g"], "k", "y", "p", 60, 1).first()
    assert ci.low < auc < ci.high and ci.draws == 60 and ci.high - ci.low < 0.2


def test_splits_are_stratified_and_repeatable(spark):
    people = spark.createDataFrame([(f"p{i}", int(i % 4 == 0)) for i in range(100)], "k string, y int")
    held = holdout(people, "k", "y", 0.2, 3)
    assert {(r.y, r.n) for r in held.filter("held").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 15), (1, 5)}
    assert held.exceptAll(holdout(people.repartition(7), "k", "y", 0.2, 3)).isEmpty()
    assert {r.n for r in folds(people, "k", "y", 5, 3).groupBy("fold", "y").agg(F.count("*").alias("n")).collect()} == {15, 5}


def test_next_fit_streams_like_the_plain_fold(spark):
    r = np.random.default_rng(4)
    rows = [(g, i, int(r.integers(512, 6000))) for g in ("a", "b", None) for i in range(500)]
    got = plan_shards(spark.createDataFrame(rows, "g string, i long, b long"), "g", ["i"], "b", 20480).collect()
    for g in ("a", "b", None):
        part = sorted((x.i, x.b, x.shard_no) for x in got if x.g == g)
        assert [x[2] for x in part] == next_fit([x[1] for x in part], 20480)
    with pytest.raises(ValueError):
        next_fit([30000], 20480)


@pytest.mark.parametrize("value,grade", [("3", 3), (" ISUP 2 ", 2), ("Grade: 0", 0), ("grade=5", 5), ("4.0", 4), ("7", None), ("Gleason 8", None), ("", None), (None, None), ("3\n", 3), ("3+4", None)])
def test_strict_grades(spark, value, grade):
    assert spark.createDataFrame([(value,)], "v string").select(X.strict_grade(F.col("v")).alias("g")).first().g == grade


@pytest.mark.parametrize("value,lens", [("4", 4), ("10X", 10), ("20x", 20), ("40", 40), (" 10 ×", 10), ("40.0", 40), ("100", None), ("60x", None), ("unknown", None), (None, None)])
def test_strict_lenses(spark, value, lens):
    assert spark.createDataFrame([(value,)], "v string").select(X.strict_lens(F.col("v")).alias("g")).first().g == lens
    if lens is None:
        with pytest.raises(Exception, match="invalid lens"):
            spark.createDataFrame([(value,)], "v string").select(X.required(X.strict_lens(F.col("v")), F.col("v"), "lens")).collect()


def test_hashed_weights_are_poisson():
    w = M.hashed_weights(np.random.default_rng(8).integers(-(2**63), 2**63, 400), 1000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_digest_weights_are_poisson_and_those_of_the_text():
    w = M.digest_weights(np.array([f"p{i}" for i in range(400)]), 1000, 17)
    assert w.shape == (400, 1000) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    u = int(hashlib.md5(b"17|250|p3").hexdigest()[:8], 16) / 2**32
    assert w[3, 999] == sum(u >= s for s in M.POISSON_STEPS)


@pytest.mark.parametrize("rows", [7, 512])
def test_bootstrap_by_range_equals_plain_resampling(spark, rows):
    y, p = sample(9)
    p[:120] = 0.5  # a tie that spans reads
    df = frame(spark, y, p).unionByName(frame(spark, 1 - y, p).withColumn("g", F.lit(None).cast("string")))
    seeds = np.array([r.h for r in df.filter("g = 'g'").orderBy("i").select(F.xxhash64(F.lit(5), F.col("i")).alias("h")).collect()])
    w = M.hashed_weights(seeds, 200).astype(float)
    wins = (p[:, None] > p[None, :]) + (p[:, None] == p[None, :]) / 2
    aucs = [(a := w[:, d] * y) @ wins @ (b := w[:, d] * (1 - y)) / (a.sum() * b.sum()) for d in range(200)]
    got = {r.g: r for r in M.bootstrap_auc(df, ["g"], "i", "y", "p", 200, 5, rows=rows).collect()}
    assert got["g"].draws == 200 and len(got) == 2
    assert (got["g"].low, got["g"].high) == pytest.approx(tuple(np.quantile(aucs, [0.025, 0.975])))
    assert (got[None].low, got[None].high) == pytest.approx((1 - got["g"].high, 1 - got["g"].low))


def test_registered_intervals_have_the_draws_of_the_reference(spark):
    from tessella.plans.evaluation import REGISTRY

    for name in ("agg24_bootstrap_auc_ci", "agg24_patient_auc_ci", "agg24_tile_auc_ci"):
        got = REGISTRY.queries[name](spark, "/root/testdata/sf0.01").collect()
        assert got and all(990 <= r.draws <= 1000 and r.low < r.high for r in got)


def test_places_and_medians_over_ranges(spark):
    rng = np.random.default_rng(11)
    rows = [(g, float(v) if rng.random() < 0.9 else None) for g in (["a"] * 700 + ["b"] * 4 + ["c", None, None]) for v in [round(rng.random() * 50)]]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id()).repartition(7)
    got = {r.g: r["median"] for r in exact_medians(df, "g", "v").collect()}
    want = {g: np.median([v for h, v in rows if h == g and v is not None]) for g in {h for h, v in rows if v is not None}}
    assert got == pytest.approx(want)
    places = [r.position for r in numbered(df, ["g", "v", "id"]).orderBy("g", "v", "id").collect()]
    assert places == list(range(len(rows))) and numbered(df.limit(0), ["g"]).count() == 0
