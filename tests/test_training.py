import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import training
from tessella.operators.training import AdamW, Fit, head_scores, train_head


def rows(spark, seed=1, n=1200):
    """Patients of two classes whose vectors differ along one direction, a tenth of them positive."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        patient = int(rng.integers(0, 120))
        y = int(patient % 10 == 0)
        x = rng.normal(0, 1, 6) * 3 + 5
        x[2] += 4 * y
        out.append((i, f"p{patient}", y, x.tolist(), patient))
    return spark.createDataFrame(out, "i int, p string, y int, x array<double>, k int")


@pytest.fixture(scope="module")
def split(spark):
    df = rows(spark)
    return df.filter("k % 3 > 0"), df.filter("k % 3 = 0")


def test_a_separable_direction_is_found(spark, split, tmp_path):
    head, history = train_head(*split, "x", "y", "p", str(tmp_path), Fit(epochs=25, rate=0.1, patience=25))
    assert history[-1][3] > 0.95 and history[-1][1] < history[0][1] and np.abs(head["weights"][:-1]).argmax() == 2
    got = head_scores(split[1].withColumnRenamed("x", "v"), **head).groupBy("y").agg(F.avg("y_prob").alias("p")).collect()
    p = {r.y: r.p for r in got}
    assert p[1] > p[0] + 0.2


def test_an_interrupted_run_goes_on_and_ends_alike(spark, split, tmp_path, monkeypatch):
    fit = Fit(epochs=6, patience=9)
    whole = train_head(*split, "x", "y", "p", str(tmp_path / "a"), fit)
    calls, update = [], AdamW.update

    def failing(self, *args):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return update(self, *args)

    monkeypatch.setattr(AdamW, "update", failing)
    with pytest.raises(KeyboardInterrupt):
        train_head(*split, "x", "y", "p", str(tmp_path / "b"), fit)
    head, history = train_head(*split, "x", "y", "p", str(tmp_path / "b"), fit)
    assert [h[0] for h in history] == [1, 2, 3, 4, 5, 6] and len(calls) == 7
    assert np.allclose(history, whole[1]) and head["weights"] == pytest.approx(whole[0]["weights"])
    with pytest.raises(ValueError, match="other settings"):
        train_head(*split, "x", "y", "p", str(tmp_path / "b"), Fit(epochs=7))


def test_training_stops_when_nothing_improves(spark, split, tmp_path):
    _, history = train_head(*split, "x", "y", "p", str(tmp_path), Fit(epochs=40, patience=2, min_delta=0.5))
    assert len(history) == 3


def test_one_class_is_an_error_and_nulls_do_not_count(spark, split, tmp_path):
    with pytest.raises(ValueError, match="both classes"):
        train_head(split[0].filter("y = 0"), split[1], "x", "y", "p", str(tmp_path / "a"))
    with pytest.raises(ValueError, match="both classes"):
        train_head(split[0].limit(0), split[1], "x", "y", "p", str(tmp_path / "b"))
    odd = split[0].unionByName(spark.createDataFrame([(1, None, 1, [0.0] * 6, 0), (2, "p", None, [0.0] * 6, 0), (3, "p", 1, None, 0), (4, "p", 7, [9.9] * 6, 0)], split[0].schema))
    one = train_head(split[0], split[1], "x", "y", "p", str(tmp_path / "c"), Fit(epochs=2))
    got = train_head(odd, split[1], "x", "y", "p", str(tmp_path / "d"), Fit(epochs=2))
    assert np.allclose(got[1], one[1])


def test_steps_of_the_optimiser():
    step = AdamW(2, 0.1, 0.5).update(np.array([1.0, 1.0]), np.array([2.0, -3.0]))
    assert step == pytest.approx([1 * (1 - 0.05) - 0.1, 1 + 0.1], abs=1e-6) and training.Fit().seed == 42
