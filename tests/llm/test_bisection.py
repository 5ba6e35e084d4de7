import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.bisection import counts_at, counts_below, exact_percentiles, readings

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
SCHEMA = "lens int, v double, day string, value string, cell int, grp string, field string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, d, "x", 1, "x", "x") for a, b, d in rows], SCHEMA)


def long(spark, rows):
    return readings(frame(spark, rows), "lens", ["v"], "day")


def cases():
    r = np.random.default_rng(0)
    yield 4, r.lognormal(0, 4, 700)
    yield 10, np.repeat([0.0, 0.25, 0.5], [300, 5, 100])
    yield 20, np.array([1e-300, 1e300, 1.0, 2.0, 5e-324, 0.0])
    yield 40, np.array([7.0])
    yield None, np.round(r.random(501), 1)


def test_exact_values(spark):
    rows = [(k, float(v), "d") for k, values in cases() for v in values]
    rows += [(4, None, "d"), (4, float("nan"), "d"), (10, -1.0, "d"), (99, None, "d")]
    got = {(r.grp, r.q): r for r in exact_percentiles(long(spark, rows), PROBS).collect()}
    assert len(got) == 5 * len(PROBS)
    for k, values in cases():
        for q in PROBS:
            place = q * (len(values) - 1)
            a, b = np.sort(values)[int(np.floor(place))], np.sort(values)[int(np.ceil(place))]
            r = got[k, q]
            assert r.n_values == len(values) and r.max_error == 0.0
            assert r.value == pytest.approx(a + (b - a) * (place - np.floor(place)), rel=1e-12)


def test_infinite_readings_are_values(spark):
    rows = [(1, v, "d") for v in (1.0, 2.0, float("inf"))]
    got = {r.q: r.value for r in exact_percentiles(long(spark, rows), [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 1.0: float("inf")}


def test_counts_of_parts_add_up(spark):
    rows = [(1, float(v % 97), f"d{v % 3}") for v in range(500)]
    readings_ = long(spark, rows)
    ends = readings_.groupBy("field", "grp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    whole = {r.cell: (r.n, r.vmin, r.vmax) for r in counts_below(readings_, ends, 16, 1).collect()}
    parts = counts_below(readings_, ends, 16, 1, by=("day",)).groupBy("cell").agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
    assert {r.cell: (r.n, r.vmin, r.vmax) for r in parts.collect()} == whole and sum(n for n, _, _ in whole.values()) == 500


def test_counts_of_days_give_the_same_percentiles(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.lognormal(3, 2, 3000), np.zeros(50)])
    rows = long(spark, [(1, float(v), f"d{i % 7}") for i, v in enumerate(values)])
    whole = {x.q: x.value for x in exact_percentiles(rows, PROBS).collect()}
    assert {x.q: x.value for x in exact_percentiles(rows, PROBS, by=("day",)).collect()} == whole
    assert whole == pytest.approx({q: float(np.quantile(values, q)) for q in PROBS})


def test_counts_at_percentiles_add_up_and_are_few(spark):
    values = [float(v % 211) for v in range(4000)]
    rows = long(spark, [(1 if i % 5 else None, v, f"d{i % 4}") for i, v in enumerate(values)])
    found = exact_percentiles(rows, PROBS)
    days = counts_at(rows, found, "day")
    assert days.count() == 4 * 2 * len(PROBS)
    sums = days.groupBy("grp", "q", "value").agg(F.sum("n_below").alias("a"), F.sum("n_upto").alias("b"), F.sum("n_values").alias("n")).collect()
    for s in sums:
        mine = [v for i, v in enumerate(values) if (i % 5 != 0) == (s.grp is not None)]
        assert (s.a, s.b, s.n) == (sum(v < s.value for v in mine), sum(v <= s.value for v in mine), len(mine)) and s.a <= s.q * (s.n - 1) + 1


def test_nothing_to_rank(spark):
    assert exact_percentiles(long(spark, [(1, None, "d")]), PROBS).count() == 0
