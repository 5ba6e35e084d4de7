from fractions import Fraction
from math import ceil, floor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm.quotas import controlled_rounding, draw_quotas, feasible, max_flow, quota_report
from tessella.llm.sampling_queries import usable_images


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from([4, 10, 40, None]), st.integers(0, 5)), st.fractions(0, 50, max_denominator=40), min_size=1))
def test_every_margin_is_next_to_its_value(table):
    whole = controlled_rounding(table)
    near = lambda got, want: floor(want) <= got <= ceil(want)
    assert whole.keys() == table.keys() and all(near(whole[c], v) for c, v in table.items())
    for side in (0, 1):
        for key in {c[side] for c in table}:
            assert near(sum(v for c, v in whole.items() if c[side] == key), sum((v for c, v in table.items() if c[side] == key), Fraction(0)))
    assert near(sum(whole.values()), sum(table.values()))


CELLS = st.dictionaries(st.tuples(st.sampled_from([4, 10, 40]), st.integers(0, 4)), st.tuples(st.fractions(0, 30, max_denominator=20), st.integers(0, 8), st.integers(0, 60)), min_size=1)


@settings(max_examples=80, deadline=None)
@given(CELLS)
def test_minimum_supply_and_size_hold_together(cells):
    wanted, least, most = ({c: v[i] for c, v in cells.items()} for i in range(3))
    size = round(sum(wanted.values()))
    table = feasible(wanted, least, most, size)
    whole = controlled_rounding(table)
    low = {c: min(least[c], most[c]) for c in cells}
    assert all(low[c] <= whole[c] <= most[c] and low[c] <= table[c] <= most[c] for c in cells)
    assert sum(whole.values()) == max(sum(low.values()), min(size, sum(most.values())))
    if all(low[c] <= wanted[c] <= most[c] for c in cells) and sum(wanted.values()) == size:
        assert table == wanted


def test_max_flow_on_a_graph_with_a_detour():
    arcs = [[0, 1, 3], [0, 2, 2], [1, 2, 5], [1, 3, 2], [2, 3, 3], [3, 4, 9], [2, 4, 1]]
    flow = max_flow(arcs, 0, 4, 5)
    assert sum(f for f, (a, _, _) in zip(flow, arcs, strict=True) if a == 0) == 5
    assert all(0 <= f <= c for f, (_, _, c) in zip(flow, arcs, strict=True))


def usable(spark, counts):
    rows = [(f"{a}-{b}-{i}", a, b, 1) for (a, b), n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, a int, b int, quota int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "a int, b int, share double, least int")


@pytest.mark.parametrize("buckets", [2, 16, 4096])
def test_quotas_are_exact_and_repeatable(spark, buckets):
    have = usable(spark, {(1, 0): 700, (1, 1): 40, (2, 0): 3, (2, 1): 60, (3, 0): 50})
    report = quota_report(have, targets(spark, [(1, 0, 0.6, 3), (1, 1, 0.1, 3), (2, 0, 0.1, 3), (2, 1, 0.2, 3), (4, 4, 0.0, 2)]), "a", "b", "share", "least", (2, 5))
    got = {(r.a, r.b): r for r in report.collect()}
    assert got[1, 0].sample_size == 341 and sum(r.quota for r in got.values()) == 341
    assert {k: r.short for k, r in got.items() if not r.met} == {(2, 0): 32, (2, 1): 9, (4, 4): 2}
    assert got[2, 0].quota == 3 and got[2, 1].quota == 60 and got[1, 1].quota in (39, 40)
    drawn = draw_quotas(have, "id", "a", "b", report, buckets=buckets)
    assert {(r.a, r.b): r.n for r in drawn.groupBy("a", "b").agg(F.count("*").alias("n")).collect()} == {k: r.quota for k, r in got.items() if r.quota}
    again = draw_quotas(have.repartition(7), "id", "a", "b", report, buckets=4096)
    assert drawn.exceptAll(again).isEmpty() and drawn.select("id").distinct().count() == drawn.count()


def test_exact_shares_do_not_fail_by_rounding(spark):
    have = usable(spark, {(1, 0): 30, (1, 1): 970})
    report = quota_report(have, targets(spark, [(1, 0, 0.075, 0), (1, 1, 0.925, 0)]), "a", "b", "share", "least", (2, 5))
    assert all(r.met for r in report.collect())


def test_newest_row_decides(spark):
    rows = [(1, " im1 ", "3", "10X", "2024-01-01"), (2, "IM1", "7", "10X", "2024-01-02"), (3, "im2", "Gleason 8", "10", "2024-01-01"), (4, "IM2", "grade=5", "40×", "2024-01-03"), (5, None, "1", "4", "2024-01-01"), (6, " ", "1", "4", "2024-01-01"), (7, "im3", "1", "4X", None), (8, "im4", None, "4", "2024-01-01")]
    qc = spark.createDataFrame(rows, "row_no long, image_id string, isup_grade string, objective_lens string, t string").withColumn("ingested_at", F.to_timestamp("t"))
    assert sorted(tuple(r) for r in usable_images(qc).collect()) == [("IM2", 40, 5), ("IM3", 4, 1)]
