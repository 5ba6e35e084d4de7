import datetime as dt

from pyspark.sql import functions as F

from tessella.operators.references import FOREVER, Reference, orphan_report, orphans, validity_runs


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


PARENTS = "k string, a timestamp, b timestamp, n int, tick string"


def refs(spark, rows):
    return spark.createDataFrame(rows, "no long, k string, t timestamp, start string, rel int, part string")


def build(spark, parents, references):
    p, r = spark.createDataFrame(parents, PARENTS), refs(spark, references)
    return Reference("t", "c", r, F.col("no"), F.col("k"), F.col("t"), p, F.col("k"), F.col("a"), F.col("b"))


def found(reference, **options):
    return sorted(x.record_no for x in orphans([reference], **options).collect())


def test_runs_merge_overlapping_and_touching_intervals(spark):
    rows = [("x", at(1), at(3), 0, ""), ("x", at(3), at(5), 0, ""), ("x", at(2), at(4), 0, ""), ("x", at(8), at(9), 0, ""), ("x", at(8), at(9), 0, ""), ("y", at(4), None, 0, ""), ("y", at(2), None, 0, ""), ("z", at(5), at(5), 0, ""), (None, at(1), None, 0, ""), ("w", None, None, 0, "")]
    runs = validity_runs(spark.createDataFrame(rows, PARENTS), F.col("k"), F.col("a"), F.col("b"))
    hours = sorted((r.key, (r.start // 3_600_000_000) % 24, None if r.end == FOREVER else (r.end // 3_600_000_000) % 24) for r in runs.collect())
    assert hours == [("x", 1, 5), ("x", 8, 9), ("y", 2, None)]


def test_runs_across_blocks_merge(spark):
    rows = [("x", at(0), dt.datetime(2024, 6, 1), 0, ""), ("x", dt.datetime(2024, 5, 1), dt.datetime(2024, 9, 1), 0, ""), ("x", dt.datetime(2024, 9, 1), None, 0, "")]
    assert validity_runs(spark.createDataFrame(rows, PARENTS), F.col("k"), F.col("a"), F.col("b")).count() == 1


def test_half_open_intervals_nulls_and_unknown_keys(spark):
    parents = [("x", at(2), at(4), 0, "")]
    rows = [(1, "x", at(1)), (2, "x", at(2)), (3, "x", at(3)), (4, "x", at(4)), (5, "y", at(3)), (6, None, at(3)), (7, "x", None), (8, "x", at(1)), (8, "x", at(1))]
    assert found(build(spark, parents, [(*r, "", 0, "") for r in rows])) == [1, 4, 5, 7, 8, 8]


def test_hot_keys_give_the_same_result(spark):
    parents = [("hot", at(h), at(h + 1), 0, "") for h in range(0, 20, 2)] + [("cold", at(3), None, 0, "")]
    rows = [(i, "hot" if i % 3 else "cold", at(i % 20), "", 0, "") for i in range(600)]
    one = build(spark, parents, rows)
    want = [i for i in range(600) if ((i % 20) % 2 if i % 3 else (i % 20) < 3)]
    assert found(one) == found(one, hot_rows=7) == want


def test_empty_sides(spark):
    assert found(build(spark, [], [(1, "x", at(1), "", 0, "")])) == [1]
    assert found(build(spark, [("x", at(1), None, 0, "")], [])) == []


def test_report_counts_months_and_missing_times(spark):
    rows = [(1, "x", at(1), "", 0, ""), (2, "x", dt.datetime(2024, 2, 1), "", 0, ""), (3, "x", None, "", 0, "")]
    report = orphan_report([build(spark, [("x", at(5), None, 0, "")], rows)]).collect()
    assert sorted((r.month or "", r.n_references, r.n_orphans) for r in report) == [("", 1, 0), ("2024-01", 1, 1), ("2024-02", 1, 0)]
