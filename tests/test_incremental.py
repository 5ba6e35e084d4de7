import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.streaming import commits as C


def rows(spark, days):
    return spark.createDataFrame([(f"d{d}", i) for d in range(days) for i in range(3)], "unit string, v long")


def test_bounded_runs_advance_and_repeat_nothing(spark, tmp_path):
    data, log = str(tmp_path / "data"), str(tmp_path / "log")
    assert [C.process_waiting(spark, rows(spark, 5), "unit", data, log, 2) for _ in range(4)] == [2, 2, 1, 0]
    seen = C.visible(spark, data, log, "unit")
    assert seen.count() == 15 and seen.select("unit", "v").distinct().count() == 15
    assert C.process_waiting(spark, rows(spark, 7), "unit", data, log, 10) == 2


def test_data_without_a_commit_are_invisible(spark, tmp_path):
    data, log = str(tmp_path / "data"), str(tmp_path / "log")
    C.process_waiting(spark, rows(spark, 1), "unit", data, log, 5)
    rows(spark, 3).write.parquet(f"{data}/batch=9")
    assert C.visible(spark, data, log, "unit").count() == 3


def test_a_stream_handles_each_file_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    schema = T.StructType([T.StructField("v", T.LongType())])
    for i in range(3):
        spark.range(i, i + 1).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(source)
    run = lambda: C.run_available(spark, source, schema, str(tmp_path / "cp"), lambda b, n: seen.extend(r.v for r in b.collect()))
    assert run() == 3 and run() == 0 and sorted(seen) == [0, 1, 2]


def test_settings_lock(tmp_path):
    first = C.lock_settings(str(tmp_path / "run"), {"a": 1.5})
    assert C.lock_settings(str(tmp_path / "run"), {"a": 1.5}) == first
    with pytest.raises(ValueError):
        C.lock_settings(str(tmp_path / "run"), {"a": 2})


def test_assignments(spark):
    a = spark.createDataFrame([("p", "train")], "p string, s string")
    assert C.same_assignment(a, a) and not C.same_assignment(a, a.withColumn("s", F.lit("val")))
