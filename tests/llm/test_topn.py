import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_upper
from tessella.llm import topn
from tessella.llm.topn import LoserTree, StoredRun, merged, store_runs, top_n
from tessella.operators.skew import hot_keys
from tessella.session import read
from tessella.sources import shared


class ListedRun:
    """A run in memory; counts how often it is passed over."""

    def __init__(self, rows):
        self.rows, self.at, self.seeks = rows, 0, 0

    def head(self):
        return self.rows[self.at] if self.at < len(self.rows) else None

    def advance(self):
        self.at += 1

    def seek_past(self, group):
        self.seeks += 1
        while self.head() is not None and self.head()[0] <= group:
            self.at += 1


@pytest.mark.parametrize("seed", range(20))
def test_merge_equals_sorting(seed):
    draw = random.Random(seed)
    runs = [sorted((draw.choice("abcd"), draw.randint(-9, 0) / 2, draw.randint(0, 99)) for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 9))]
    n = draw.choice([1, 3, 200])
    want = []
    for group in "abcd":
        best = sorted(x for r in runs for x in r if x[0] == group)[:n]
        want += [(group, -s, i, k + 1) for k, (_, s, i) in enumerate(best)]
    assert list(merged([ListedRun(r) for r in runs], n)) == want


def test_each_run_is_passed_over_at_most_once_a_group():
    runs = [ListedRun([("a", -x, k * 1000 + i) for i, x in enumerate(range(1000, 0, -1))] + [("b", -1.0, k)]) for k in range(5)]
    assert len(list(merged(runs, 5))) == 10 and [r.seeks for r in runs] == [1] * 5


def test_tree_of_one_and_of_empty_runs():
    assert LoserTree([None]).winner == 0 and LoserTree([]).heads == [None] and list(merged([ListedRun([])] * 3, 5)) == [] == list(merged([], 5))


def test_row_groups_between_are_not_read(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("g"), (F.col("id") >= 199_990).cast("int").cast("string")).alias("grp"), (-F.col("id")).cast("double").alias("score"), "id")
    rows.coalesce(1).sortWithinPartitions("grp", F.desc("score"), "id").write.option("parquet.block.size", 1 << 16).parquet(str(tmp_path / "run"))
    run = StoredRun(shared.listed(str(tmp_path / "run"), ".parquet")[0])
    assert [i for _, _, i, _ in merged([run], 5)] == [0, 1, 2, 3, 4, 199_990, 199_991, 199_992, 199_993, 199_994]
    assert run.file.num_row_groups > 8 and run.groups_read <= 3


def test_the_hot_patient_has_several_runs(spark):
    """At sf0.1 the tree has more than one run to merge for the patient with a tenth of the rows."""
    rows = read(spark, "/root/testdata/sf0.1", "patient_level_cv").filter("y_prob >= 0 AND y_prob <= 1")
    rows = rows.select(tidy_upper("patient_id").alias("grp"), F.col("tile_path").alias("item"), F.col("scored_at").alias("version"), F.col("y_prob").alias("score"), F.col("pred_no").alias("id")).filter("grp IS NOT NULL AND item IS NOT NULL")
    hot = rows.groupBy("grp").count().orderBy(F.desc("count")).first().grp
    folder, most = store_runs(rows, 4, 4096)
    stored = spark.read.parquet(folder)
    assert most >= 2 and stored.filter(F.col("grp") == hot).select("run").distinct().count() == most
    assert stored.groupBy("bucket", "run").agg(F.countDistinct("_metadata.file_path").alias("n")).filter("n > 1").isEmpty()


def test_against_plain_sorting(spark, monkeypatch):
    draw = random.Random(1)
    groups = ["hot"] * 6 + [f"g{i}" for i in range(40)] + [None]
    rows = [(i, draw.choice(groups), f"t{draw.randrange(400)}" if draw.random() < 0.97 else None, draw.randrange(5), draw.choice([None, float("nan"), *([round(draw.random(), 1)] * 8)]), 5) for i in range(6000)]
    rows += [(i + 10_000, *r[1:]) for i, r in enumerate(rows[:500])]
    df = spark.createDataFrame(rows, "id long, grp string, item string, version int, score double, run int")
    newest = {}
    for i, g, t, v, s, _ in rows:
        if g is not None and t is not None and s is not None and s == s and ((g, t) not in newest or (-v, i) < newest[g, t][0]):
            newest[g, t] = ((-v, i), s, i)
    want = {}
    for (g, _), (_, s, i) in newest.items():
        want.setdefault(g, []).append((-s, i))
    want = {g: [i for _, i in sorted(x)[:5]] for g, x in want.items()}
    for run_rows, fan_in in ((10, 128), (10, 2), (100, 3), (100_000, 128)):
        monkeypatch.setattr(topn, "hot_keys", lambda rows, keys, _, n=run_rows: hot_keys(rows, keys, n))
        got = {}
        for r in top_n(df, F.col("grp"), F.col("item"), F.col("version"), F.col("score"), F.col("id"), 5, run_rows, fan_in).orderBy("grp", "place").collect():
            got.setdefault(r.grp, []).append(r.id)
        assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, grp string, item string, version int, score double")
    assert top_n(df, F.col("grp"), F.col("item"), F.col("version"), F.col("score"), F.col("id"), 5).count() == 0
