import random

import pytest

from tessella.llm.components import connected_components, group_pairs, placed, proportional_splits
from tessella.llm.splits_queries import SHARES, assigned, patient_ties
from pyspark.sql import functions as F


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed,nodes,edges", [(1, 60, 50), (2, 200, 120), (3, 30, 200)])
def test_random_graphs(spark, seed, nodes, edges):
    draw = random.Random(seed)
    pairs = [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)] + [(None, 3), (4, None), (5, 5)]
    pairs += pairs[:10]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == union_find(pairs)


def test_long_chain_and_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    hub = [("h0000", f"h{i:04d}") for i in range(1, 500)]
    got = connected_components(spark.createDataFrame(chain + hub, "a string, b string"), "a", "b")
    assert {(r.component, r.n) for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()} == {("c0000", 301), ("h0000", 500)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_pairs_of_groups(spark):
    members = spark.createDataFrame([("x", "c"), ("y", "c"), ("z", "c"), ("w", "d")], "n string, c string")
    assert sorted(tuple(r) for r in group_pairs(members, "n", "c").collect()) == [("x", "y"), ("x", "z"), ("y", "z")]


def test_ties_need_an_owner_on_both_sides(spark):
    owners = spark.createDataFrame([("s1", "p1"), ("s1", "p2"), ("s2", "p3"), ("s3", "p4"), ("s5", "p5")], "slide string, patient string")
    filed = spark.createDataFrame([("s2", "s3"), ("s5", "nobody"), ("nobody", "s3")], "slide string, folder string")
    got = {tuple(sorted((r.a, r.b))) for r in patient_ties(owners, filed).collect()}
    assert got == {("p1", "p2"), ("p3", "p4")}


def shares_of(df):
    n = df.count()
    return {r["split"]: r["count"] / n for r in df.groupBy("split").count().collect()}


def test_small_components_are_hashed_into_ranges(spark):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("c"), F.lit("x").alias("kind"))
    got = shares_of(proportional_splits(rows, "c", "kind", ["x"], {"train": 7, "val": 1.5, "test": 1.5}))
    assert all(abs(got[k] - v) < 0.01 for k, v in SHARES.items())


def test_large_components_do_not_spoil_the_shares(spark):
    """Components of 20, 12 and 8 % and of very different kinds, beside small ones."""
    n = 20_000
    part = F.when(F.col("id") < 4000, "a").when(F.col("id") < 6400, "b").when(F.col("id") < 8000, "c").otherwise(F.col("id").cast("string"))
    rows = spark.range(n).select(part.alias("c"), F.when(F.col("id") % 10 == 0, "tile").otherwise("slide").alias("kind"))
    for seed in range(3):
        got = proportional_splits(rows, "c", "kind", ["slide", "tile"], SHARES, seed)
        assert all(abs(shares_of(got)[k] - v) < 0.01 for k, v in SHARES.items())
        assert got.groupBy("c").agg(F.countDistinct("split").alias("k")).filter("k > 1").isEmpty()


def test_one_component_with_nearly_all_goes_where_most_is_wanted():
    known, rest = placed([("big", 95)], [100], SHARES)
    assert known == {"big": "train"} and rest == {"train": 0.0, "val": 0.5, "test": 0.5}


def test_no_records_to_split(spark):
    assert proportional_splits(spark.createDataFrame([], "c string, kind string"), "c", "kind", ["x"], SHARES).count() == 0


def test_shares_of_the_tables(spark):
    rows = assigned(spark, "/root/testdata/sf0.1")
    for kind in ("slide", "tile"):
        got = shares_of(rows.filter(F.col("record_kind") == kind))
        assert all(abs(got[k] - v) < 0.01 for k, v in SHARES.items()), got


def test_nothing_tied_is_parted(spark):
    sf = "/root/testdata/sf0.001"
    rows = assigned(spark, sf)
    assert rows.count() == sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("slide_patient_map", "tissue_detection"))
    tiles = spark.read.parquet(f"{sf}/tissue_detection.parquet").select(F.col("tile_no").alias("record_no"), F.upper(F.trim("slide_id")).alias("s")).filter("s <> ''")
    slides = spark.read.parquet(f"{sf}/slide_patient_map.parquet").select(F.col("row_no").alias("record_no"), F.upper(F.trim("slide_id")).alias("s"), F.upper(F.trim("patient_id")).alias("p"))
    both = tiles.join(rows.filter("record_kind = 'tile'"), "record_no").select("s", "split").unionByName(slides.join(rows.filter("record_kind = 'slide'"), "record_no").filter("s <> ''").select("s", "split"))
    assert both.groupBy("s").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    people = slides.join(rows.filter("record_kind = 'slide'"), "record_no").filter("p <> ''")
    assert people.groupBy("p").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
