"""The same results with extra columns of clashing names, and no failure on columns of nulls."""

import pytest
from pyspark.sql import functions as F

from tessella.session import TABLES
from test_llm_oracles import QUERIES, SF
from verify import rows_of

NAMES = ["n", "key", "rel", "run", "runs", "score", "u", "v", "m", "node", "component", "bucket", "l", "r", "start", "place", "prefix", "rest", "q", "lo", "hi", "cell", "grp", "field", "value", "ids", "piece", "k", "closed", "tail", "limits", "chars", "bytes", "p", "cut", "copies", "rate", "tokens", "quota", "free", "upto", "head", "slide", "patient", "folder", "image", "sha", "thumb", "others", "count", "version", "item", "day_", "split_", "source_"]
SMALL = [t for t in TABLES if t not in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with extra columns, and one where all but numbers of rows and targets are null."""
    root = tmp_path_factory.mktemp("odd")
    for t in SMALL:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        extra = rows.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in rows.columns])
        extra.write.parquet(str(root / "extra" / f"{t}.parquet"))
        keep = {"row_no", "tile_no", "pred_no", "doc_id"} if not t.endswith("_targets") else set(rows.columns)
        rows.select(*[F.col(c) if c in keep else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes]).write.parquet(str(root / "nulls" / f"{t}.parquet"))
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_change_nothing(spark, odd, name):
    want, have = QUERIES[name](spark, SF), QUERIES[name](spark, str(odd / "extra"))
    assert rows_of(have.columns, [tuple(r) for r in have.collect()]) == rows_of(want.columns, [tuple(r) for r in want.collect()])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_of_nulls(spark, odd, name):
    QUERIES[name](spark, str(odd / "nulls")).collect()
