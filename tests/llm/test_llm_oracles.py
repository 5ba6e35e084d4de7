"""Every query of the subpackage, against its SQL where there is one, on the smallest tables."""

import importlib

import duckdb
import pytest

from tessella.session import TABLES
from verify import rows_of

SF = "/root/testdata/sf0.001"
REGISTRIES = [importlib.import_module(f"tessella.llm.{m}_queries").REGISTRY for m in ("splits", "numeric", "sampling", "overlaps", "ranking", "text")]
QUERIES = {n: f for r in REGISTRIES for n, f in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        result = db.execute(SQL[name])
        assert have == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, tmp_path_factory, name):
    folder = tmp_path_factory.getbasetemp() / "empty"
    if not folder.exists():
        for t in TABLES:
            rows = spark.read.parquet(f"{SF}/{t}.parquet")
            (rows if t.endswith("_targets") else rows.limit(0)).write.parquet(str(folder / f"{t}.parquet"))
    rows = QUERIES[name](spark, str(folder)).collect()
    assert not rows or name.startswith(("p3", "p9"))
