"""Keys that hold too many rows for one task, as a list of proven size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut_lineage

#: Longest list of hot keys that is broadcast.
MOST = 50_000


def hot_keys(rows: DataFrame, keys: list[str], part_rows: int | Callable[[int], int], most: int = MOST) -> tuple[DataFrame, int]:
    """(*keys, parts) of the keys with more than `part_rows` rows, and the length of the list.

    Rows are counted with a partial aggregate; `part_rows` may depend on the number of all
    rows, then the counts are written first. The list is written once; when it has more
    than `most` keys it is cut to the largest ones, so that it can always be broadcast: a
    key left out has then at most rows / most rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    if callable(part_rows):
        counts = cut_lineage(counts)
        part_rows = part_rows(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = cut_lineage(counts.filter(F.col("n") > part_rows).select(*keys, F.ceil(F.col("n") / part_rows).cast("int").alias("parts")))
    n = hot.count()
    if n > most:
        hot, n = cut_lineage(hot.orderBy(F.desc("parts")).limit(most)), most
    return F.broadcast(hot), n


def dealt(rows: DataFrame, hot: tuple[DataFrame, int], keys: list[str], by: str, part: str = "part") -> DataFrame:
    """With `part`: 0, or for hot keys the part that the hash of column `by` falls into."""
    table, n = hot
    if not n:
        return rows.withColumn(part, F.lit(0))
    return rows.join(table, keys, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def copied(rows: DataFrame, hot: tuple[DataFrame, int], keys: list[str], part: str = "part") -> DataFrame:
    """With `part`: each row once for every part of its key."""
    table, n = hot
    if not n:
        return rows.withColumn(part, F.lit(0))
    return rows.join(table, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
