"""Deterministic bounded shards by next fit, and the checks of a release.

Next fit is an ordered fold and cannot be split in general, but what it needs is small:
the records' sizes in order. They are folded per stratum (here a lens), and only the
first record of each shard leaves the fold; records find their shard by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.session import cut_lineage

#: Bytes of the closing blocks, and what an archive is padded to (fixed values).
CLOSING, RECORD = 1024, 10240


def archive_bytes(records: int) -> int:
    return -(-(records + CLOSING) // RECORD) * RECORD


def next_fit(sizes: list[int], cap: int) -> list[int]:
    """Shard numbers from 0 of record sizes in order; an item that fits no shard is an error."""
    shard, filled, out = 0, 0, []
    for size in sizes:
        if archive_bytes(size) > cap:
            raise ValueError(f"a record of {size} bytes exceeds the cap of {cap}")
        if filled and archive_bytes(filled + size) > cap:
            shard, filled = shard + 1, 0
        filled += size
        out.append(shard)
    return out


def _folded(batches: Iterator[pa.RecordBatch], stratum: str, size: str, cap: int) -> Iterator[pa.RecordBatch]:
    """Number the shards of a sorted stream, stratum by stratum, holding one number of state."""
    current, shard, filled = object(), 0, 0
    for batch in batches:
        groups = batch.column(batch.schema.get_field_index(stratum)).to_pylist()
        sizes = batch.column(batch.schema.get_field_index(size)).to_pylist()
        numbers = []
        for group, bytes_ in zip(groups, sizes, strict=True):
            if group != current:
                current, shard, filled = group, 0, 0
            if archive_bytes(bytes_) > cap:
                raise ValueError(f"a record of {bytes_} bytes exceeds the cap of {cap}")
            if filled and archive_bytes(filled + bytes_) > cap:
                shard, filled = shard + 1, 0
            filled += bytes_
            numbers.append(shard)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "shard_no"])


def plan_shards(records: DataFrame, stratum: str, order: list[str], size: str, cap: int) -> DataFrame:
    """`records` with shard_no: each stratum in its total order, shards of at most `cap` bytes.

    Strata are spread over tasks; each is sorted by the engine (which spills) and folded
    as a stream, so memory stays constant however long a stratum is.
    """
    sorted_ = records.repartition(stratum).sortWithinPartitions(stratum, *order)
    schema = T.StructType([*records.schema.fields, T.StructField("shard_no", T.LongType())])
    return sorted_.mapInArrow(lambda b: _folded(b, stratum, size, cap), schema)


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`rows` with their places from 0 in the order of some columns, which should be total.

    Rows are shuffled into ranges once and written to the checkpoint folder; a place is
    the number of rows in the ranges before, of which there are as many as partitions,
    plus the place in its range. So no task sees more than one range.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    ranges = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.select("__part", before.alias("__base"))
    place = F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, place).drop("__part", "__id", "__base")


def exact_medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the middle value of each group, or the mean of the two; nulls don't count.

    All values are ordered in ranges, so a group with most of them is in many tasks.
    """
    ordered = numbered(rows.select(by, value).filter(F.col(value).isNotNull()), [by, value])
    ends = ordered.groupBy(F.col(by).alias("__g")).agg(F.min("position").alias("__first"), F.count("*").alias("__n"))
    middle = ordered.join(ends, F.col(by).eqNullSafe(F.col("__g"))).withColumn("__at", F.col("position") - F.col("__first"))
    middle = middle.filter((F.col("__at") == F.floor((F.col("__n") - 1) / 2)) | (F.col("__at") == F.ceil((F.col("__n") - 1) / 2)))
    return middle.groupBy(by).agg(F.avg(value).alias("median"))


def prefix_committed(catalog: DataFrame, committed: DataFrame, key: str, position: str) -> DataFrame:
    """(n_committed, reached, is_prefix): whether the committed keys are the first ones of the catalog."""
    done = catalog.join(committed.select(key).distinct(), key, "left_semi")
    one = done.agg(F.count("*").alias("n_committed"), F.coalesce(F.max(position), F.lit(0)).alias("reached"))
    return one.withColumn("is_prefix", F.col("n_committed") == F.col("reached"))
