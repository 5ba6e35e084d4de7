"""References to records that do not exist, judged at the time of the reference.

Keys are numbered by the digits they end with. The sorted numbers of the parents are
compressed into contiguous runs, within blocks of numbers; a reference is matched as of
its number to the run that starts at or before it, and leads nowhere when it is beyond
the run's end. Whether a number's own key was valid at the time is found in the same
pass, in the same way: a parent is valid over half-open intervals of whole microseconds,
the ticks of a key are compressed into runs, and a reference leads nowhere when its tick
is beyond the end of the run that starts at or before it.

Defined cases: a null or blank key is not a reference and is never reported. A parent
with a null key, a null start, or an end not after its start is valid never. A null
end means still valid. A reference without a time is judged at the end of all time.
Keys with equal numbers are told apart by their whole text. Repeated parents merge;
repeated references are each reported. Empty parents make every reference an orphan;
empty references give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.skew import copied, dealt, hot_keys

#: The tick after all others; runs without an end reach up to it.
FOREVER = (1 << 63) - 1
#: Intervals of one key are merged within blocks of this many ticks first (32 days).
BLOCK = 32 * 86_400_000_000
#: Runs of keys are formed within blocks of 2^10 numbers.
KEY_BITS = 10


@dataclass(frozen=True)
class Reference:
    """One column that refers to another table. Frames are reduced to the given columns."""

    table: str
    column: str
    records: DataFrame
    record_no: Column
    key: Column
    at: Column
    parents: DataFrame
    parent_key: Column
    valid_from: Column
    valid_to: Column | None = None


def _merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Join overlapping and touching [start, end) within each group of `keys`."""
    before = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    opened = intervals.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    numbered = opened.withColumn("run", F.sum("fresh").over(upto))
    return numbered.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def validity_runs(parents: DataFrame, key: Column, valid_from: Column, valid_to: Column | None = None) -> DataFrame:
    """(key, start, end): the contiguous runs of ticks at which a key is valid.

    Parents that are still valid shrink to their first start before any shuffle, and
    equal intervals to one, so a key with very many rows costs no more than others.
    """
    end = F.lit(FOREVER) if valid_to is None else F.coalesce(F.unix_micros(valid_to.cast("timestamp")), F.lit(FOREVER))
    ticks = parents.select(key.alias("key"), F.unix_micros(valid_from.cast("timestamp")).alias("start"), end.alias("end"))
    ticks = ticks.filter(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("start") < F.col("end")))
    firsts = ticks.filter(F.col("end") == FOREVER).groupBy("key").agg(F.min("start").alias("start")).withColumn("end", F.lit(FOREVER))
    if valid_to is None:
        return firsts
    closed = ticks.filter(F.col("end") < FOREVER).distinct().withColumn("block", F.floor(F.col("start") / BLOCK))
    return _merged(_merged(closed, ["key", "block"]).drop("block").unionByName(firsts), ["key"])


def key_number(key: Column) -> Column:
    """The number a key ends with, of up to 18 digits; of other keys a number by their hash."""
    digits = F.regexp_extract(key, r"(\d{1,18})\z", 1).try_cast("long")
    return F.coalesce(digits, F.pmod(F.xxhash64(key), F.lit(1 << 40)))


def key_runs(parents: DataFrame) -> DataFrame:
    """(rel, block, first, last): the contiguous runs of the numbers of `parents` (rel, number)."""
    each = parents.select("rel", F.shiftright("number", KEY_BITS).alias("block"), "number").distinct()
    place = F.row_number().over(W.partitionBy("rel", "block").orderBy("number"))
    return each.withColumn("run", F.col("number") - place).groupBy("rel", "block", "run").agg(F.min("number").alias("first"), F.max("number").alias("last")).drop("run")


def orphans(references: list[Reference], hot_rows: int = 50_000) -> DataFrame:
    """(table_name, column_name, record_no, at): references with no valid target.

    All columns go through one as-of pass over (number, key, tick), in which runs of
    numbers, runs of ticks and references are merged. A block of numbers with more than
    `hot_rows` references is split into as many parts as that takes, its runs being copied
    to each part; the list of such blocks is broadcast, see `hot_keys`.
    """
    block = F.shiftright("number", KEY_BITS).alias("block")
    refs = reduce(DataFrame.unionByName, [
        r.records.select(F.lit(i).alias("rel"), r.key.alias("key"), F.coalesce(F.unix_micros(r.at.cast("timestamp")), F.lit(FOREVER - 1)).alias("tick"), r.at.cast("timestamp").alias("at"), r.record_no.cast("long").alias("record_no"))
        for i, r in enumerate(references)
    ]).filter(F.col("key").isNotNull()).withColumn("number", key_number(F.col("key"))).select("*", block)
    ticks = reduce(DataFrame.unionByName, [
        validity_runs(r.parents, r.parent_key, r.valid_from, r.valid_to).withColumn("rel", F.lit(i)) for i, r in enumerate(references)
    ]).withColumn("number", key_number(F.col("key")))
    hot, at = hot_keys(refs, ["rel", "block"], hot_rows), ["rel", "block"]
    no_text, no_long = F.lit(None).cast("string"), F.lit(None).cast("long")
    runs = key_runs(ticks).select("rel", "block", F.col("first").alias("number"), no_text.alias("key"), no_long.alias("tick"), "last", no_long.alias("end"))
    runs = runs.unionByName(ticks.select("rel", block, "number", "key", F.col("start").alias("tick"), no_long.alias("last"), "end"))
    left = dealt(refs, hot, at, "record_no").select("rel", "block", "part", "number", "key", "tick", F.lit(1).alias("kind"), "record_no", "at", no_long.alias("last"), no_text.alias("of"), no_long.alias("end"))
    right = copied(runs, hot, at).select("rel", "block", "part", "number", "key", "tick", F.lit(0).alias("kind"), no_long.alias("record_no"), F.lit(None).cast("timestamp").alias("at"), "last", F.col("key").alias("of"), "end")
    asof = W.partitionBy("rel", "block", "part").orderBy("number", F.asc_nulls_first("key"), "tick", "kind").rowsBetween(W.unboundedPreceding, 0)
    run_last, of = F.last("last", ignorenulls=True).over(asof), F.last("of", ignorenulls=True).over(asof)
    seen = left.unionByName(right).select("rel", "number", "key", "tick", "kind", "record_no", "at", run_last.alias("last"), of.alias("of"), F.last("end", ignorenulls=True).over(asof).alias("end")).filter("kind = 1")
    beyond = F.col("last").isNull() | (F.col("number") > F.col("last"))
    invalid = ~F.col("of").eqNullSafe(F.col("key")) | (F.col("tick") >= F.col("end"))
    lost = seen.filter(beyond | invalid)
    names = F.array(*[F.struct(F.lit(r.table).alias("t"), F.lit(r.column).alias("c")) for r in references])
    named = F.element_at(names, F.col("rel") + 1)
    return lost.select(named["t"].alias("table_name"), named["c"].alias("column_name"), "record_no", "at")


def orphan_report(references: list[Reference], hot_rows: int = 50_000) -> DataFrame:
    """(table_name, column_name, month, n_references, n_orphans); month is null without a time."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    lost = orphans(references, hot_rows).groupBy("table_name", "column_name", month).agg(F.count("*").alias("n_orphans"))
    total = reduce(DataFrame.unionByName, [
        r.records.filter(r.key.isNotNull()).select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), r.at.cast("timestamp").alias("at"))
        for r in references
    ]).groupBy("table_name", "column_name", month).agg(F.count("*").alias("n_references"))
    a, b = total.alias("a"), lost.alias("b")
    on = (F.col("a.table_name") == F.col("b.table_name")) & (F.col("a.column_name") == F.col("b.column_name")) & F.col("a.month").eqNullSafe(F.col("b.month"))
    return a.join(b, on, "left").select("a.table_name", "a.column_name", "a.month", "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
