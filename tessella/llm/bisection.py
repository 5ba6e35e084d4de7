"""Percentiles of very large columns by exact bisection, and summaries that combine.

For every (field, group, percentile) an interval of values is kept that surely holds
the wanted rank. A pass counts the rows below the midpoints of all intervals at once
and keeps the part with the rank, drawn in to the values that occur there. The counts
are sums, so those of partitions or days can be added. It ends when each interval is
one value, that is, with error 0. `combined` adds counts of days at shared midpoints.

Defined cases: null values never count, NaN and negative ones are dropped by `readings`;
a null group is a group of its own; a group without values has no row. Percentiles
between two ranks are interpolated linearly, as `quantile_cont` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.session import cut_lineage

#: Intervals up to this number are broadcast (a row has some 60 bytes); beyond it they are joined by shuffle.
BROADCAST_INTERVALS = 50_000


def readings(df: DataFrame, group: str, fields: list[str], *keep: str) -> DataFrame:
    """(field, grp, value, *keep): one row for each reading that counts."""
    stack = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in fields)
    long = df.select(F.col(group).alias("grp"), *keep, F.expr(f"stack({len(fields)}, {stack}) AS (field, value)"))
    return long.filter("value IS NOT NULL AND NOT isnan(value) AND value >= 0").select("field", "grp", F.expr("value + 0.0e0").alias("value"), *keep)


def _same(a: str, b: str):
    return (F.col(f"{a}.field") == F.col(f"{b}.field")) & F.col(f"{a}.grp").eqNullSafe(F.col(f"{b}.grp"))


def counts_below(long: DataFrame, intervals: DataFrame, fanout: int, n_intervals: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, field, grp, lo, hi, cell, n, vmin, vmax): rows between neighbouring midpoints.

    `cell` numbers the parts into which fanout - 1 equidistant midpoints cut [lo, hi].
    Rows of different days or partitions are combined by adding n and taking the least
    vmin and greatest vmax.
    """
    side = intervals.alias("i")
    if n_intervals <= BROADCAST_INTERVALS:
        side = F.broadcast(side)
    rows = long.alias("r").join(side, _same("r", "i") & (F.col("r.value") >= F.col("i.lo")) & (F.col("r.value") <= F.col("i.hi")))
    place = F.floor((F.col("r.value") - F.col("i.lo")) / (F.col("i.hi") - F.col("i.lo")) * fanout).cast("int")
    cell = F.when(F.col("r.value") >= F.col("i.hi"), fanout - 1).when(F.col("i.hi") == float("inf"), 0).otherwise(F.least(place, F.lit(fanout - 2)))
    keys = [*[F.col(f"r.{b}") for b in by], F.col("i.field"), F.col("i.grp"), F.col("i.lo"), F.col("i.hi")]
    return rows.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"), F.min("r.value").alias("vmin"), F.max("r.value").alias("vmax"))


def exact_percentiles(long: DataFrame, probs: list[float], fanout: int = 256, max_passes: int = 400, by: tuple[str, ...] = ()) -> DataFrame:
    """(field, grp, q, n_values, value, max_error) over the rows of `readings`.

    One pass narrows each interval to a 255th or to the values in it, whichever is
    less; most columns take three or four passes, each a scan with a partial aggregate
    and no shuffle of rows. Midpoints of one pass are shared by all percentiles. With
    `by`, such as a day, each pass first makes the counts of every day between the
    shared midpoints, and these are added up: no row is looked at across days.
    """
    bounds = long.groupBy("field", "grp").agg(F.count("*").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ask = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    state = bounds.select("field", "grp", "n_values", "lo", "hi", ask).withColumn("place", F.col("q") * (F.col("n_values") - 1))
    end = F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")
    state = cut_lineage(state.select("field", "grp", "n_values", "q", "place", end, "lo", "hi", F.lit(0).cast("long").alias("below")).distinct())
    for _ in range(max_passes):
        active = state.filter("lo < hi")
        intervals = active.select("field", "grp", "lo", "hi").distinct()
        n = intervals.count()
        if n == 0:
            break
        cells = counts_below(long, intervals, fanout, n, by)
        if by:
            cells = combined(cells)
        upto = W.partitionBy("field", "grp", "lo", "hi").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
        cells = cells.withColumn("upto", F.sum("n").over(upto)).alias("c")
        rank = F.col("s.rank") - F.col("s.below")
        on = _same("s", "c") & (F.col("s.lo") == F.col("c.lo")) & (F.col("s.hi") == F.col("c.hi")) & (rank < F.col("c.upto")) & (rank >= F.col("c.upto") - F.col("c.n"))
        moved = active.alias("s").join(cells, on).select("s.field", "s.grp", "s.n_values", "s.q", "s.place", "s.rank", F.col("c.vmin").alias("lo"), F.col("c.vmax").alias("hi"), (F.col("s.below") + F.col("c.upto") - F.col("c.n")).alias("below"))
        state = cut_lineage(state.filter("lo >= hi").unionByName(moved))
    else:
        raise RuntimeError(f"percentiles did not settle in {max_passes} passes")
    low, high = F.min_by("lo", "rank"), F.max_by("lo", "rank")
    out = state.groupBy("field", "grp", "q", "n_values", "place").agg(low.alias("a"), high.alias("b"))
    part = F.col("place") - F.floor("place")
    return out.select("field", "grp", "q", "n_values", F.when(part == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part).alias("value"), F.lit(0.0).alias("max_error"))


def combined(cells: DataFrame) -> DataFrame:
    """Counts between the same midpoints, of several days or partitions, as one."""
    return cells.groupBy("field", "grp", "lo", "hi", "cell").agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def counts_at(long: DataFrame, percentiles: DataFrame, by: str) -> DataFrame:
    """(by, field, grp, q, value, n_below, n_upto, n_values): how a day's values lie to the percentiles of all.

    Counts of several days add up: the value is the percentile of any set of days for
    whose sums n_below <= rank < n_upto holds. One row a day, field, group and
    percentile, however many values there are. `percentiles` is broadcast up to
    BROADCAST_INTERVALS rows.
    """
    points = percentiles.select("field", "grp", "q", "value")
    points = F.broadcast(points) if points.count() <= BROADCAST_INTERVALS else points
    rows = long.alias("r").join(points.alias("p"), _same("r", "p"))
    below, upto = F.count_if(F.col("r.value") < F.col("p.value")), F.count_if(F.col("r.value") <= F.col("p.value"))
    return rows.groupBy(F.col(f"r.{by}"), F.col("p.field"), F.col("p.grp"), F.col("p.q"), F.col("p.value")).agg(below.alias("n_below"), upto.alias("n_upto"), F.count("*").alias("n_values"))
