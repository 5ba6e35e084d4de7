"""Rank-based and threshold metrics of predictions, per group, without global sorts.

Scores lie in [0, 1]. Cumulative counts are formed in two levels: sums of equal score
ranges (a bounded number a group), and running sums within each range. So no task sees
more than one range of one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Score ranges of the two-level sums.
RANGES = 1024
#: Digits to which mean scores are rounded before they are ranked, so that ties tie.
PLACES = 9


def running_sums(df: DataFrame, by: list[str], score: str, values: list[str], ranges: int = RANGES) -> DataFrame:
    """(*by, score, *values, *below_<value>): sums at each score and at all smaller ones."""
    each = df.groupBy(*by, score).agg(*[F.sum(v).alias(v) for v in values])
    each = each.withColumn("__range", F.least(F.floor(F.col(score) * ranges), F.lit(ranges - 1)).cast("int"))
    order = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = each.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    bases = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{v}").over(order), F.lit(0)).alias(f"__b_{v}") for v in values])
    inner = W.partitionBy(*by, "__range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    local = each.select(*by, "__range", score, *values, *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"__l_{v}") for v in values])
    joined = local.join(bases, [*by, "__range"])
    return joined.select(*by, score, *values, *[(F.col(f"__b_{v}") + F.col(f"__l_{v}")).alias(f"below_{v}") for v in values])


def auc(df: DataFrame, by: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """(*by, n_pos, n_neg, auc): Mann-Whitney with average ranks; null when one class is absent."""
    w = F.lit(1) if weight is None else weight
    marked = df.select(*by, F.col(score).alias("__s"), F.when(F.col(label) == 1, w).otherwise(0).alias("p"), F.when(F.col(label) == 0, w).otherwise(0).alias("n"))
    sums = running_sums(marked, by, "__s", ["p", "n"])
    out = sums.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2)).alias("u"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def confusion(label: str, predicted: Column) -> list[Column]:
    """Aggregates tp, tn, fp, fn."""
    y = F.col(label)
    return [F.count_if(cond).alias(name) for name, cond in (("tp", predicted & (y == 1)), ("tn", ~predicted & (y == 0)), ("fp", predicted & (y == 0)), ("fn", ~predicted & (y == 1)))]


def rates(counts: DataFrame) -> DataFrame:
    """Metrics from tp, tn, fp, fn; denominators of zero give 0, as the evaluation wants it."""
    one, tiny = F.lit(1), F.lit(1e-8)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumn("precision", tp / F.greatest(one, tp + fp)).withColumn("sensitivity", tp / F.greatest(one, tp + fn)).withColumn("specificity", tn / F.greatest(one, tn + fp))
    out = out.withColumn("accuracy", (tp + tn) / F.greatest(one, tp + tn + fp + fn))
    out = out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)
    return out.withColumn("f1", 2 * F.col("precision") * F.col("sensitivity") / F.greatest(tiny, F.col("precision") + F.col("sensitivity")))


def patient_labels(df: DataFrame, patient: str = "patient_id", label: str = "patient_label") -> DataFrame:
    """(patient, y_true): the greatest label over all rows, before any filter on them."""
    return df.groupBy(patient).agg(F.max(label).alias("y_true"))


def mean_pool(df: DataFrame, by: list[str], score: str = "y_prob") -> DataFrame:
    """(*by, y_prob, n_tiles): the rounded mean score."""
    return df.groupBy(*by).agg(F.round(F.avg(score), PLACES).alias("y_prob"), F.count("*").alias("n_tiles"))


def top_k_pool(df: DataFrame, by: list[str], k: int, score: str = "y_prob") -> DataFrame:
    """(*by, y_prob): the mean of the k greatest scores, or of all when there are fewer.

    Equal scores are interchangeable, so counts per score suffice: a group's rows are
    combined before the shuffle and only distinct scores are ordered.
    """
    each = df.groupBy(*by, score).agg(F.count("*").alias("n"))
    above = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.coalesce(F.sum("n").over(above), F.lit(0))))
    return each.withColumn("take", taken).filter("take > 0").groupBy(*by).agg(F.round(F.sum(F.col(score) * F.col("take")) / F.sum("take"), PLACES).alias("y_prob"))


def attention_pool(df: DataFrame, by: list[str], temperature: float, score: str = "y_prob") -> DataFrame:
    """(*by, y_prob): the mean weighted by the softmax of score / temperature (at least 1e-6).

    Scores are at most 1, so the shift by the maximum can be the constant 1 unless the
    temperature is tiny; the exact maximum comes from a first aggregate.
    """
    t = max(temperature, 1e-6)
    peak = df.groupBy(*by).agg(F.max(score).alias("__peak"))
    joined = df.select(*by, score).join(peak, by)
    w = F.exp((F.col(score) - F.col("__peak")) / t)
    return joined.groupBy(*by).agg(F.round(F.sum(w * F.col(score)) / F.sum(w), PLACES).alias("y_prob"))


def threshold_grid(df: DataFrame, by: list[str], label: str, score: str, steps: int = 100) -> DataFrame:
    """(*by, threshold, metrics) at i / steps for i = 0..steps.

    Rows are counted once per score cell; each threshold then sums cells at or above
    it, so nothing is multiplied by the number of thresholds but those counts.
    """
    step = 1.0 / steps
    cell = F.floor(F.col(score) / F.lit(step)).cast("int")
    # division may miss the product i * step by one; compare with the neighbours
    cell = F.when(F.col(score) >= (cell + 1) * F.lit(step), cell + 1).when(F.col(score) < cell * F.lit(step), cell - 1).otherwise(cell)
    counts = df.groupBy(*by, F.least(cell, F.lit(steps)).alias("cell")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    reach = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cell")))).groupBy(*by, "i").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    full = grid.join(reach, [*by, "i"], "left").fillna(0, ["tp", "fp"])
    full = full.withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp"))
    return rates(full.withColumn("threshold", F.col("i") * F.lit(step)).drop("i", "pos", "neg"))


def best_threshold(grid: DataFrame, by: list[str], metric: str) -> DataFrame:
    """The threshold with the best metric; ties go to the one nearest 0.5, then to the lower."""
    order = W.partitionBy(*by).orderBy(F.desc(F.round(metric, 12)), F.abs(F.col("threshold") - 0.5), "threshold")
    return grid.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def roc_points(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(*by, threshold, tpr, fpr) at 1.0, every score and 0.0."""
    marked = df.select(*by, F.col(score).alias("threshold"), F.when(F.col(label) == 1, 1).otherwise(0).alias("p"), F.when(F.col(label) == 0, 1).otherwise(0).alias("n"))
    ends = df.select(*by).distinct().withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).select(*by, "threshold", F.lit(0).alias("p"), F.lit(0).alias("n"))
    sums = running_sums(marked.unionByName(ends), by, "threshold", ["p", "n"])
    totals = marked.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    one = F.lit(1)
    return sums.join(totals, by).select(*by, "threshold", ((F.col("pos") - F.col("below_p")) / F.greatest(one, "pos")).alias("tpr"), ((F.col("neg") - F.col("below_n")) / F.greatest(one, "neg")).alias("fpr"))


def calibration_bins(df: DataFrame, by: list[str], label: str, score: str, bins: int = 10) -> DataFrame:
    """(*by, bin, mean_score, fraction_pos, n): right-closed bins; a score of 0 is in none."""
    inside = [F.when((F.col(score) > F.lit(i * (1.0 / bins))) & (F.col(score) <= (F.lit((i + 1) * (1.0 / bins)) if i + 1 < bins else F.lit(1.0))), i) for i in range(bins)]
    return df.withColumn("bin", F.coalesce(*inside)).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("fraction_pos"), F.count("*").alias("n"))


#: Cumulative probabilities of the Poisson distribution with mean 1.
POISSON_STEPS = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080, 0.99999887480]


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts of 32-bit random numbers."""
    out = np.zeros(u.shape, np.int64)
    for step in POISSON_STEPS:
        out += u >= step * 4294967296.0
    return out


def digest_weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(row, draw): Poisson(1) counts of draws 1 to `draws`, by MD5 of seed, draw // 4 and key; a digest serves four draws."""
    blocks = [f"{seed}|{b}|" for b in range(draws // 4 + 1)]
    data = b"".join(hashlib.md5((block + key).encode(), usedforsecurity=False).digest() for key in keys for block in blocks)
    return _poisson(np.frombuffer(data, dtype=">u4").reshape(len(keys), 4 * len(blocks))[:, 1 : draws + 1])


def hashed_weights(seeds: np.ndarray, draws: int) -> np.ndarray:
    """(row, draw): Poisson(1) counts by SplitMix64 from one 64-bit seed a row."""
    z = seeds.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _poisson(((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32))


class _RangeSums:
    """Per draw, of one score range whose rows come in score order: weights of both classes and twice their wins."""

    def __init__(self, draws: int) -> None:
        self.p, self.n, self.u = (np.zeros(draws, np.int64) for _ in range(3))
        self.tie, self.tie_p, self.tie_n = None, None, None

    def add(self, score: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        p = np.add.reduceat(weights * positive[:, None], starts, axis=0)
        n = np.add.reduceat(weights * ~positive[:, None], starts, axis=0)
        if self.tie == score[0]:  # the last score of the rows before goes on
            p[0] += self.tie_p
            n[0] += self.tie_n
        else:
            self.close()
        self._count(p[:-1], n[:-1])
        self.tie, self.tie_p, self.tie_n = score[-1], p[-1], n[-1]

    def _count(self, p: np.ndarray, n: np.ndarray) -> None:
        upto = np.cumsum(n, axis=0)
        self.u += (p * (2 * (self.n + upto - n) + n)).sum(axis=0)
        self.p += p.sum(axis=0)
        self.n += n.sum(axis=0)

    def close(self) -> None:
        if self.tie is not None:
            self._count(self.tie_p[None, :], self.tie_n[None, :])
            self.tie = None


def bootstrap_auc(df: DataFrame, by: list[str], key: str, label: str, score: str, draws: int, seed: int, alpha: float = 0.05, by_digest: bool = False, ranges: int = 256, rows: int = 512) -> DataFrame:
    """(*by, low, high, draws): percentile interval of the AUC over resamples.

    Rows are repeated Poisson(1) times in each draw, decided by hashes of the key (MD5
    with `by_digest`, as SQL can too), which needs no shared random stream and no lookup
    of rows by position. Draws of one class are left out. Rows are shuffled once, not
    once a draw: each score range is read in score order, at most `rows` of them at a
    time, with all draws as vectors, and gives its sums; draws are joined from those.
    """
    cell = F.least(F.floor(F.col(score) * ranges), F.lit(ranges - 1)).cast("int")
    marked = df.filter(F.col(label).isin(0, 1)).select(*by, cell.alias("__range"), F.col(score).cast("double").alias("__s"), (F.col(label) == 1).alias("__y"), (F.col(key).cast("string") if by_digest else F.xxhash64(F.lit(seed), F.col(key))).alias("__h"))
    order = [*by, "__range"]
    vectors = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("p", "n", "u")]
    schema = T.StructType([*[marked.schema[c] for c in order], *vectors])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, kinds = None, None, None

        def done() -> pa.RecordBatch:
            kept.close()
            keys = [pa.array([value], kind) for value, kind in zip(at, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, *[pa.array([v], pa.list_(pa.int64())) for v in (kept.p, kept.n, kept.u)]], schema.names)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in order]
            places = list(zip(*[batch.column(c).to_pylist() for c in order], strict=True))
            s, y, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__s", "__y", "__h"))
            low = 0
            while low < len(places):
                high = low + 1
                while high < min(len(places), low + rows) and places[high] == places[low]:
                    high += 1
                if places[low] != at:
                    if kept is not None:
                        yield done()
                    at, kept = places[low], _RangeSums(draws)
                kept.add(s[low:high], y[low:high].astype(bool), digest_weights(h[low:high], draws, seed) if by_digest else hashed_weights(h[low:high], draws))
                low = high
        if kept is not None:
            yield done()

    parts = marked.repartition(*order).sortWithinPartitions(*order, "__s").mapInArrow(sums, schema)
    each = parts.select(*order, F.posexplode(F.arrays_zip("p", "n", "u")).alias("draw", "v")).select(*order, "draw", "v.p", "v.n", "v.u")
    lower = W.partitionBy(*by, "draw").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("below", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    wins = F.sum(F.col("u") / 2 + F.col("p").cast("double") * F.col("below"))
    aucs = each.groupBy(*by, "draw").agg(F.sum("p").cast("double").alias("pos"), F.sum("n").cast("double").alias("neg"), wins.alias("wins")).filter("pos > 0 AND neg > 0").withColumn("auc", F.col("wins") / (F.col("pos") * F.col("neg")))
    return aucs.groupBy(*by).agg(F.expr(f"percentile(auc, {alpha / 2})").alias("low"), F.expr(f"percentile(auc, {1 - alpha / 2})").alias("high"), F.count("*").alias("draws"))
