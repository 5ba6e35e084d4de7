"""Mixing sources to target weights of tokens, by capped repetition rates.

The tokens of each source are summed, the rate is what its target weight of all tokens
takes, at most its cap. Each document is emitted floor(rate) times, and once more with
the probability of the rest, decided by a hash of its id and the seed.

Defined cases: documents of sources without a target are left out; a source without
tokens has the rate 0 and falls short of any weight above 0; documents without tokens
are emitted like others and add nothing; a null or repeated target source is an error
of the caller. No documents give no rows, and a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, n_docs, tokens, wanted, rate, short).

    `sizes` has (source, n_tokens) of each document, `targets` (source, target_weight,
    max_repeats). Weights are exact decimals, so a source that just suffices is not short.
    """
    goals = targets.select("source", F.col("target_weight").cast("decimal(12,9)").alias("target_weight"), F.col("max_repeats").cast("long").alias("max_repeats"))
    each = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens").cast("long")).alias("tokens"))
    met = goals.join(each, "source", "left").select("source", "target_weight", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    total = met.agg(F.sum("tokens").alias("total"))
    wanted = F.col("target_weight") * F.col("total").cast("decimal(20,0)")
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), wanted.cast("double") / F.col("tokens"))).otherwise(0.0)
    short = (F.col("tokens") * F.col("max_repeats")).cast("decimal(29,9)") < wanted
    return met.crossJoin(F.broadcast(total)).select("source", F.col("target_weight").cast("double").alias("target_weight"), "max_repeats", "n_docs", "tokens", wanted.cast("double").alias("wanted"), rate.alias("rate"), short.alias("short"))


def emitted(docs: DataFrame, rates: DataFrame, number: str, seed: int = 0) -> DataFrame:
    """(number, source, n_tokens, copies) of the documents used at least once."""
    point = F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    copies = (whole + F.when(point < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return docs.join(rates.select("source", "rate"), "source").select(number, "source", "n_tokens", copies.alias("copies")).filter("copies > 0")
