"""Problems 8, 9 and 10: token ids, mixing of sources, and texts that were cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_lower
from tessella.llm.cutoff import cut_texts
from tessella.llm.mixing import emitted, mix_rates
from tessella.llm.tokens import encode
from tessella.plans.registry import Registry
from tessella.session import cut_lineage, read

REGISTRY = Registry()
query = REGISTRY.query


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "ids")


#: Documents of one text of p8_joined.
BLOCK = 1_024


@query("p8_joined")
def p8_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of long texts: blocks of 1,024 consecutive documents, joined line by line; they go through chunks and stitching."""
    docs = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / BLOCK).alias("block"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("d"))
    joined = docs.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["text"]), "\n").alias("text"))
    return encode(cut_lineage(joined), "block", "text").select("block", "ids")


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of each document with a source in mix_targets, and the targets."""
    targets = read(spark, sf_dir, "mix_targets").select(tidy_lower("source").alias("source"), "target_weight", "max_repeats").filter("source IS NOT NULL")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", tidy_lower("source").alias("source"))
    return encode(docs.join(targets.select("source"), "source", "left_semi"), "doc_id", "text", ["source"], count=True), targets


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short of their weight even when repeated as often as allowed."""
    return mix_rates(*_sizes(spark, sf_dir)).filter("short").select("source")


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, one row for each use."""
    sizes, targets = _sizes(spark, sf_dir)
    sizes = cut_lineage(sizes)
    drawn = emitted(sizes, mix_rates(sizes, targets), "doc_id")
    return drawn.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("use"))


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, rates and the shares reached."""
    sizes, targets = _sizes(spark, sf_dir)
    sizes = cut_lineage(sizes)
    rates = mix_rates(sizes, targets)
    got = emitted(sizes, rates, "doc_id").groupBy("source").agg(F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"))
    both = rates.join(got, "source", "left").fillna(0, ["uses", "tokens_used"])
    total = both.agg(F.sum("tokens_used").alias("all_used"))
    return both.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens_used") / F.greatest(F.col("all_used"), F.lit(1))).drop("all_used")


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", tidy_lower("source").alias("source"))
    return cut_texts(docs, "doc_id", "text", "source").filter("cut").select("doc_id")


@query("p10_rates")
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cut texts and their share per source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", tidy_lower("source").alias("source"))
    scored = cut_texts(docs, "doc_id", "text", "source").groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.sum((F.col("cut") & F.col("at_limit")).cast("long")).alias("n_cut_at_limit"))
    return scored.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
