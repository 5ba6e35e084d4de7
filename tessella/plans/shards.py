"""Queries of shards and releases: packing, numbering, totals, release invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as X
from tessella.functions.identifiers import file_of, tidy_path, tidy_upper
from tessella.operators.packing import numbered, plan_shards, prefix_committed
from tessella.plans.catalog import CURRENT, current
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

#: Cap of a shard in these queries.
CAP = 33_554_432
_TAR = r"regexp_extract(lower(trim(tar_name)), '([^/\\]+)$', 1)"


def _records(spark, sf_dir) -> DataFrame:
    rows = current(spark, sf_dir).filter("byte_size IS NOT NULL AND objective_lens IS NOT NULL")
    member = F.concat(F.lit("images/"), "image_id", F.lit(".tif"))
    return rows.select("objective_lens", "case_id", "image_id", X.tar_record_bytes(member, F.col("byte_size")).cast("long").alias("record_bytes"))


_NEXT_FIT = f"""WITH RECURSIVE r AS (SELECT objective_lens, image_id, CAST(512 + ceil(byte_size / 512) * 512 AS BIGINT) AS b, row_number() OVER (PARTITION BY objective_lens ORDER BY case_id, image_id) AS i FROM {CURRENT} WHERE byte_size IS NOT NULL AND objective_lens IS NOT NULL),
f(objective_lens, image_id, i, b, shard_no, filled) AS (SELECT objective_lens, image_id, i, b, 0::BIGINT, b FROM r WHERE i = 1
UNION ALL SELECT r.objective_lens, r.image_id, r.i, r.b, CASE WHEN CAST(ceil((f.filled + r.b + 1024) / 10240) * 10240 AS BIGINT) > {CAP} THEN f.shard_no + 1 ELSE f.shard_no END, CASE WHEN CAST(ceil((f.filled + r.b + 1024) / 10240) * 10240 AS BIGINT) > {CAP} THEN r.b ELSE f.filled + r.b END FROM f JOIN r ON r.objective_lens = f.objective_lens AND r.i = f.i + 1)"""


@query("win07_next_fit_shards", f"{_NEXT_FIT} SELECT objective_lens, image_id, shard_no FROM f")
def win07(spark, sf_dir):
    return plan_shards(_records(spark, sf_dir), "objective_lens", ["case_id", "image_id"], "record_bytes", CAP).select("objective_lens", "image_id", "shard_no")


@query("agg36_planned_bytes", f"{_NEXT_FIT} SELECT objective_lens, shard_no, count(*) AS n_images, CAST(ceil((sum(b) + 1024) / 10240) * 10240 AS BIGINT) AS archive_bytes FROM f GROUP BY 1, 2")
def agg36_planned(spark, sf_dir):
    """Archive bytes of each planned shard; none exceeds the cap."""
    planned = plan_shards(_records(spark, sf_dir), "objective_lens", ["case_id", "image_id"], "record_bytes", CAP)
    return planned.groupBy("objective_lens", "shard_no").agg(F.count("*").alias("n_images"), X.tar_bytes(F.sum("record_bytes")).cast("long").alias("archive_bytes"))


@query("agg36_shard_bytes", f"SELECT {_TAR} AS tar, count(DISTINCT member) AS n_members, CAST(sum(b) AS BIGINT) AS payload_bytes, CAST(ceil((sum(512 + ceil(b / 512) * 512) + 1024) / 10240) * 10240 AS BIGINT) AS archive_bytes FROM (SELECT tar_name, member, max(byte_size) AS b FROM (SELECT {_TAR} AS tar_name, member, byte_size FROM shards WHERE trim(tar_name) <> '' AND byte_size IS NOT NULL) GROUP BY 1, 2) GROUP BY 1")
def agg36(spark, sf_dir):
    each = read(spark, sf_dir, "shards").select(file_of(tidy_path("tar_name")).alias("tar"), "member", "byte_size").filter("tar IS NOT NULL AND byte_size IS NOT NULL").groupBy("tar", "member").agg(F.max("byte_size").alias("b"))
    return each.groupBy("tar").agg(F.count("*").alias("n_members"), F.sum("b").alias("payload_bytes"), X.tar_bytes(F.sum(X.tar_record_bytes(F.col("member"), F.col("b")))).cast("long").alias("archive_bytes"))


@query("win10_prefix_check", f"""WITH c AS (SELECT image_id, row_number() OVER (ORDER BY added_at, row_no) AS place FROM {CURRENT}), d AS (SELECT count(*) AS n_committed, coalesce(max(place), 0) AS reached FROM c WHERE image_id IN (SELECT upper(trim(image_id)) FROM shards WHERE trim(image_id) <> '')) SELECT *, n_committed = reached AS is_prefix FROM d""")
def win10(spark, sf_dir):
    """Whether what is packed is a prefix of the catalog in order of arrival.

    Positions come from counts per day and ranks within a day, not from one global sort.
    """
    rows = current(spark, sf_dir).select("image_id", "added_at", "row_no").withColumn("day", F.to_date("added_at"))
    days = rows.groupBy("day").count().withColumn("base", F.coalesce(F.sum("count").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("day", "base")
    local = rows.withColumn("k", F.row_number().over(W.partitionBy("day").orderBy("added_at", "row_no")))
    placed = local.join(days, local["day"].eqNullSafe(days["day"])).select("image_id", (F.col("base") + F.col("k")).alias("place"))
    done = read(spark, sf_dir, "shards").select(tidy_upper("image_id").alias("image_id")).filter("image_id IS NOT NULL")
    return prefix_committed(placed, done, "image_id", "place")


@query("win14_next_numbers", """WITH m AS (SELECT max(CAST(regexp_extract(lower(trim(shard_id)), '(\\d+)$', 1) AS BIGINT)) AS last FROM shards), p AS (SELECT DISTINCT upper(trim(image_id)) AS image_id FROM catalog_images WHERE trim(image_id) <> '' AND upper(trim(image_id)) NOT IN (SELECT upper(trim(image_id)) FROM shards WHERE trim(image_id) <> ''))
SELECT image_id, printf('shard-%09d', last + row_number() OVER (ORDER BY image_id)) AS shard_id FROM p, m""".replace("\\\\", "\\"))
def win14(spark, sf_dir):
    """Numbers for what is not packed yet, going on after the last one."""
    waiting = current(spark, sf_dir).select("image_id").join(read(spark, sf_dir, "shards").select(tidy_upper("image_id").alias("image_id")).filter("image_id IS NOT NULL"), "image_id", "left_anti")
    last = read(spark, sf_dir, "shards").agg(F.max(F.regexp_extract(F.trim("shard_id"), r"(\d+)\z", 1).cast("long")).alias("last"))
    placed = numbered(waiting, ["image_id"]).crossJoin(F.broadcast(last))
    return placed.select("image_id", F.format_string("shard-%09d", F.col("last") + F.col("position") + 1).alias("shard_id"))


@query("flt18_release_invariants", f"""WITH t AS (SELECT {_TAR} AS tar, min(lower(trim(shard_id))) AS shard_id, count(DISTINCT lower(trim(shard_id))) AS ids, count(*) - count(DISTINCT member) AS repeats, count(*) FILTER (byte_size IS NULL) AS unknown FROM shards WHERE trim(tar_name) <> '' GROUP BY 1)
SELECT tar, tar = shard_id || '.tar' AS name_ok, ids = 1 AS one_shard, repeats AS repeated_members, unknown AS unknown_sizes FROM t""")
def flt18(spark, sf_dir):
    rows = read(spark, sf_dir, "shards").select(file_of(tidy_path("tar_name")).alias("tar"), F.lower(F.trim("shard_id")).alias("shard_id"), "member", "byte_size").filter("tar IS NOT NULL")
    one = rows.groupBy("tar").agg(F.min("shard_id").alias("s"), F.countDistinct("shard_id").alias("ids"), (F.count("*") - F.countDistinct("member")).alias("repeated_members"), F.count_if(F.col("byte_size").isNull()).alias("unknown_sizes"))
    return one.select("tar", (F.col("tar") == F.concat("s", F.lit(".tar"))).alias("name_ok"), (F.col("ids") == 1).alias("one_shard"), "repeated_members", "unknown_sizes")
