"""Queries of incremental work, in terms of committed days of the event and shard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_upper
from tessella.plans.registry import Registry
from tessella.session import read
from tessella.streaming.commits import waiting

REGISTRY = Registry()
query = REGISTRY.query


@query("str01_release_progress", """SELECT lower(trim(shard_id)) AS shard_id, count(*) AS n_records, strftime(min(committed_at), '%Y-%m-%d %H:%M:%S.%f') AS first_commit, count(DISTINCT upper(trim(image_id))) AS n_images FROM shards GROUP BY 1""")
def str01(spark, sf_dir):
    return read(spark, sf_dir, "shards").groupBy(F.lower(F.trim("shard_id")).alias("shard_id")).agg(F.count("*").alias("n_records"), F.date_format(F.min("committed_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_commit"), F.countDistinct(F.upper(F.trim("image_id"))).alias("n_images"))


@query("str02_waiting_images", """SELECT DISTINCT upper(trim(image_id)) AS image_id FROM catalog_images WHERE trim(image_id) <> '' AND upper(trim(image_id)) NOT IN (SELECT upper(trim(image_id)) FROM processing WHERE trim(image_id) <> '')""")
def str02(spark, sf_dir):
    """Images without a processing commit."""
    units = read(spark, sf_dir, "catalog_images").select(tidy_upper("image_id").alias("image_id")).filter("image_id IS NOT NULL").distinct()
    done = read(spark, sf_dir, "processing").select(tidy_upper("image_id").alias("unit")).filter("unit IS NOT NULL")
    return waiting(units, done, "image_id")


@query("str03_next_batch", """SELECT DISTINCT upper(trim(image_id)) AS image_id FROM catalog_images WHERE trim(image_id) <> '' AND upper(trim(image_id)) NOT IN (SELECT upper(trim(image_id)) FROM processing WHERE trim(image_id) <> '') ORDER BY 1 LIMIT 25""")
def str03(spark, sf_dir):
    """The next 25 of them; the bound holds for new work only."""
    units = read(spark, sf_dir, "catalog_images").select(tidy_upper("image_id").alias("image_id")).filter("image_id IS NOT NULL").distinct()
    done = read(spark, sf_dir, "processing").select(tidy_upper("image_id").alias("unit")).filter("unit IS NOT NULL")
    return waiting(units, done, "image_id", 25)


@query("str08_release_state", """WITH t AS (SELECT count(DISTINCT upper(trim(c.image_id))) AS n_catalog, count(DISTINCT s.i) AS n_packed FROM catalog_images c LEFT JOIN (SELECT DISTINCT upper(trim(image_id)) AS i FROM shards) s ON s.i = upper(trim(c.image_id)) WHERE trim(c.image_id) <> '') SELECT *, CASE WHEN n_packed < n_catalog THEN 'partial' ELSE 'complete' END AS state FROM t""")
def str08(spark, sf_dir):
    """Whether everything in the catalog was packed; a partial release is for trials only."""
    ids = read(spark, sf_dir, "catalog_images").select(tidy_upper("image_id").alias("i")).filter("i IS NOT NULL").distinct()
    done = read(spark, sf_dir, "shards").select(tidy_upper("image_id").alias("i"), F.lit(1).alias("p")).filter("i IS NOT NULL").distinct()
    one = ids.join(done, "i", "left").agg(F.count("*").alias("n_catalog"), F.count("p").alias("n_packed"))
    return one.withColumn("state", F.when(F.col("n_packed") < F.col("n_catalog"), "partial").otherwise("complete"))


@query("agg_events_by_window", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def events_by_window(spark, sf_dir):
    """Tumbling days of the event stream; the same plan runs on a stream with a watermark."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
