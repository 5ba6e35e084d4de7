"""Problem 6: the same or almost the same images in training and evaluation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_lower, tidy_upper
from tessella.llm.suffixes import BROADCAST_KEYS, coverage, digest_of, near_digests, shared_spans, turned_digests
from tessella.plans.registry import Registry
from tessella.session import cut_lineage, read

REGISTRY = Registry()
query = REGISTRY.query

#: Bits in which the thumbnails of two images may differ.
BITS = 3


def patient_splits(rows: DataFrame) -> DataFrame:
    """(patient, split): by each patient's newest row."""
    tidy = rows.select(tidy_upper("patient_id").alias("patient"), F.struct("assigned_at", "row_no", tidy_lower("split").alias("split")).alias("row")).filter("patient IS NOT NULL")
    return tidy.groupBy("patient").agg(F.max("row").alias("row")).select("patient", F.col("row.split").alias("split"))


def _digest(column: str) -> Column:
    digest = tidy_lower(column)
    return F.when(F.ltrim(digest, F.lit("0")) != "", digest)


def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, left, split, source, sha, thumb, others): left in train, else in val or test; the rest is out."""
    splits = cut_lineage(patient_splits(read(spark, sf_dir, "patient_level_split")).filter("split IN ('train', 'val', 'test')"))
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_KEYS else splits
    rows = read(spark, sf_dir, "processing").select(tidy_upper("image_id").alias("image"), tidy_upper("patient_id").alias("patient"), tidy_lower("source_id").alias("source"), _digest("source_sha256").alias("sha"), _digest("thumb_hash").alias("thumb"), F.col("duplicate_source_image_ids").alias("others"))
    return rows.filter("image IS NOT NULL").join(splits, "patient").select("image", (F.col("split") == "train").alias("left"), "split", "source", "sha", "thumb", "others")


#: Places in the suffix array beyond those of thumbnail digests: texts that must agree as a whole.
SHA, NAMED, ODD_THUMB = 100, 101, 102
#: Bytes of a text that must agree as a whole; of a longer one its SHA-256 stands for it.
LONGEST = 64
_HEX = r"\A[0-9a-f]{32}\z"


def image_suffixes(facts: DataFrame) -> DataFrame:
    """(place, suffix, left, id, least, role) of all that tells images to be alike, in one pass over them.

    Thumbnail digests give a suffix at each place where a common span may start. Of
    other texts only the whole counts: digests of the bytes, the ids of images (role
    `own`) and the ids that an image lists (role `list`), thumbnails that are no digests.
    """
    def entry(place: int, suffix: Column, least: Column | None = None, role: str = "own") -> Column:
        suffix = suffix if least is not None else F.when(F.length(suffix) <= LONGEST, suffix).otherwise(F.unhex(F.sha2(suffix, 256)))
        return F.struct(F.lit(place).alias("place"), suffix.alias("suffix"), (F.length(suffix) if least is None else least).alias("least"), F.lit(role).alias("role"))

    coded = facts.withColumn("__thumb", F.when(F.length("thumb") == 32, F.unhex("thumb"))).withColumn("__sha", F.coalesce(F.when(F.length("sha") == 64, F.unhex("sha")), F.col("sha").cast("binary")))
    coded = coded.withColumn("__odd", F.when(F.col("__thumb").isNull(), F.col("thumb").cast("binary")))
    own = F.array(
        *[entry(place, suffix, F.lit(32 // (BITS + 1) // 2)) for place, suffix in turned_digests(F.col("__thumb"), BITS)],
        entry(SHA, F.col("__sha")), entry(NAMED, F.col("image").cast("binary")), entry(ODD_THUMB, F.col("__odd")),
    )
    listed = F.transform(F.array_distinct("others"), lambda x: entry(NAMED, tidy_upper(x).cast("binary"), role="list"))
    entries = F.when(F.size("others") > 0, F.concat(own, listed)).otherwise(own)
    rows = coded.select("left", F.col("image").alias("id"), F.explode(entries).alias("t")).filter("t.suffix IS NOT NULL")
    return rows.select("t.place", "t.suffix", "left", "id", "t.least", "t.role")


def links(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((reason, a, b), (reason, value, left, id)): values of the two sides that overlap, and the images that have them.

    Both come from the suffixes that have a long enough prefix in common with the other
    side. Copies are one value, so a value of many images is no more than one link.
    """
    lists = F.coalesce(F.size("others"), F.lit(0))
    most = facts.agg(F.sum(F.greatest(lists, F.lit(0)) + BITS + 4)).first()[0] or 0
    spans = cut_lineage(shared_spans(image_suffixes(facts), n=most))
    near = near_digests(spans.filter(F.col("place") <= BITS), BITS)
    place = F.col("place")
    reason = F.when(place == SHA, "sha").when(place == NAMED, "list").otherwise("thumb")
    text = F.when(place <= BITS, digest_of(place, F.col("suffix"), BITS)).when(place == NAMED, F.concat_ws(":", "role", F.hex("suffix"))).otherwise(F.concat(F.lit("x"), F.hex("suffix")))
    members = spans.select(reason.alias("reason"), text.alias("value"), "left", "id").distinct()
    sides = members.groupBy("reason", "value").agg(F.bool_or("left").alias("l"), F.bool_or(~F.col("left")).alias("r"))
    equal = sides.filter("l AND r AND reason <> 'list'").select("reason", F.col("value").alias("a"), F.col("value").alias("b"))
    own = sides.filter("reason = 'list' AND value LIKE 'own:%'").select(F.expr("substring(value, 5)").alias("k"), F.col("l").alias("ol"), F.col("r").alias("orr"))
    lists = sides.filter("reason = 'list' AND value LIKE 'list:%'").select(F.expr("substring(value, 6)").alias("k"), F.col("l").alias("ll"), F.col("r").alias("lr"))
    met, named = own.join(lists, "k"), F.concat(F.lit("own:"), "k")
    ways = F.array(F.when(F.col("ol") & F.col("lr"), F.struct(named.alias("a"), F.concat(F.lit("list:"), "k").alias("b"))), F.when(F.col("orr") & F.col("ll"), F.struct(F.concat(F.lit("list:"), "k").alias("a"), named.alias("b"))))
    listed = met.select(F.explode(F.array_compact(ways)).alias("w")).select(F.lit("list").alias("reason"), "w.a", "w.b")
    return equal.unionByName(listed).unionByName(near.select(F.lit("thumb").alias("reason"), "a", "b")), members


_SQL = r"""
WITH sp AS (SELECT upper(trim(patient_id)) AS p, lower(trim(split)) AS split FROM patient_level_split WHERE trim(patient_id) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(patient_id)) ORDER BY assigned_at DESC, row_no DESC) = 1),
f AS (SELECT upper(trim(image_id)) AS i, split = 'train' AS l, split, nullif(regexp_replace(lower(trim(source_sha256)), '^0+$', ''), '') AS sha, nullif(regexp_replace(lower(trim(thumb_hash)), '^0+$', ''), '') AS th, duplicate_source_image_ids AS o
  FROM processing JOIN sp ON sp.p = upper(trim(patient_id)) WHERE trim(image_id) <> '' AND split IN ('train', 'val', 'test')),
h AS (SELECT DISTINCT i, l, th, CAST('0x' || th[1:16] AS UBIGINT) AS a, CAST('0x' || th[17:32] AS UBIGINT) AS b FROM f WHERE th IS NOT NULL),
named AS (SELECT DISTINCT i, l, upper(trim(unnest(o))) AS n FROM f),
pairs AS (
SELECT x.i AS i, y.i AS j FROM f x JOIN f y ON x.sha = y.sha WHERE x.l AND NOT y.l
UNION SELECT x.i, y.i FROM h x JOIN h y ON x.l AND NOT y.l WHERE bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) <= 3
UNION SELECT x.i, y.i FROM named x JOIN f y ON x.n = y.i WHERE x.l <> y.l)
SELECT DISTINCT least(i, j) AS image_a, greatest(i, j) AS image_b FROM pairs WHERE i <> j"""


@query("p6_found", sql=_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images of which one is in train and the other in val or test."""
    found, members = links(image_facts(spark, sf_dir))
    a = members.filter("left").select("reason", F.col("value").alias("a"), F.col("id").alias("train"))
    b = members.filter(~F.col("left")).select("reason", F.col("value").alias("b"), F.col("id").alias("other"))
    pairs = found.join(a, ["reason", "a"]).join(b, ["reason", "b"]).filter("train <> other")
    return pairs.select(F.least("train", "other").alias("image_a"), F.greatest("train", "other").alias("image_b")).distinct()


_FACTS = r"""
WITH sp AS (SELECT upper(trim(patient_id)) AS p, lower(trim(split)) AS split FROM patient_level_split WHERE trim(patient_id) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(patient_id)) ORDER BY assigned_at DESC, row_no DESC) = 1),
f AS (SELECT upper(trim(image_id)) AS i, split = 'train' AS l, split, lower(trim(source_id)) AS src, nullif(regexp_replace(lower(trim(source_sha256)), '^0+$', ''), '') AS sha, nullif(regexp_replace(lower(trim(thumb_hash)), '^0+$', ''), '') AS th, duplicate_source_image_ids AS o
  FROM processing JOIN sp ON sp.p = upper(trim(patient_id)) WHERE trim(image_id) <> '' AND split IN ('train', 'val', 'test'))"""


@query("p6_report", sql=_FACTS + r""",
s AS (SELECT DISTINCT i, l, sha FROM f WHERE sha IS NOT NULL),
h AS (SELECT DISTINCT i, l, CAST('0x' || th[1:16] AS UBIGINT) AS a, CAST('0x' || th[17:32] AS UBIGINT) AS b FROM f WHERE th IS NOT NULL),
named AS (SELECT DISTINCT i, l, upper(trim(unnest(o))) AS n FROM f), own AS (SELECT DISTINCT i, l FROM f),
lk AS (SELECT 'sha' AS reason, y.i FROM s x JOIN s y ON x.sha = y.sha AND x.l AND NOT y.l
UNION ALL SELECT 'thumb', y.i FROM h x JOIN h y ON x.l AND NOT y.l WHERE bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) <= 3
UNION ALL SELECT 'list', CASE WHEN x.l THEN y.i ELSE x.i END FROM named x JOIN own y ON x.n = y.i WHERE x.l <> y.l)
SELECT split, source_id, reason, count(DISTINCT lk.i) AS n_images, count(*) AS n_links FROM lk JOIN (SELECT DISTINCT i, split, nullif(src, '') AS source_id FROM f WHERE NOT l) o ON o.i = lk.i GROUP BY ALL""")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of val and test that overlap with training, and their links to it, per split, source and reason.

    A link is an equal or near value, or an entry in a list, that a train image and
    another have; they are counted by class sizes and never written out.
    """
    facts = image_facts(spark, sf_dir)
    found, members = links(facts)
    sizes = members.filter("left").groupBy("reason", F.col("value").alias("a")).agg(F.count("*").alias("n"))
    weights = found.join(sizes, ["reason", "a"]).groupBy("reason", "b").agg(F.sum("n").alias("n"))
    each = members.filter(~F.col("left")).select("reason", F.col("value").alias("b"), "id").join(weights, ["reason", "b"]).groupBy("reason", "id").agg(F.sum("n").alias("n"))
    of = facts.filter(~F.col("left")).select(F.col("image").alias("id"), "split", F.col("source").alias("source_id")).distinct()
    return each.join(of, "id").groupBy("split", "source_id", "reason").agg(F.count("*").alias("n_images"), F.sum("n").cast("long").alias("n_links"))


@query("p6_coverage", sql=_FACTS + r""",
d AS (SELECT DISTINCT i, l, th FROM f WHERE regexp_full_match(th, '[0-9a-f]{32}')),
s AS (SELECT DISTINCT l, th, p, substr(th, CAST(p AS INT), 8) AS x FROM d, range(1, 26) t(p)),
b AS (SELECT p, x FROM s GROUP BY p, x HAVING count(DISTINCT l) = 2),
c AS (SELECT s.l, s.th, count(DISTINCT s.p + k) AS covered FROM s JOIN b USING (p, x), range(0, 8) u(k) GROUP BY s.l, s.th)
SELECT d.i AS image, CASE WHEN d.l THEN 'train' ELSE 'other' END AS side, c.covered FROM d JOIN c ON c.l = d.l AND c.th = d.th""")
def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its 32 thumbnail digits each image shares, in spans of eight or more, with images across."""
    images = image_facts(spark, sf_dir).filter(F.col("thumb").rlike(_HEX)).select("image", "left", "thumb").distinct()
    covered = coverage(images.select(F.unhex("thumb").alias("id"), "left", F.col("thumb").alias("text")), 8, aligned=True, ascii_only=True)
    met = images.join(covered, (F.unhex("thumb") == F.col("id")) & (images["left"] == covered["left"]))
    return met.select("image", F.when(images["left"], "train").otherwise("other").alias("side"), "covered")
