"""Queries that write with a sink and read with a source, and run the pixel kernels on real pixels.

Each takes whole tables, writes below the shared folder and returns what was read back,
so the result shows both ends. Kernels get images made of the embeddings' values.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import pixels as P
from tessella.operators import validation as V
from tessella.plans.registry import Registry
from tessella.session import read, scratch_folder
from tessella.sources import archives, files, shared, sinks, staging
from tessella.streaming import commits

REGISTRY = Registry()
query = REGISTRY.query


# --- tables of text -----------------------------------------------------------------


def _one_file(folder: str) -> str:
    return shared.listed(folder, ".csv")[0]


@query("src01_csv_strings", "SELECT CAST(row_no AS VARCHAR) AS row_no, coalesce(raw_glade, '') AS raw_glade, coalesce(case_id, '') AS case_id FROM catalog_images")
def src01(spark, sf_dir):
    """SNK06 and SRC01: every column a string and blanks ''."""
    folder = scratch_folder(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "catalog_images").select("row_no", "raw_glade", "case_id").coalesce(1), folder)
    return files.read_strings(spark, _one_file(folder)) if shared.listed(folder, ".csv") else files.read_strings(spark, folder)


@query("src02_csv_inferred", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src02(spark, sf_dir):
    """Types found in the values."""
    folder = scratch_folder(spark, "csv")
    sinks.write_csv(read(spark, sf_dir, "nation"), folder)
    return files.read_inferred(spark, folder)


def _sheet(rows: list[tuple], names: list[str]) -> list[tuple[str, bytes]]:
    """Members of a workbook: names as shared strings, texts inline, booleans and numbers as such, absent cells left out."""
    # names the file format prescribes (fixed values)
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(at: int, line: int, value) -> str:
        place = f"{chr(65 + at)}{line}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            safe = value.replace("&", "&amp;").replace("<", "&lt;")
            return f'<c r="{place}" t="inlineStr"><is><t>{safe}</t></is></c>'
        return f'<c r="{place}"><v>{value}</v></c>'

    head = "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(len(names)))
    body = "".join(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(row))}</row>' for n, row in enumerate(rows, 2))
    return [
        ("xl/workbook.xml", f'<workbook {space} xmlns:r="{relations}"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>'.encode()),
        ("xl/_rels/workbook.xml.rels", b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{n}</t></si>' for n in names)}</sst>".encode()),
        ("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>'.encode()),
    ]


@query("src03_xlsx_strings", "SELECT lower(trim(source_id)) AS source_id, coalesce(kind, '') AS kind, CASE WHEN closed_at IS NULL THEN 'TRUE' ELSE 'FALSE' END AS is_open, CAST(length(kind) AS VARCHAR) AS size FROM image_sources")
def src03(spark, sf_dir):
    """A workbook with shared and inline strings, booleans, numbers and absent cells; image_sources has a fixed size."""
    rows = [(r.s, r.kind, r.closed_at is None, len(r.kind) if r.kind is not None else None) for r in read(spark, sf_dir, "image_sources").select(F.lower(F.trim("source_id")).alias("s"), "kind", "closed_at").collect()]
    path = scratch_folder(spark, "book") + ".xlsx"
    sinks.put_zip(path, _sheet(rows, ["source_id", "kind", "is_open", "size"]))
    return files.read_strings(spark, path)


# --- archives -------------------------------------------------------------------------

def _records(spark, sf_dir):
    """(shard_id, place, member, content): the customers' names as members of some archives."""
    rows = read(spark, sf_dir, "customer")
    shard = F.format_string("shard-%04d", F.floor(F.col("c_custkey") / 512))
    return rows.select(shard.alias("shard_id"), F.col("c_custkey").alias("place"), F.format_string("images/c%09d.png", "c_custkey").alias("member"), F.encode("c_name", "UTF-8").alias("content"))


_MEMBERS = "SELECT printf('images/c%09d.png', c_custkey) AS member, CAST(octet_length(encode(c_name)) AS BIGINT) AS byte_size"


@query("src09_tar_members", f"{_MEMBERS}, sha256(c_name) AS sha256 FROM customer")
def src09(spark, sf_dir):
    """SNK01 and SRC09: members of streamed archives, with digests."""
    archives.register(spark)
    folder = scratch_folder(spark, "tars")
    sinks.write_shards(_records(spark, sf_dir), folder).write.parquet(shared.joined(folder, "_written"))
    return spark.read.format("tar_members").load(folder).select("member", "byte_size", "sha256")


@query("snk01_tar_sizes", """SELECT printf('shard-%04d', c_custkey // 512) AS shard_id, count(*) AS members, CAST(ceil((sum(512 + ceil(octet_length(encode(c_name)) / 512) * 512) + 1024) / 10240) * 10240 AS BIGINT) AS tar_bytes FROM customer GROUP BY 1""")
def snk01(spark, sf_dir):
    """The size of each archive written is the one that can be foretold."""
    return sinks.write_shards(_records(spark, sf_dir), scratch_folder(spark, "tars")).select("shard_id", "members", "tar_bytes")


def _zipped(spark, sf_dir) -> str:
    """A folder with one ZIP file for each thousand customers."""
    folder = scratch_folder(spark, "zips")
    shared.make_folder(folder)
    rows = _records(spark, sf_dir).withColumn("zip", F.floor(F.col("place") / 1000).cast("int"))

    def write(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["zip"].iloc[0])
        sinks.put_zip(shared.joined(folder, f"{number:06d}.zip"), [(m, bytes(c)) for m, c in zip(part["member"], part["content"], strict=True)])
        return pd.DataFrame({"zip": [number]})

    rows.groupBy("zip").applyInPandas(write, "zip int").count()
    return folder


@query("src07_zip_inventory", "SELECT printf('images/c%09d.png', c_custkey) AS source_member, printf('c%09d.png', c_custkey) AS file_name, CAST(octet_length(encode(c_name)) AS BIGINT) AS byte_size FROM customer")
def src07(spark, sf_dir):
    """Members by the directories of ZIP files alone."""
    archives.register(spark)
    return spark.read.format("zip_inventory").load(_zipped(spark, sf_dir)).select("source_member", "file_name", "byte_size")


@query("src08_zip_members", f"{_MEMBERS}, sha256(c_name) AS sha256 FROM customer")
def src08(spark, sf_dir):
    """Members of ZIP files with bytes whose CRC was compared."""
    archives.register(spark)
    rows = spark.read.format("zip_members").load(_zipped(spark, sf_dir))
    return rows.select("member", "byte_size", F.sha2("content", 256).alias("sha256"))


# --- single files ---------------------------------------------------------------------


@query("snk02_json_object", "SELECT r_name, CAST(r_regionkey AS INT) AS r_regionkey FROM region")
def snk02(spark, sf_dir):
    """SNK02 and SRC17: an object that appears whole, read as an object. region has a fixed size."""
    path = scratch_folder(spark, "object") + ".json"
    sinks.atomic_json(path, {r.r_name: r.r_regionkey for r in read(spark, sf_dir, "region").collect()})
    return spark.createDataFrame(list(files.read_object(path).items()), "r_name string, r_regionkey int")


def _region_text(spark, sf_dir) -> bytes:
    return "\n".join(f"{r.r_regionkey} {r.r_name}" for r in read(spark, sf_dir, "region").orderBy("r_regionkey").collect()).encode()


_REGION_SHA = "sha256(string_agg(r_regionkey || ' ' || r_name, chr(10) ORDER BY r_regionkey))"


@query("snk03_verified_copy", f"SELECT {_REGION_SHA} AS sha256, true AS refused_other FROM region")
def snk03(spark, sf_dir):
    """A copy with the right digest, and whether one with another digest is refused."""
    source, target = scratch_folder(spark, "file"), scratch_folder(spark, "copy")
    data = _region_text(spark, sf_dir)
    sinks.verified_copy(source, target, shared.put(source, [data]))
    try:
        sinks.verified_copy(source, target + "-b", "0" * 64)
        refused = False
    except ValueError:
        refused = not shared.exists(target + "-b")
    return spark.createDataFrame([(shared.digest(target), refused)], "sha256 string, refused_other boolean")


@query("str04_staging_cache", f"SELECT {_REGION_SHA} AS sha256, false AS first_reused, true AS second_reused, false AS damaged_reused, true AS refused_without_space FROM region")
def str04(spark, sf_dir):
    """Copies are used again only while their bytes have the digest; none is made without space."""
    archive, cache = scratch_folder(spark, "file") + ".tar", scratch_folder(spark, "cache")
    data = _region_text(spark, sf_dir)
    sha = shared.put(archive, [data])
    copy, first = staging.staged(archive, cache, "r1", sha, len(data))
    _, second = staging.staged(archive, cache, "r1", sha, len(data))
    shared.put(copy, [b"x" * len(data)])
    copy, third = staging.staged(archive, cache, "r1", sha, len(data))
    got = shared.digest(copy)
    staging.unstage(cache, "r1", sha)
    try:
        staging.staged(archive, cache, "r1", sha, len(data), free=lambda _: len(data))
        refused = False
    except OSError:
        refused = not shared.exists(copy)
    return spark.createDataFrame([(got, first, second, third, refused)], "sha256 string, first_reused boolean, second_reused boolean, damaged_reused boolean, refused_without_space boolean")


@query("src22_built_once", "SELECT false AS first_reused, true AS second_reused, count(*) AS members FROM region")
def src22(spark, sf_dir):
    """An archive that is built once for a fingerprint and read back. region has a fixed size."""
    cache = scratch_folder(spark, "cache")
    rows = [(f"{r.r_regionkey}.png", r.r_name.encode()) for r in read(spark, sf_dir, "region").collect()]
    fingerprint = commits.settings_id({"regions": len(rows)})
    _, first = staging.built_once(cache, fingerprint, lambda: rows)
    archive, second = staging.built_once(cache, fingerprint, lambda: rows)
    archives.register(spark)
    n = spark.read.format("tar_members").load(archive).count()
    return spark.createDataFrame([(first, second, n)], "first_reused boolean, second_reused boolean, members long")


@query("src20_remote_tree", "SELECT r_name || '/' || n_name AS path, length(n_name) AS size FROM nation JOIN region ON r_regionkey = n_regionkey")
def src20(spark, sf_dir):
    """SRC20 and SRC21: a folder tree of regions and nations, listed in pages of three, fetched twice. Both have a fixed size."""
    regions = {r.r_regionkey: r.r_name for r in read(spark, sf_dir, "region").collect()}
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    md5 = lambda text: hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
    tree = {"": [{"id": f"r{k}", "name": name, "folder": True} for k, name in regions.items()]}
    for k in regions:
        tree[f"r{k}"] = [{"id": f"n{n.n_nationkey}", "name": n.n_name, "size": len(n.n_name.encode()), "md5": md5(n.n_name)} for n in nations if n.n_regionkey == k]
    text = {f"n{n.n_nationkey}": n.n_name.encode() for n in nations}

    def pages(folder: str, token: str | None):
        at = int(token or 0)
        return tree[folder][at : at + 3], str(at + 3) if at + 3 < len(tree[folder]) else None

    folder = scratch_folder(spark, "download")
    listing = list(staging.remote_files(pages, ""))
    first = staging.download(listing, lambda i: [text[i]], folder)
    again = staging.download(listing, lambda i: [text[i]], folder)
    if (first["fetched"], again["kept"]) != (len(listing), len(listing)):
        raise RuntimeError(f"{first} and then {again} of {len(listing)} files")
    return spark.createDataFrame([(f["path"], len(shared.content(shared.joined(folder, f["path"])))) for f in listing], "path string, size long")


# --- incremental work -------------------------------------------------------------------


@query("str02_committed_units", "SELECT event_type AS unit, count(*) AS n_rows, round(sum(value), 6) AS total FROM events GROUP BY 1")
def str02(spark, sf_dir):
    """SNK07, STR01 to STR03: two units at first, then the rest, then nothing new; what is committed can be seen."""
    rows = read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    data, done = scratch_folder(spark, "data"), scratch_folder(spark, "commits")
    first = commits.process_waiting(spark, rows, "event_type", data, done, most=2)
    commits.process_waiting(spark, rows, "event_type", data, done)
    if commits.process_waiting(spark, rows, "event_type", data, done, most=5):
        raise RuntimeError("committed units were taken for new")
    if not first:
        return spark.createDataFrame([], "unit string, n_rows long, total double")
    return commits.visible(spark, data, done, "event_type").groupBy(F.col("event_type").alias("unit")).agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 6).alias("total"))


@query("str01_streamed_files", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str01(spark, sf_dir):
    """A file stream that handles what arrived since the last run, twice; each batch is a committed unit."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month"))
    source, mark, out = scratch_folder(spark, "arrived"), scratch_folder(spark, "mark"), scratch_folder(spark, "out")

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy("month", "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.filter("event_id % 2 = 0").write.parquet(source)
    commits.run_available(spark, source, rows.schema, mark, handle)
    rows.filter("event_id % 2 <> 0").write.mode("append").parquet(source)
    commits.run_available(spark, source, rows.schema, mark, handle, files_per_batch=4)
    if commits.run_available(spark, source, rows.schema, mark, handle):
        raise RuntimeError("files were handled twice")
    return spark.read.schema("month string, event_type string, n long").parquet(f"{out}/batch=*").groupBy("month", "event_type").agg(F.sum("n").alias("n"))


@query("str05_settings_lock", """SELECT sha256('{"shares":[7,15,15],"table":"patients"}') AS settings_id, true AS same_again, true AS refused_other""")
def str05(spark, sf_dir):
    """STR05: a folder keeps its settings."""
    folder = scratch_folder(spark, "locked")
    first = commits.lock_settings(folder, {"table": "patients", "shares": [7, 15, 15]})
    same = commits.lock_settings(folder, {"shares": [7, 15, 15], "table": "patients"}) == first
    try:
        commits.lock_settings(folder, {"table": "patients", "shares": [8, 1, 1]})
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(first, same, refused)], "settings_id string, same_again boolean, refused_other boolean")


@query("str06_stable_holdout", "SELECT true AS same, false AS same_with_one_moved, count(DISTINCT upper(trim(patient_id))) AS n_patients FROM patient_level_split WHERE trim(patient_id) <> ''")
def str06(spark, sf_dir):
    """STR06: a saved assignment, against itself and against one with a patient moved."""
    newest = F.max_by(F.lower(F.trim("split")), F.struct("assigned_at", "row_no"))
    rows = read(spark, sf_dir, "patient_level_split").filter("trim(patient_id) <> ''").groupBy(F.upper(F.trim("patient_id")).alias("patient")).agg(newest.alias("split"))
    folder = scratch_folder(spark, "saved")
    rows.write.parquet(folder)
    saved = spark.read.parquet(folder)
    first = saved.agg(F.min("patient")).first()[0]
    moved = rows.withColumn("split", F.when(F.col("patient") == first, F.lit("elsewhere")).otherwise(F.col("split")))
    return spark.createDataFrame([(commits.same_assignment(saved, rows), commits.same_assignment(saved, moved), saved.count())], "same boolean, same_with_one_moved boolean, n_patients long")


# --- checks -----------------------------------------------------------------------------


@query("flt09_required_columns", "SELECT * FROM (VALUES ('nation', true, true), ('nation_without_name', false, true), ('nation_without_rows', true, false)) t(table_name, has_columns, has_rows)")
def flt09(spark, sf_dir):
    """Which tables have the columns and rows that are required."""
    nation = read(spark, sf_dir, "nation")

    def passes(check, *args) -> bool:
        try:
            check(*args)
            return True
        except ValueError:
            return False

    tables = {"nation": nation, "nation_without_name": nation.drop("n_name"), "nation_without_rows": nation.limit(0)}
    return spark.createDataFrame([(name, passes(V.require_columns, t, ["n_name", "n_regionkey"]), passes(V.require_rows, t)) for name, t in tables.items()], "table_name string, has_columns boolean, has_rows boolean")


#: Settings that must be refused, and two that must not.
_SETTINGS = {
    "defaults": ({}, True), "largest_tile": ({"tile_size": 4096, "stride": 4096}, True), "no_tile": ({"tile_size": 0}, False), "tile_too_large": ({"tile_size": 4097}, False), "stride_is_a_fraction": ({"stride": 2.5}, False),
    "tissue_above_one": ({"min_tissue": 1.5}, False), "tissue_is_not_a_number": ({"min_tissue": float("nan")}, False), "negative_density": ({"od_mean": -0.1}, False), "contrast_without_end": ({"green_contrast": float("inf")}, False),
    "percentile_above_hundred": ({"background_percentile": 101.0}, False), "cap_is_true": ({"max_tiles": True}, False), "unknown_name": ({"tiles": 3}, False),
}


@query("flt14_settings_checks", f"SELECT * FROM (VALUES {', '.join(f'({name!r}, {str(ok).lower()})' for name, (_, ok) in _SETTINGS.items())}) t(name, accepted)")
def flt14(spark, sf_dir):
    """Which settings the kernels accept."""
    def accepted(given: dict) -> bool:
        try:
            P.Settings(**given)
            return True
        except (TypeError, ValueError):
            return False

    return spark.createDataFrame([(name, accepted(given)) for name, (given, _) in _SETTINGS.items()], "name string, accepted boolean")


# --- kernels ------------------------------------------------------------------------------

#: Images of 5 x 4 pixels from the first 60 values of each embedding.
HEIGHT, WIDTH = 4, 5
_BYTES = "list_transform(embedding[1:60], lambda v: CAST(greatest(0, least(255, floor(v::DOUBLE * 400 + 127))) AS INT))"
_PIXELS = f"""px AS (SELECT vec_id, i // 5 AS y, i % 5 AS x, b[3 * i + 1] AS r, b[3 * i + 2] AS g, b[3 * i + 3] AS b FROM (SELECT vec_id, {_BYTES} AS b, unnest(range(20)) AS i FROM embeddings)),
gr AS (SELECT *, (77 * r + 150 * g + 29 * b + 128) // 256 AS k, greatest(r, g, b) AS v, 255e0 * (greatest(r, g, b) - least(r, g, b)) / greatest(1, greatest(r, g, b)) AS s FROM px)"""


def pictures(spark, sf_dir) -> DataFrame:
    """(vec_id, pixels): rows of RGB bytes."""
    value = F.transform(F.slice("embedding", 1, 3 * HEIGHT * WIDTH), lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 127))).cast("int"))
    return read(spark, sf_dir, "embeddings").select("vec_id", value.alias("pixels"))


def _kernel(frames: DataFrame, work, schema: str) -> DataFrame:
    """`work(rgb)` of every picture, as columns after vec_id."""
    names = [part.split()[0] for part in schema.split(", ")]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(int(i), *work(np.asarray(p, dtype=np.uint8).reshape(HEIGHT, WIDTH, 3))) for i, p in zip(part["vec_id"], part["pixels"], strict=True)]
            yield pd.DataFrame(rows, columns=["vec_id", *names])

    return frames.mapInPandas(batches, f"vec_id long, {schema}")


def _densities(ground: tuple[str, str, str]) -> str:
    """Whether a pixel is stained, as SQL: its density against the ground, in all and in green above red and blue."""
    r, g, b = (f"greatest(ln(1 + {top}) - ln(1 + {c}), 0)" for top, c in zip(ground, ("r", "g", "b"), strict=True))
    return f"({r} + {g} + {b} >= 0.15e0 AND {g} - {r} >= 0.03e0 AND {g} - {b} >= 0.03e0)"


@query("img01_background_and_tissue", f"""WITH {_PIXELS},
plain AS (SELECT * FROM px WHERE greatest(r, g, b) - least(r, g, b) <= 0.2e0 * greatest((r + g + b) / 3e0, 1) AND NOT {_densities(('255', '255', '255'))}),
ground AS (SELECT vec_id, least(255, greatest(1, quantile_cont(r::DOUBLE, 0.99))) AS gr, least(255, greatest(1, quantile_cont(g::DOUBLE, 0.99))) AS gg, least(255, greatest(1, quantile_cont(b::DOUBLE, 0.99))) AS gb FROM plain GROUP BY 1),
t AS (SELECT px.*, coalesce(gr, 255) AS gr, coalesce(gg, 255) AS gg, coalesce(gb, 255) AS gb FROM px LEFT JOIN ground USING (vec_id))
SELECT vec_id, round(any_value(gr), 3) AS red, round(any_value(gg), 3) AS green, round(any_value(gb), 3) AS blue, round(avg(CAST({_densities(('gr', 'gg', 'gb'))} AS INT)), 6) AS tissue FROM t GROUP BY 1""")
def img01(spark, sf_dir):
    """IMG01 to IMG03 by the kernels: the background of each picture and the share of its stained pixels."""
    def work(a: np.ndarray) -> tuple:
        ground = P.background(a, P.Settings())
        return (*map(float, ground), float(P.tissue_mask(a, ground, P.Settings()).mean()))

    got = _kernel(pictures(spark, sf_dir), work, "red double, green double, blue double, tissue double")
    return got.select("vec_id", *[F.round(c, 3).alias(c) for c in ("red", "green", "blue")], F.round("tissue", 6).alias("tissue"))


@query("img06_grid_tiles", f"""WITH {_PIXELS}, c AS (SELECT vec_id, x // 3 * 3 AS tx, y // 3 * 3 AS ty, count(*) AS n, sum(CAST({_densities(('255', '255', '255'))} AS INT)) AS stained FROM px GROUP BY ALL)
SELECT vec_id, tx AS x, ty AS y, least(3, 5 - tx) AS valid_w, least(3, 4 - ty) AS valid_h, round(stained / n, 6) AS tissue FROM c WHERE stained > 0 AND stained / n >= 0.1e0""")
def img06_grid(spark, sf_dir):
    """IMG06 by the kernel, against white ground: grid tiles of 3 x 3 pixels with enough tissue, at the borders too."""
    s = P.Settings(tile_size=3, stride=3)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, p in zip(part["vec_id"], part["pixels"], strict=True):
                rgb = np.asarray(p, dtype=np.uint8).reshape(HEIGHT, WIDTH, 3)
                rows += [(int(i), x, y, w, h, f) for x, y, w, h, f in P.tile_fractions(P.tissue_mask(rgb, P.WHITE, s), s) if f > 0 and f >= s.min_tissue]
            yield pd.DataFrame(rows, columns=["vec_id", "x", "y", "valid_w", "valid_h", "tissue"])

    got = pictures(spark, sf_dir).mapInPandas(batches, "vec_id long, x int, y int, valid_w int, valid_h int, tissue double")
    return got.withColumn("tissue", F.round("tissue", 6))


@query("img09_tissue_and_white", f"""WITH {_PIXELS} SELECT vec_id, round(avg(CAST(s > 20.5e0 AND v < 240 AS INT)), 6) AS any_lens, round(avg(CAST(s > 20.5e0 AND v < 240 AS INT)), 6) AS lens_10, round(avg(CAST(s > 15.5e0 AND v < 245 AS INT)), 6) AS lens_40,
round(avg(CAST(k > 220 AS INT)), 6) AS white FROM gr GROUP BY 1""")
def img09(spark, sf_dir):
    """IMG09 to IMG11 by the kernels, against SQL over single pixels."""
    got = _kernel(pictures(spark, sf_dir), lambda a: (P.hsv_tissue_ratio(a), P.hsv_tissue_ratio(a, 10), P.hsv_tissue_ratio(a, 40), P.white_ratio(a)), "any_lens double, lens_10 double, lens_40 double, white double")
    return got.select("vec_id", *[F.round(c, 6).alias(c) for c in ("any_lens", "lens_10", "lens_40", "white")])


@query("flt08_white_pictures", f"""WITH {_PIXELS}, t AS (SELECT vec_id, avg(CAST(k > 220 AS INT)) AS white, avg(CAST(s > 15.5e0 AND v < 245 AS INT)) AS tissue FROM gr GROUP BY 1)
SELECT vec_id, CASE WHEN white > 0.995 THEN 'white' WHEN tissue < 0.5 THEN 'little tissue' ELSE 'kept' END AS decision FROM t""")
def flt08(spark, sf_dir):
    """Pictures that are white, then those with little tissue, are rejected; by the kernels."""
    got = _kernel(pictures(spark, sf_dir), lambda a: (P.white_ratio(a), P.hsv_tissue_ratio(a, 40)), "white double, tissue double")
    return got.select("vec_id", F.when(F.col("white") > 0.995, "white").when(F.col("tissue") < 0.5, "little tissue").otherwise("kept").alias("decision"))


def _laplacian(border: str) -> str:
    low, high = {"edge": ("greatest(0, {0} - 1)", "least({1}, {0} + 1)"), "reflect": ("abs({0} - 1)", "{1} - abs({1} - {0} - 1)")}[border]
    up, down = low.format("c.y"), high.format("c.y", HEIGHT - 1)
    left, right = low.format("c.x"), high.format("c.x", WIDTH - 1)
    sides = [(up, "c.x"), (down, "c.x"), ("c.y", left), ("c.y", right)]
    joins = " ".join(f"JOIN gr n{i} ON n{i}.vec_id = c.vec_id AND n{i}.y = {y} AND n{i}.x = {x}" for i, (y, x) in enumerate(sides))
    return f"(SELECT c.vec_id, n0.k + n1.k + n2.k + n3.k - 4 * c.k AS lap FROM gr c {joins})"


@query("img12_focus_and_blur", f"""WITH {_PIXELS}, e AS (SELECT vec_id, round(var_pop(lap), 4) AS focus FROM {_laplacian('edge')} GROUP BY 1), f AS (SELECT vec_id, round(var_pop(lap), 4) AS blur FROM {_laplacian('reflect')} GROUP BY 1),
m AS (SELECT vec_id, round(avg(k), 6) AS brightness, round(stddev_pop(k), 6) AS deviation FROM gr GROUP BY 1) SELECT vec_id, focus, blur, brightness, deviation FROM e JOIN f USING (vec_id) JOIN m USING (vec_id)""")
def img12(spark, sf_dir):
    """IMG04, IMG05, IMG12 and IMG16 by the kernels: grey values, and both borders of the Laplacian."""
    def work(a: np.ndarray) -> tuple:
        shade = P.grey(a).astype(np.float64)
        return P.focus(a), P.focus(a, "reflect"), float(shade.mean()), float(shade.std())

    got = _kernel(pictures(spark, sf_dir), work, "focus double, blur double, brightness double, deviation double")
    return got.select("vec_id", F.round("focus", 4).alias("focus"), F.round("blur", 4).alias("blur"), F.round("brightness", 6).alias("brightness"), F.round("deviation", 6).alias("deviation"))


@query("img13_stretch", f"""WITH {_PIXELS}, c AS (SELECT vec_id, y * 5 + x AS i, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM px),
o AS (SELECT vec_id, c, list_sort(list(v::DOUBLE)) AS s FROM c GROUP BY 1, 2),
q AS (SELECT vec_id, c, s[1] + (s[2] - s[1]) * (19 * 0.01e0) AS lo, s[20] - (s[20] - s[19]) * (1 - (19 * 0.99e0 - 18)) AS hi FROM o)
SELECT vec_id, c.c AS channel, CAST(sum(CASE WHEN hi - lo >= 1e-6 THEN trunc(greatest(0, least(1, (v - lo) / (hi - lo))) * 255) ELSE v END) AS BIGINT) AS total FROM c JOIN q USING (vec_id, c) GROUP BY 1, 2""")
def img13(spark, sf_dir):
    """IMG13 by the kernel: the sum of each stretched channel."""
    got = _kernel(pictures(spark, sf_dir), lambda a: (P.stretch(a).astype(np.int64).sum(axis=(0, 1)).tolist(),), "totals array<long>")
    return got.select("vec_id", F.posexplode("totals").alias("channel", "total"))


@query("img17_turned", f"SELECT vec_id, list_transform(range(60), lambda j: b[3 * (5 * (3 - (j // 3) % 4) + ((j // 3) // 4)) + j % 3 + 1]) AS turned FROM (SELECT vec_id, {_BYTES} AS b FROM embeddings)")
def img17(spark, sf_dir):
    """Mirrored both ways and then a quarter turn against the clock."""
    return _kernel(pictures(spark, sf_dir), lambda a: (P.turned(a, mirror=True, flip=True, turns=1).ravel().tolist(),), "turned array<int>")


@query("img18_normalised", f"WITH {_PIXELS} SELECT vec_id, round((avg(r) / 255 - 0.485) / 0.229, 4) AS red, round((avg(g) / 255 - 0.456) / 0.224, 4) AS green, round((avg(b) / 255 - 0.406) / 0.225, 4) AS blue FROM px GROUP BY 1")
def img18(spark, sf_dir):
    """The mean of each channel, channels being first."""
    got = _kernel(pictures(spark, sf_dir), lambda a: tuple(float(v) for v in P.normalised(a, np.float64).mean(axis=(1, 2))), "red double, green double, blue double")
    return got.select("vec_id", *[F.round(c, 4).alias(c) for c in ("red", "green", "blue")])


@query("img20_png_in_tar", f"WITH {_PIXELS} SELECT printf('patches/%d.png', vec_id) AS member, CAST(sum(r * (3 * (y * 5 + x) + 1) + g * (3 * (y * 5 + x) + 2) + b * (3 * (y * 5 + x) + 3)) AS BIGINT) AS weighed FROM px GROUP BY vec_id")
def img20(spark, sf_dir):
    """SNK05 and IMG20: pictures as PNG patches in archives, read back and decoded; pixels are weighed by their places."""
    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            png = [P.encode_png(np.asarray(p, dtype=np.uint8).reshape(HEIGHT, WIDTH, 3)) for p in part["pixels"]]
            yield pd.DataFrame({"vec_id": part["vec_id"], "content": png})

    rows = pictures(spark, sf_dir).mapInPandas(encoded, "vec_id long, content binary")
    folder = scratch_folder(spark, "patches")
    sinks.write_shards(rows.select(F.format_string("patches-%04d", F.floor(F.col("vec_id") / 500)).alias("shard_id"), F.col("vec_id").alias("place"), F.format_string("patches/%d.png", "vec_id").alias("member"), "content"), folder).count()
    archives.register(spark)
    place = np.arange(1, 3 * HEIGHT * WIDTH + 1)

    def weighed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"member": part["member"], "weighed": [int((P.decode_png(bytes(c)).ravel().astype(np.int64) * place).sum()) for c in part["content"]]})

    return spark.read.format("tar_members").load(folder).select("member", "content").mapInPandas(weighed, "member string, weighed long")


@query("src18_settings_precedence", "SELECT * FROM (VALUES ('given', 4), ('stored', 8), ('default', 1)) t(name, value)")
def src18(spark, sf_dir):
    """SRC18: what was given goes before what is stored, and that before defaults."""
    path = scratch_folder(spark, "config") + ".json"
    sinks.atomic_json(path, {"process": {"stored": 8, "given": 9}})
    got = files.configured(path, "process", {"given": 4, "stored": None}, {"given": 1, "stored": 1, "default": 1})
    return spark.createDataFrame(list(json.loads(json.dumps(got)).items()), "name string, value int")
