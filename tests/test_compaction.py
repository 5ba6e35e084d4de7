import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_path
from tessella.operators.compaction import compact_parquet, consolidate_files, first_fit_decreasing, freeze_manifest, pack_bins
from tessella.sources.sinks import tar_bytes


def plain_first_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        place = next((i for i, room in enumerate(rooms) if room >= min(size, capacity)), None)
        if place is None:
            rooms.append(capacity)
            place = len(rooms) - 1
        rooms[place] -= min(size, capacity)
        out.append(place)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_first_fit_decreasing_is_that_of_the_book(seed):
    draw = random.Random(seed)
    sizes = sorted((draw.choice([0, 1, 5, draw.randint(1, 130)]) for _ in range(draw.randint(0, 300))), reverse=True)
    assert first_fit_decreasing(sizes, 100) == plain_first_fit(sizes, 100)


def test_bins_hold_each_file_once_and_no_more_than_they_can(spark):
    rows = [("tile", f"f{i}", None if i % 50 == 0 else (i * 37) % 1000) for i in range(5000)] + [("tile", None, 5)]
    bins = pack_bins(spark.createDataFrame(rows, "kind string, key string, size int"), "kind", "key", "size", 10_000, unknown_bytes=300, chunk_files=1000)
    got = bins.groupBy("bin").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert bins.select("key").distinct().count() == bins.count() == 5000
    assert max(r.b for r in got) <= 10_000
    total = sum(r.b for r in got)
    assert len(got) <= total / 10_000 * 1.25 + 10


def test_manifest_cases(spark):
    tiles = spark.createDataFrame([(3, "A\\x.PNG", 5), (1, " ./a//x.png", 5), (2, "a/./x.png ", None), (4, "b/y.png", 9_000_000), (5, None, 1), (6, " ", 1), (7, "a/z.png", 0)], "no long, path string, b int")
    shards = spark.createDataFrame([("T1", "m", None), ("T1", "m", 4_194_303), ("T1", "m", 7), ("T2", "m", 4_194_303), ("T2", "n", 1), ("T3", "m", None), (None, "m", 3)], "tar string, m string, b long")
    manifest = freeze_manifest(tiles, F.col("no"), tidy_path("path"), F.col("b"), shards, F.lower("tar"), F.col("m"), F.col("b"))
    got = {(r.file_kind, r.file_key): r.action for r in manifest.collect()}
    assert got == {("tile", "1"): "pack", ("tile", "2"): "drop", ("tile", "3"): "drop", ("tile", "4"): "keep", ("tile", "7"): "pack", ("tar", "t1"): "pack", ("tar", "t2"): "keep", ("tar", "t3"): "pack"}


def test_paths_that_name_the_same_file(spark):
    forms = ["a/b.png", "A\\B.PNG", " a//b.png ", "./a/b.png", "a/./b.png", "/a/b.png/", "a/././b.png", ".\\a\\.\\b.png"]
    other = ["a/.b.png", "a/..b.png", "../a/b.png", "a./b.png"]
    rows = spark.createDataFrame([(f,) for f in forms + other], "p string").select(tidy_path("p").alias("p")).collect()
    assert {r.p for r in rows[: len(forms)]} == {"a/b.png"}
    assert [r.p for r in rows[len(forms) :]] == other


def test_small_files_become_few_and_equal(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    data = spark.range(2000).select("id", (F.col("id") % 7).alias("rows"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("t"), "id")).alias("text"))
    data.unionByName(data.limit(100)).repartition(40).write.parquet(source)
    summary = compact_parquet(spark, source, target, target_bytes=1 << 20)
    assert summary["rows"] == 2100 and summary["files_in"] == 40 and summary["files_out"] <= 3
    back = spark.read.parquet(target)
    assert back.columns == ["id", "rows", "text"] and len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]) <= 3
    assert back.exceptAll(spark.read.parquet(source)).isEmpty() and spark.read.parquet(source).exceptAll(back).isEmpty()
    with pytest.raises(FileExistsError):
        compact_parquet(spark, source, target)
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []


def test_nothing_to_compact(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))["files_in"] == 0
    assert (tmp_path / "out" / "_summary.json").exists()


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    spark.range(50).repartition(5).write.parquet(source)
    monkeypatch.setattr("tessella.operators.compaction.checksum", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        compact_parquet(spark, source, str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


def test_columns_of_all_files_are_kept(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).coalesce(1).write.parquet(f"{source}/a")
    spark.range(10, 20).select("id", F.concat(F.lit("t"), "id").alias("late")).coalesce(1).write.parquet(f"{source}/b")
    spark.range(20, 30).select((F.col("id") / 2).alias("other"), "id").coalesce(1).write.parquet(f"{source}/c")
    assert compact_parquet(spark, source, target)["rows"] == 30
    back = {r.id: (r.late, r.other) for r in spark.read.parquet(target).collect()}
    assert back == {i: (f"t{i}" if 10 <= i < 20 else None, i / 2 if i >= 20 else None) for i in range(30)}


def test_types_that_do_not_go_together_are_an_error(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in" / "a"))
    spark.range(5).select(F.col("id").cast("string").alias("id")).write.parquet(str(tmp_path / "in" / "b"))
    with pytest.raises(Exception, match="(?i)merg"):
        compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


@pytest.mark.parametrize("how", ["removed", "changed"])
def test_listed_files_lost_during_the_run_are_an_error(spark, tmp_path, monkeypatch, how):
    source = tmp_path / "in"
    spark.range(50).repartition(5).write.parquet(str(source))

    def pack_and_lose(*args, **kwargs):
        file = sorted(source.glob("part-*.parquet"))[0]
        if how == "removed":
            file.unlink()
        else:
            (source / f".{file.name}.crc").unlink()
            file.write_bytes(sorted(source.glob("part-*.parquet"))[1].read_bytes())
        return pack_bins(*args, **kwargs)

    monkeypatch.setattr("tessella.operators.compaction.pack_bins", pack_and_lose)
    with pytest.raises(RuntimeError, match="1 of the listed files"):
        compact_parquet(spark, str(source), str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


def test_files_without_rows_are_no_loss(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    assert compact_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))["rows"] == 5


@pytest.mark.parametrize("wrong", [None, "twice", "lost"])
def test_report_is_made_from_the_written_files(spark, monkeypatch, wrong):
    from tessella.plans import storage

    def packed(*args):
        out = pack_bins(*args)
        hit = (F.col("kind") == "tar") & (F.col("key") == out.filter("kind = 'tar'").agg(F.min("key")).first()[0])
        return {None: out, "twice": out.unionByName(out.filter(hit)), "lost": out.filter(~hit)}[wrong]

    monkeypatch.setattr(storage, "pack_bins", packed)
    got = {r.file_kind: r for r in storage.p4_report(spark, "/root/testdata/sf0.001").collect()}
    assert got["tar"].agree == (wrong is None) and got["tile"].agree
    assert (got["tar"].records_in == got["tar"].records_out) == (wrong is None) and got["tar"].records_in > got["tar"].n_files


def small_files(spark, root):
    """30 tiles in 3 folders, one of them empty, 12 small TARs and one of good size."""
    for i in range(30):
        folder = root / "tiles" / f"s{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(bytes([i]) * (i * 10))
    (root / "tars").mkdir()
    for i in range(13):
        members = [(f"images/{i}-{k}.png", bytes([i + k]) * (50_000 if i == 12 else 100)) for k in range(1 + i % 4)]
        (root / "tars" / f"t{i:02d}.tar").write_bytes(tar_bytes(members))
    return {f"s{i % 3}/{i}.png": bytes([i]) * (i * 10) for i in range(1, 30)} | {f"t{i:02d}/images/{i}-{k}.png": bytes([i + k]) * 100 for i in range(12) for k in range(1 + i % 4)}


def test_tiles_and_tars_come_out_in_few_tars_each_once(spark, tmp_path):
    want = small_files(spark, tmp_path)
    target = f"file://{tmp_path}/out"
    summary = consolidate_files(spark, str(tmp_path / "tiles"), f"file://{tmp_path}/tars", target, target_bytes=20_000, small_bytes=40_000)
    assert summary["files_in"] == 41 and summary["files_kept"] == 1 and summary["members"] == len(want) and summary["files_out"] < 10
    got = {}
    for path in sorted((tmp_path / "out" / "tars").glob("*.tar")):
        with tarfile.open(path) as archive:
            assert path.stat().st_size <= 20_000 + 10_240
            for info in archive:
                assert info.name not in got
                got[info.name] = archive.extractfile(info).read()
    assert got == want
    again = consolidate_files(spark, str(tmp_path / "tiles"), str(tmp_path / "tars"), str(tmp_path / "again"), target_bytes=20_000, small_bytes=40_000)
    digests = [sorted(r.tar_sha256 for r in spark.read.parquet(str(tmp_path / name / "_tars")).collect()) for name in ("out", "again")]
    assert again == summary and digests[0] == digests[1]
    with pytest.raises(FileExistsError):
        consolidate_files(spark, str(tmp_path / "tiles"), None, target)


@pytest.mark.parametrize("how", ["removed", "replaced"])
def test_a_tile_lost_between_manifest_and_rewrite_fails_the_run(spark, tmp_path, monkeypatch, how):
    small_files(spark, tmp_path)

    def pack_and_lose(*args, **kwargs):
        file = tmp_path / "tiles" / "s1" / "7.png"
        file.unlink() if how == "removed" else file.write_bytes(b"other")
        return pack_bins(*args, **kwargs)

    monkeypatch.setattr("tessella.operators.compaction.pack_bins", pack_and_lose)
    with pytest.raises(RuntimeError, match="does not agree"):
        consolidate_files(spark, str(tmp_path / "tiles"), str(tmp_path / "tars"), str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["tars", "tiles"]


def test_only_tars_and_nothing_small(spark, tmp_path):
    small_files(spark, tmp_path)
    assert consolidate_files(spark, None, str(tmp_path / "tars"), str(tmp_path / "out"), small_bytes=1)["files_out"] == 0
