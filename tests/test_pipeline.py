import json
import shutil
import struct
import zlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.__main__ import main
from tessella.functions import pixels as P
from tessella.operators import validation as V
from tessella.operators.scoring import score
from tessella.pipeline import build_catalog, prepare, process, verify
from tessella.sources.files import selected_sources

HEAD = "Ten_File,Ma_Nam,Ma_So,Do_Phong_Dai,Glade,Ket_Luan,Ten_Slide\n"


@pytest.fixture
def cohort(tmp_path):
    """Six images, two of each lens, one lens in a ZIP; labels by turns."""
    folder, zips = tmp_path / "images", tmp_path / "zips"
    folder.mkdir()
    zips.mkdir()
    lines, r = [], np.random.default_rng(5)
    with zipfile.ZipFile(zips / "a.zip", "w") as z:
        for i in range(6):
            lens = ("4X", "10x", "40")[i // 2]
            data = P.encode_png(r.integers(0, 256, (32, 32, 3), dtype=np.uint8))
            if lens == "40":
                z.writestr(f"slides/img_{i}.png", data)
            else:
                (folder / f"img_{i}.png").write_bytes(data)
            lines.append(f"img_{i}.png,YCT 26,{i // 2 * 2 + i % 2},{lens},G{i % 4},{'CARCINOMA' if i % 2 else 'TĂNG SẢN LÀNH TÍNH'},slide-{i}\n")
    (tmp_path / "m.csv").write_text(HEAD + "".join(lines), encoding="utf-8")
    (tmp_path / "ids.csv").write_text("case_id,patient_id\n" + "".join(f"YCT26_{i},p{i}\n" for i in range(6)))
    return tmp_path


def sources(root):
    return selected_sources(str(root / "images"), str(root / "zips"))


def test_catalog_records_coverage_and_blockers(spark, cohort):
    images, header = build_catalog(spark, str(cohort / "m.csv"), sources(cohort), str(cohort / "ids.csv"), reviewed=True)
    rows = {r.image_id: r for r in images.collect()}
    assert len(rows) == 6 and rows["img_1"].case_label == 1 and rows["img_0"].case_label == 0 and rows["img_0"].case_id == "YCT26_0" and rows["img_0"].patient_id == "p0"
    assert len(rows["img_0"].source_signature) == 64 and rows["img_5"].source_signature.startswith("zip-crc32:")
    assert header["coverage"]["4"] == {"expected": 2, "selected": 2} and header["training_blockers"] == ["raw_sha256_pending_import_audit"]
    with pytest.raises(ValueError, match="not ready"):
        V.require_ready(header["training_blockers"])
    _, smoke = build_catalog(spark, str(cohort / "m.csv"), sources(cohort), per_lens=1)
    assert smoke["mode"] == "smoke" and smoke["training_blockers"][0] == "smoke_subset" and "patient_identity_not_verified" in smoke["training_blockers"]


def test_bad_metadata_is_refused(spark, cohort):
    path = cohort / "m.csv"
    good = path.read_text(encoding="utf-8")
    for old, new, message in (("4X", "20X", "unknown lenses"), ("img_1.png", "../x.png", "unsafe file names"), ("img_1.png", "img_0.png", "keys twice"), ("Ket_Luan", "Other", "columns missing"), ("YCT 26,1,", "YCT 26,0,", "different labels"), ("YCT 26,1,", "YCT 26,,", "without a case")):
        path.write_text(good.replace(old, new, 1), encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            build_catalog(spark, str(path), sources(cohort))
    path.write_text(good, encoding="utf-8")
    (cohort / "images" / "img_0.png").unlink()
    _, header = build_catalog(spark, str(path), sources(cohort))
    assert header["missing_images"] == 1 and "missing_source_images" in header["training_blockers"]


def test_shards_resume_verify_and_detect_changes(spark, cohort):
    out = str(cohort / "out")
    first = prepare(spark, str(cohort / "m.csv"), sources(cohort), out, cap=10_240, max_shards=2)
    assert len(first["shards"]) == 2 and not first["complete"] and verify(spark, out) == sum(s["members"] for s in first["shards"])
    whole = prepare(spark, str(cohort / "m.csv"), sources(cohort), out, cap=10_240)
    assert whole["complete"] and whole["shards"][:2] == first["shards"] and all(s["tar_bytes"] <= 10_240 for s in whole["shards"]) and verify(spark, out) == 6
    again = prepare(spark, str(cohort / "m.csv"), sources(cohort), str(cohort / "out2"), cap=10_240)
    assert [s["tar_sha256"] for s in again["shards"]] == [s["tar_sha256"] for s in whole["shards"]]
    with pytest.raises(ValueError, match="another"):
        prepare(spark, str(cohort / "m.csv"), sources(cohort), out, cap=20_480)
    tar = cohort / "out" / whole["shards"][0]["tar_name"]
    tar.write_bytes(tar.read_bytes()[:-1] + b"x")
    with pytest.raises(ValueError, match="was changed"):
        verify(spark, out)


def test_processing_is_published_once_and_reused(spark, tmp_path):
    (tmp_path / "i").mkdir()
    for name in ("a.png", "b.png"):
        (tmp_path / "i" / name).write_bytes(P.encode_png(np.full((32, 32, 3), (130, 65, 105), dtype=np.uint8)))
    s = P.Settings(tile_size=16, stride=16)
    one = process(spark, str(tmp_path / "i"), str(tmp_path / "o"), s)
    assert one["images"] == 2 and one["tiles"] == 8 and one["duplicates"] == 2 and not one["reused"]
    assert process(spark, str(tmp_path / "i"), str(tmp_path / "o"), s)["reused"]
    assert process(spark, str(tmp_path / "i"), str(tmp_path / "o"), P.Settings(tile_size=16, stride=16, max_tiles=1))["mode"] == "smoke"
    (tmp_path / "i" / "c.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="cannot decode"):
        process(spark, str(tmp_path / "i"), str(tmp_path / "o"), s)
    assert len([p for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")]) == 2


@pytest.mark.parametrize("harm", ["archive", "missing", "tiles", "quality"])
def test_tampered_output_is_refused(spark, tmp_path, harm):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(P.encode_png(np.full((32, 32, 3), (130, 65, 105), dtype=np.uint8)))
    s = P.Settings(tile_size=16, stride=16)
    out = tmp_path / "o" / process(spark, str(tmp_path / "i"), str(tmp_path / "o"), s)["processing_id"]
    archive = next((out / "patches").glob("*.tar"))
    if harm == "archive":
        archive.write_bytes(archive.read_bytes()[:600] + b"x" + archive.read_bytes()[601:])
    elif harm == "missing":
        archive.unlink()
    else:
        schema = spark.read.parquet(str(out / harm)).schema
        shutil.rmtree(out / harm)
        spark.createDataFrame([], schema).write.parquet(str(out / harm))
    with pytest.raises(Exception, match="changed|differ|commit"):
        process(spark, str(tmp_path / "i"), str(tmp_path / "o"), s)


def test_files_with_several_pictures_are_refused(spark, tmp_path):
    png = P.encode_png(np.full((8, 8, 3), (130, 65, 105), dtype=np.uint8))
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(png[:33] + struct.pack(">I4sII", 8, b"acTL", 3, 0) + struct.pack(">I", zlib.crc32(b"acTL" + struct.pack(">II", 3, 0))) + png[33:])
    with pytest.raises(ValueError, match="several pictures"):
        process(spark, str(tmp_path / "i"), str(tmp_path / "o"), P.Settings(tile_size=8, stride=8))


def test_command_line_answers_and_fails_in_one_line(spark, cohort, capsys):
    args = ["--master", "local[4]", "prepare", "--metadata", str(cohort / "m.csv"), "--images", str(cohort / "images"), "--archives", str(cohort / "zips"), "--out", str(cohort / "cli"), "--max-bytes", "10240"]
    assert main(args) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["complete"]
    assert main(["--master", "local[4]", "verify", str(cohort / "nothing")]) == 2
    said = capsys.readouterr().err.strip().splitlines()[-1]
    assert said.startswith("error: ")


def test_gates(spark):
    rows = spark.createDataFrame([("p1", 0, "s1"), ("p2", 1, "s2")], "patient_id string, label int, slide_id string")
    V.require_patients(rows, "patient_id", "label")
    for bad in (rows.filter("label = 0"), rows.withColumn("label", F.lit(2)), rows.withColumn("patient_id", F.lit(" ")), rows.limit(0)):
        with pytest.raises(ValueError):
            V.require_patients(bad, "patient_id", "label")
    V.require_disjoint([rows.filter("label = 0"), rows.filter("label = 1")], ["patient_id", "slide_id", "sha256"])
    with pytest.raises(ValueError, match="slide_id"):
        V.require_disjoint([rows.filter("label = 0"), rows.withColumn("patient_id", F.lit("x"))], ["patient_id", "slide_id"])


def test_scoring_with_any_model(spark):
    rows = spark.range(3000).select("id", F.array(F.col("id") / 3000, F.lit(1.0)).alias("v"))
    got = score(rows, lambda: lambda m: m @ np.array([2.0, -1.0]), "v")
    assert got.filter(F.abs(F.col("y_prob") - (2 * F.col("id") / 3000 - 1)) > 1e-9).isEmpty() and got.count() == 3000


def test_patches_are_written_to_archives(spark, tmp_path, monkeypatch):
    import tarfile

    monkeypatch.setattr("tessella.pipeline.PATCH_BYTES", 3 * 16 * 16 * 3)  # three patches an archive
    (tmp_path / "i").mkdir()
    draw = np.random.default_rng(2)
    images = {n: np.clip(np.array([130, 65, 105]) + draw.integers(-20, 20, (32, 32, 3)), 0, 255).astype(np.uint8) for n in ("a", "b")}
    for name, rgb in images.items():
        (tmp_path / "i" / f"{name}.png").write_bytes(P.encode_png(rgb))
    out = tmp_path / "o" / process(spark, str(tmp_path / "i"), str(tmp_path / "o"), P.Settings(tile_size=16, stride=16))["processing_id"]
    tiles = {f"patches/{r.tile_id}.png": r for r in spark.read.parquet(str(out / "tiles")).collect()}
    found = {}
    for path in (out / "patches").glob("*.tar"):
        with tarfile.open(path) as archive:
            for m in archive.getmembers():
                assert m.name not in found
                found[m.name] = archive.extractfile(m).read()
    assert len(tiles) == 8 and found.keys() == tiles.keys() and len(list((out / "patches").iterdir())) == 4
    for name, data in found.items():
        r = tiles[name]
        assert data == P.encode_png(images[r.image_id][r.y : r.y + 16, r.x : r.x + 16])
