import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import archives, files, sinks
from tessella.sources.sheets import sheet_rows

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Ma_So</t></is></c><c r="C1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c></row>
<row r="3"><c r="B3"><v>007</v></c></row></sheetData></worksheet>"""


def book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Ten_File</t></si><si><r><t>O</t></r><r><t>K</t></r></si><si><t>tăng sản</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_sheet_with_sparse_cells(spark, tmp_path):
    path = str(tmp_path / "m.xlsx")
    book(path)
    assert list(sheet_rows(path))[0] == ["Ten_File", "Ma_So", "OK"]
    got = files.read_strings(spark, path)
    assert got.columns == ["Ten_File", "Ma_So", "OK"]
    assert sorted(tuple(r) for r in got.collect()) == [("", "007", ""), ("tăng sản", "", "TRUE")]


def test_csv_keeps_blanks_and_leading_zeros(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n001,\n"x, y",NA\n', encoding="utf-8")
    assert sorted(tuple(r) for r in files.read_strings(spark, str(tmp_path / "m.csv")).collect()) == [("001", ""), ("x, y", "NA")]


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members:
            z.writestr(name, content)


def test_zip_inventory_and_members(spark, tmp_path):
    archives.register(spark)
    zipped(tmp_path / "a.zip", [("slides/b.png", b"bb"), ("slides/a.TIF", b"a"), ("readme.txt", b"-")])
    zipped(tmp_path / "b.zip", [("c.png", b"ccc")])
    rows = spark.read.format("zip_inventory").load(str(tmp_path)).collect()
    assert sorted((r.source_member, r.byte_size) for r in rows) == [("c.png", 3), ("slides/a.TIF", 1), ("slides/b.png", 2)]
    assert all(r.source_signature.startswith("zip-crc32:") for r in rows)
    members = spark.read.format("zip_members").load(str(tmp_path))
    assert members.filter(F.lower(F.hex(F.crc32("content"))) == F.regexp_replace("crc32", r"\A0+", "")).count() == 3


@pytest.mark.parametrize("name", ["../bad.tiff", "/bad.tiff", "x//bad.tiff", "C:\\bad.tiff", "a/./b.tif"])
def test_unsafe_members_are_refused(spark, tmp_path, name):
    archives.register(spark)
    zipped(tmp_path / "a.zip", [(name, b"x")])
    with pytest.raises(Exception, match="unsafe member"):
        spark.read.format("zip_inventory").load(str(tmp_path)).collect()


def test_several_sources_and_names_in_two_of_them(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.png").write_bytes(b"1")
    (tmp_path / "z").mkdir()
    zipped(tmp_path / "z" / "b.zip", [("b.png", b"22")])
    found = files.selected_sources(str(tmp_path / "d"), str(tmp_path / "z"))
    assert [s[:2] for s in found] == [("source-000", "directory"), ("source-001", "zip")]
    rows = files.inventory(spark, found)
    assert sorted((r.source_id, r.source_member, r.byte_size) for r in rows.collect()) == [("source-000", "a.png", 1), ("source-001", "b.png", 2)]
    selected = files.image_files(spark, str(tmp_path / "d"))
    digests = files.hashed(spark, selected, [str(tmp_path / "d")]).collect()
    assert digests == files.hashed(spark, selected, [str(tmp_path / "d")], listed=0).collect()
    assert digests[0].sha256 == "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"
    zipped(tmp_path / "z" / "c.zip", [("x/a.png", b"3")])
    with pytest.raises(ValueError, match="several places"):
        files.inventory(spark, files.selected_sources(str(tmp_path / "d"), str(tmp_path / "z")))


def test_shards_are_deterministic_and_read_back(spark, tmp_path):
    archives.register(spark)
    rows = [(f"shard-{i // 3:09d}", i, f"images/{i}.png", bytes([i]) * (i * 100)) for i in range(7)]
    df = spark.createDataFrame(rows, "shard_id string, place long, member string, content binary")
    one = {r.shard_id: r.tar_sha256 for r in sinks.write_shards(df, str(tmp_path / "one")).collect()}
    two = {r.shard_id: r.tar_sha256 for r in sinks.write_shards(df.repartition(5), str(tmp_path / "two")).collect()}
    assert one == two and len(one) == 3
    members = spark.read.format("tar_members").load(str(tmp_path / "one"))
    manifest = df.select("member", F.sha2("content", 256).alias("sha256"))
    assert sinks.matches_manifest(members, manifest).isEmpty()
    assert [r.problem for r in sinks.matches_manifest(members, manifest.filter("member <> 'images/1.png'")).collect()] == ["extra"]


def test_atomic_json_and_verified_copy(tmp_path):
    sinks.atomic_json(str(tmp_path / "a.json"), {"b": 1, "a": "ă"})
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": "ă", "b": 1}
    with pytest.raises(ValueError):
        sinks.atomic_json(str(tmp_path / "a.json"), {"b": float("nan")})
    assert json.loads((tmp_path / "a.json").read_text())["b"] == 1
    digest = sinks.digest(str(tmp_path / "a.json"))
    sinks.verified_copy(str(tmp_path / "a.json"), str(tmp_path / "b.json"), digest)
    with pytest.raises(ValueError):
        sinks.verified_copy(str(tmp_path / "a.json"), str(tmp_path / "c.json"), "0" * 64)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]


def test_bad_json_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a long").collect()


def test_settings_precedence(tmp_path):
    (tmp_path / "c.json").write_text('{"process": {"tile": 8}}')
    assert files.configured(str(tmp_path / "c.json"), "process", {"stride": 4, "tile": None}, {"tile": 1, "stride": 1}) == {"tile": 8, "stride": 4}
    with pytest.raises(ValueError, match="unknown"):
        files.configured(None, "process", {"x": 1}, {"tile": 1})
    assert io.BytesIO(sinks.tar_bytes([("a", b"b")])).read(1) == b"a"
