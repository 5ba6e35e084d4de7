import struct

import numpy as np
import pytest

from tessella.functions import pixels as P
from tessella.operators.imaging import decoded, images, quality, several_frames, tile_ids, tiles
from pyspark.sql import functions as F

#: Colours and expected tiles here are agreed examples (fixed values).
TISSUE = (130, 65, 105)


def solid(width, height, colour):
    return np.full((height, width, 3), colour, dtype=np.uint8)


def save(folder, name, rgb):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(P.encode_png(rgb))


def test_borders_are_padded_with_white_and_pixels_stay(spark, tmp_path):
    save(tmp_path / "i", "a.png", solid(5, 3, TISSUE))
    s = P.Settings(tile_size=4, stride=4, min_tissue=0.1)
    got = tiles(images(spark, f"file://{tmp_path}/i"), s).collect()
    assert sorted((r.x, r.y, r.w, r.h, r.valid_w, r.valid_h) for r in got) == [(0, 0, 4, 4, 4, 3), (4, 0, 4, 4, 1, 3)]
    second = P.crop(solid(5, 3, TISSUE), 4, 0, 4)
    assert (second[:3, 0] == TISSUE).all() and (second[3] == 255).all() and (second[:, 1:] == 255).all()


def test_white_and_tinted_fields_have_no_tissue(spark, tmp_path):
    save(tmp_path / "i", "white.png", solid(5, 3, (255, 255, 255)))
    save(tmp_path / "i", "cast.png", solid(64, 64, (140, 150, 135)))
    (tmp_path / "i" / "broken.png").write_bytes(b"not an image")
    s = P.Settings(tile_size=32, stride=32, min_tissue=0.0)
    rows = {r.image_id: r for r in quality(images(spark, f"file://{tmp_path}/i"), s).collect()}
    assert rows["white"].tissue_fraction == 0 and rows["white"].tiles_eligible == 0
    assert rows["cast"].tissue_fraction == 0 and rows["cast"].background_reference_rgb == [140.0, 150.0, 135.0]
    assert rows["broken"].decode_ok is False and rows["broken"].focus_score is None
    with pytest.raises(Exception, match="cannot decode broken"):
        quality(images(spark, f"file://{tmp_path}/i"), s, strict=True).collect()


def test_one_region_gives_one_tile_and_the_contrast_counts(spark, tmp_path):
    field = solid(64, 64, (140, 150, 135))
    field[32:, 32:] = (105, 45, 120)
    save(tmp_path / "i", "a.png", field)
    frames = images(spark, f"file://{tmp_path}/i")
    got = tiles(frames, P.Settings(tile_size=32, stride=32)).collect()
    assert [(r.x, r.y, r.tissue_fraction) for r in got] == [(32, 32, 1.0)]
    assert tiles(frames, P.Settings(tile_size=32, stride=32, green_contrast=1.0)).count() == 0


def test_cap_keeps_raster_order(spark, tmp_path):
    save(tmp_path / "i", "a.png", solid(8, 4, TISSUE))
    got = tiles(images(spark, f"file://{tmp_path}/i"), P.Settings(tile_size=4, stride=4, max_tiles=1)).collect()
    assert [(r.x, r.place) for r in got] == [(0, 1)]


def test_equal_images_share_content_ids_only(spark, tmp_path):
    for name in ("a.png", "b.png"):
        save(tmp_path / "i", name, solid(32, 32, TISSUE))
    rows = tile_ids(tiles(images(spark, f"file://{tmp_path}/i"), P.Settings(tile_size=16, stride=16)), F.lit("d"), "c").collect()
    assert len(rows) == 8 and len({r.tile_id for r in rows}) == 8 and len({r.content_tile_id for r in rows}) == 4


def test_focus_is_the_variance_of_the_laplacian():
    rgb = np.random.default_rng(1).integers(0, 256, (37, 23, 3), dtype=np.uint8)
    g = np.pad(((rgb[..., 0].astype(int) * 77 + rgb[..., 1].astype(int) * 150 + rgb[..., 2].astype(int) * 29 + 128) >> 8), 1, mode="edge").astype(float)
    lap = g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * g[1:-1, 1:-1]
    assert P.focus(rgb) == pytest.approx(lap.var())
    assert P.focus(solid(1, 1, TISSUE)) == 0.0


def test_tile_fractions_equal_plain_counts():
    mask = np.random.default_rng(2).random((50, 41)) < 0.3
    for x, y, w, h, f in P.tile_fractions(mask, P.Settings(tile_size=16, stride=8)):
        part = mask[y : y + 16, x : x + 16]
        assert part.shape == (h, w) and f == pytest.approx(part.mean())


def test_older_kernels():
    assert P.hsv_tissue_ratio(solid(4, 4, TISSUE)) == 1.0 and P.hsv_tissue_ratio(solid(4, 4, (250, 250, 250))) == 0.0
    assert P.white_ratio(solid(4, 4, (250, 250, 250))) == 1.0
    ramp = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, axis=2)
    assert P.stretch(ramp).min() == 0 and P.stretch(ramp).max() == 255
    assert (P.stretch(solid(3, 3, TISSUE)) == TISSUE).all()
    assert P.resize_area(solid(9, 7, TISSUE), 3, 5).shape == (3, 5, 3) and (P.resize_area(solid(9, 7, TISSUE), 3, 5) == TISSUE).all()
    assert P.equalise_locally(np.random.default_rng(3).integers(90, 120, (64, 64)).astype(np.uint8)).std() > 8
    assert (P.over_white(np.zeros((2, 2, 4), dtype=np.uint8)) == 255).all()


@pytest.mark.parametrize("wrong", [{"od_mean": -1.0}, {"min_tissue": 1.5}, {"tile_size": 0}, {"tile_size": 5000}, {"stride": True}, {"max_tiles": -1}, {"blur_threshold": float("nan")}, {"background_percentile": 101.0}, {"green_contrast": float("inf")}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        P.Settings(**wrong)


def test_png_round_trip_and_damage():
    rgb = np.random.default_rng(4).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    data = P.encode_png(rgb)
    assert (P.decode_png(data) == rgb).all() and P.frame_count(data) == 1
    with pytest.raises(ValueError, match="damaged"):
        P.decode_png(data[:40] + bytes([data[40] ^ 1]) + data[41:])


def tiff(frames, order="<"):
    out, place = (b"II*\0" if order == "<" else b"MM\0*"), 8
    out += struct.pack(order + "I", 8)
    for i in range(frames):
        size = 2 + 12 + 4
        out += struct.pack(order + "HHHII", 1, 256, 4, 1, 5) + struct.pack(order + "I", place + size if i < frames - 1 else 0)
        place += size
    return out


def test_pictures_of_a_file_are_counted():
    assert [P.frame_count(tiff(n, o)) for n in (1, 2, 5) for o in "<>"] == [1, 1, 2, 2, 5, 5]
    looped = tiff(2)[:-4] + struct.pack("<I", 8)
    assert P.frame_count(looped) == 2 and P.frame_count(b"") == P.frame_count(b"GIF89a") == P.frame_count(tiff(2)[:12]) == 1
    png = P.encode_png(solid(2, 2, TISSUE))
    moving = png[:33] + struct.pack(">I4sIII", 8, b"acTL", 3, 0, 0) + png[33:]
    assert P.frame_count(moving) == 3


def test_resizing_keeps_flat_fields_and_ramps():
    assert (P.resize_bilinear(solid(5, 3, TISSUE), 9, 4) == TISSUE).all()
    ramp = np.repeat(np.arange(0, 250, 10, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(2, axis=0)
    assert (P.resize_bilinear(ramp, 2, 25) == ramp).all()
    double = P.resize_bilinear(ramp, 2, 50)[0, :, 0].astype(int)
    assert (np.diff(double) >= 0).all() and double[1] == 2 and double[2] == 8


def test_lab_goes_there_and_back():
    rgb = np.random.default_rng(5).integers(0, 256, (20, 20, 3), dtype=np.uint8)
    lab = P.to_lab(rgb)
    assert np.abs(P.from_lab(lab).astype(int) - rgb).max() <= 1
    assert np.allclose(P.to_lab(np.array([[[255, 255, 255], [0, 0, 0]]], dtype=np.uint8)), [[[100, 0, 0], [0, 0, 0]]], atol=0.02)
    dull = np.clip(rgb // 8 + 100, 0, 255).astype(np.uint8)
    out = P.equalise_lightness(dull, clip=40.0, grid=2)
    assert out.shape == dull.shape and P.to_lab(out)[..., 0].std() > P.to_lab(dull)[..., 0].std()


def test_turned_and_normalised():
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (P.turned(rgb) == rgb).all() and (P.turned(rgb, turns=4) == rgb).all() and P.turned(rgb, turns=1).shape == (4, 2, 3)
    assert (P.turned(rgb, mirror=True, flip=True) == P.turned(rgb, turns=2)).all()
    assert P.normalised(rgb).shape == (3, 2, 4) and P.normalised(rgb)[0, 0, 0] == pytest.approx(-0.485 / 0.229)


def test_odd_geometry_is_refused_and_unreadable_files_have_a_status(spark, tmp_path):
    for height, width, channels, size in ((2, 2, 3, 11), (2, 2, 2, 8), (0, 2, 3, 0)):
        with pytest.raises(ValueError, match="bytes for"):
            decoded(height, width, channels, bytes(size))
    save(tmp_path / "i", "a.png", solid(5, 3, TISSUE))
    (tmp_path / "i" / "bad.png").write_bytes(b"no")
    got = {r.image_id: (r.status, r.tiles_eligible) for r in quality(images(spark, str(tmp_path / "i")), P.Settings(tile_size=4, stride=4)).collect()}
    assert got == {"a": ("ok", 2), "bad": ("read_error", 0)}


def test_files_with_several_pictures_are_named(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(3))
    (tmp_path / "b.tif").write_bytes(tiff(1))
    rows = several_frames(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.path.rpartition("/")[2], r.frames) for r in rows] == [("a.tif", 3)]
