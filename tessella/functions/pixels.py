"""Pixel kernels over whole images as NumPy arrays (height, width, 3), RGB, 8 bits.

They are pure functions; `tessella.operators.imaging` runs them in Arrow batches.
Stain evidence is optical density against an estimated background, with green above
red and blue. The older kernels on HSV follow the published colour conversions.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    """Thresholds of the kernels, checked when made."""

    od_mean: float = 0.05
    green_contrast: float = 0.03
    neutral_chroma: float = 0.20
    background_percentile: float = 99.0
    sample_pixels: int = 4096
    tile_size: int = 256
    stride: int = 256
    min_tissue: float = 0.10
    max_tiles: int = 0
    blur_threshold: float = 0.0

    def __post_init__(self) -> None:
        for name in ("od_mean", "green_contrast", "neutral_chroma", "min_tissue", "blur_threshold", "background_percentile"):
            value = getattr(self, name)
            if isinstance(value, bool) or not np.isfinite(value) or value < 0:
                raise ValueError(f"{name} must be a finite number of at least 0")
        if self.min_tissue > 1 or self.background_percentile > 100:
            raise ValueError("min_tissue is at most 1, background_percentile at most 100")
        for name, least, most in (("tile_size", 1, 4096), ("stride", 1, 4096), ("max_tiles", 0, 1 << 31), ("sample_pixels", 1, 1 << 31)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
                raise ValueError(f"{name} must be a whole number from {least} to {most}")


WHITE = np.full(3, 255.0, dtype=np.float32)


def tissue_mask(rgb: np.ndarray, ground: np.ndarray, s: Settings) -> np.ndarray:
    """Stained pixels: dense enough on average, and denser in green than in red and in blue.

    The density of a channel is how far its logarithm lies below that of the ground, and
    at least 0.
    """
    def density(channel: int) -> np.ndarray:
        return np.maximum(np.log1p(np.float32(ground[channel])) - np.log1p(rgb[..., channel].astype(np.float32)), 0)

    green = density(1)
    total, excess = green.copy(), None
    for channel in (0, 2):
        other = density(channel)
        total += other
        excess = green - other if excess is None else np.minimum(excess, green - other)
    return (total >= 3 * s.od_mean) & (excess >= s.green_contrast)


def background(rgb: np.ndarray, s: Settings) -> np.ndarray:
    """The bright colour of the unstained, nearly colourless ones among evenly spaced pixels; white when there are none."""
    count = rgb.shape[0] * rgb.shape[1]
    rows, columns = np.divmod(np.linspace(0, count - 1, min(count, s.sample_pixels)).astype(np.int64), rgb.shape[1])
    probe = rgb[rows, columns]
    wide = probe.astype(np.float64)
    colour = (wide.max(axis=1) - wide.min(axis=1)) > s.neutral_chroma * np.maximum(wide.mean(axis=1), 1)
    plain = wide[~(colour | tissue_mask(probe, WHITE, s))]
    return np.percentile(plain, s.background_percentile, axis=0).clip(1, 255).astype(np.float32) if plain.size else WHITE.copy()


def grey(rgb: np.ndarray) -> np.ndarray:
    """(77 R + 150 G + 29 B + 128) >> 8."""
    return ((rgb.astype(np.uint16) @ np.array([77, 150, 29], dtype=np.uint16) + 128) >> 8).astype(np.uint8)


def focus(rgb: np.ndarray, border: str = "edge") -> float:
    """Population variance of the four-neighbour Laplacian; `reflect` is the older border."""
    shade = grey(rgb).astype(np.float32)
    if min(shade.shape) < 2:
        border = "edge"
    around = np.pad(shade, 1, mode=border)
    lap = (around[2:, 1:-1] + around[:-2, 1:-1] + around[1:-1, 2:] + around[1:-1, :-2] - 4.0 * shade).astype(np.float64)
    return float(max(0.0, (lap * lap).mean() - lap.mean() ** 2)) if lap.size else 0.0


def tile_fractions(mask: np.ndarray, s: Settings) -> list[tuple[int, int, int, int, float]]:
    """(x, y, valid_w, valid_h, fraction) of each grid tile in raster order, from a summed-area table."""
    height, width = mask.shape
    area = np.zeros((height + 1, width + 1), dtype=np.int64)
    area[1:, 1:] = mask.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    out = []
    for y in range(0, height, s.stride):
        bottom = min(height, y + s.tile_size)
        for x in range(0, width, s.stride):
            right = min(width, x + s.tile_size)
            count = area[bottom, right] - area[y, right] - area[bottom, x] + area[y, x]
            out.append((x, y, right - x, bottom - y, float(count) / ((right - x) * (bottom - y))))
    return out


def crop(rgb: np.ndarray, x: int, y: int, size: int) -> np.ndarray:
    """A tile of the full size, white where it exceeds the image."""
    tile = np.full((size, size, 3), 255, dtype=np.uint8)
    part = rgb[y : y + size, x : x + size]
    tile[: part.shape[0], : part.shape[1]] = part
    return tile


def saturation_value(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and V of HSV in 0..255."""
    top = rgb.max(axis=-1).astype(np.float32)
    spread = top - rgb.min(axis=-1)
    return np.rint(255.0 * spread / np.maximum(top, 1.0)), top


def hsv_tissue_ratio(rgb: np.ndarray, lens: int | None = None) -> float:
    """Share of pixels with S above and V below the limits; those of the lens when given."""
    least, most = (20, 240) if lens is None or lens <= 10 else (15, 245)
    s, v = saturation_value(rgb)
    return float(((s > least) & (v < most)).mean())


def white_ratio(rgb: np.ndarray) -> float:
    return float((grey(rgb) > 220).mean())


def stretch(rgb: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """Each channel from its low to its high percentile to 0..255, truncated; flat channels stay."""
    out = rgb.copy()
    for c in range(rgb.shape[2]):
        a, b = np.percentile(rgb[..., c], [low, high])
        if b - a >= 1e-6:
            out[..., c] = (np.clip((rgb[..., c] - a) / (b - a), 0, 1) * 255).astype(np.uint8)
    return out


def equalise_locally(shade: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of one 8-bit channel."""
    height, width = shade.shape
    th, tw = -(-height // grid), -(-width // grid)
    padded = np.pad(shade, ((0, th * grid - height), (0, tw * grid - width)), mode="symmetric" if min(height, width) > max(th, tw) else "edge")
    tables = np.zeros((grid, grid, 256), dtype=np.float32)
    limit = max(1, int(clip * th * tw / 256))
    for i in range(grid):
        for j in range(grid):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + excess // 256
            counts[: excess % 256] += 1
            tables[i, j] = np.cumsum(counts) * (255.0 / (th * tw))
    ys = np.clip((np.arange(height) + 0.5) / th - 0.5, 0, grid - 1)
    xs = np.clip((np.arange(width) + 0.5) / tw - 0.5, 0, grid - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    top = tables[y0[:, None], x0[None, :], shade] * (1 - fx) + tables[y0[:, None], x1[None, :], shade] * fx
    low = tables[y1[:, None], x0[None, :], shade] * (1 - fx) + tables[y1[:, None], x1[None, :], shade] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def resize_area(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by the mean over each target pixel's area."""
    def along(a: np.ndarray, size: int) -> np.ndarray:
        n = a.shape[0]
        edges = np.linspace(0, n, size + 1)
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        whole = np.floor(edges).astype(int)
        part = (edges - whole).reshape(-1, *[1] * (a.ndim - 1))
        upto = total[whole] + part * a[np.minimum(whole, n - 1)]
        return np.diff(upto, axis=0) / (n / size)

    rows = along(rgb.astype(np.float64), height)
    return np.rint(np.swapaxes(along(np.swapaxes(rows, 0, 1), width), 0, 1)).clip(0, 255).astype(np.uint8)


def over_white(rgba: np.ndarray) -> np.ndarray:
    """An image with alpha on white ground."""
    alpha = rgba[..., 3:].astype(np.float32) / 255.0
    return np.rint(rgba[..., :3] * alpha + 255.0 * (1 - alpha)).astype(np.uint8)


def encode_png(rgb: np.ndarray) -> bytes:
    """A lossless PNG of an 8-bit RGB image."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = rgb.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), np.ascontiguousarray(rgb).reshape(height, width * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of a PNG as `encode_png` writes it."""
    at, parts, size = 8, [], None
    while at < len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + length
    if size is None or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not a PNG of 8-bit RGB pixels")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(size[1], 1 + 3 * size[0])
    if rows[:, 0].any():
        raise ValueError("the PNG has filtered rows")
    return rows[:, 1:].reshape(size[1], size[0], 3)


def frame_count(data: bytes) -> int:
    """Pictures in a PNG or TIFF file; 1 for any other file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            length, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"acTL":
                return max(1, struct.unpack(">I", data[at + 8 : at + 12])[0])
            if kind == b"IDAT":
                return 1
            at += 12 + length
        return 1
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return 1
    order = "<" if data[:2] == b"II" else ">"
    place, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while place and place not in seen and place + 2 <= len(data):
        seen.add(place)
        end = place + 2 + 12 * struct.unpack(order + "H", data[place : place + 2])[0]
        if end + 4 > len(data):
            break
        place = struct.unpack(order + "I", data[end : end + 4])[0]
    return max(1, len(seen))


def turned(rgb: np.ndarray, mirror: bool = False, flip: bool = False, turns: int = 0) -> np.ndarray:
    """Left and right, then top and bottom exchanged, then so many quarter turns against the clock."""
    out = rgb[:, ::-1] if mirror else rgb
    out = out[::-1] if flip else out
    return np.ascontiguousarray(np.rot90(out, turns % 4))


#: Mean and deviation of the channels of a well-known image collection (fixed values).
CHANNEL_MEAN, CHANNEL_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalised(rgb: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Channels first, scaled to 0..1, less the mean, by the deviation."""
    scaled = np.moveaxis(rgb, -1, 0).astype(kind) / kind(255)
    return (scaled - np.array(CHANNEL_MEAN, dtype=kind)[:, None, None]) / np.array(CHANNEL_DEVIATION, dtype=kind)[:, None, None]


def resize_bilinear(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize between the centres of the four nearest pixels, borders being repeated."""
    def along(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * (n / size) - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = along(rgb.shape[0], height)
    x0, x1, fx = along(rgb.shape[1], width)
    wide = rgb.astype(np.float64)
    rows = wide[y0] * (1 - fy)[:, None, None] + wide[y1] * fy[:, None, None]
    return np.rint(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]).astype(np.uint8)


#: From linear RGB with white D65 to XYZ over that white (fixed values of the sRGB standard).
_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
_WHITE_XYZ = np.array([0.95047, 1.0, 1.08883])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*, a*, b* of sRGB pixels; L* from 0 to 100."""
    c = rgb / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ _TO_XYZ.T / _WHITE_XYZ
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """sRGB pixels of CIE L*, a*, b*."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    t = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29))
    linear = np.clip(t * _WHITE_XYZ @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    c = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.rint(c * 255).clip(0, 255).astype(np.uint8)


def equalise_lightness(rgb: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """`equalise_locally` on the lightness alone; colours keep their a* and b*."""
    lab = to_lab(rgb)
    shade = np.rint(lab[..., 0] * 2.55).clip(0, 255).astype(np.uint8)
    lab[..., 0] = equalise_locally(shade, clip, grid) / 2.55
    return from_lab(lab)
