"""Pixel steps in NumPy on images of shape (height, width, 3), 8 bits, channels in BGR order.

A recipe is a list of steps; each is a function of (image, generator). ``chance`` and ``one_of``
combine steps. Box columns are never touched here: only pixel values change.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np

Step = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- combining


def chance(p: float, step: Step) -> Step:
    """The step with probability p."""
    return lambda img, rng: step(img, rng) if rng.random() < p else img


def compose(*steps: Step) -> Step:
    def run(img, rng):
        for step in steps:
            img = step(img, rng)
        return img

    return run


def one_of(*steps: Step) -> Step:
    """One of the steps, so that changes of colour don't add up."""
    return lambda img, rng: steps[int(rng.integers(len(steps)))](img, rng)


# ---------------------------------------------------------------- colour spaces


def to_hsv(img: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value from 0 to 1."""
    f = img.astype(np.float64) / 255
    b, g, r = f[..., 0], f[..., 1], f[..., 2]
    most, least = f.max(-1), f.min(-1)
    wide = most - least
    safe = np.where(wide > 0, wide, 1)
    hue = np.select([wide == 0, most == r, most == g], [0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4) * 60
    return np.stack([hue, np.where(most > 0, wide / np.where(most > 0, most, 1), 0), most], -1)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    hue, s, v = hsv[..., 0] / 60, hsv[..., 1], hsv[..., 2]

    def channel(n):
        k = (n + hue) % 6
        return v - v * s * np.clip(np.minimum(k, 4 - k), 0, 1)

    return _bytes(np.rint(np.stack([channel(1), channel(3), channel(5)], -1) * 255))


_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = _TO_XYZ.sum(axis=1)


def to_lab(img: np.ndarray) -> np.ndarray:
    rgb = img[..., ::-1].astype(np.float64) / 255
    rgb = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = rgb @ _TO_XYZ.T / _WHITE
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f > 6 / 29, f**3, (116 * f - 16) * 27 / 24389) * _WHITE
    rgb = np.clip(t @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    rgb = np.where(rgb > 0.0031308, 1.055 * rgb ** (1 / 2.4) - 0.055, 12.92 * rgb)
    return _bytes(np.rint(rgb * 255))[..., ::-1]


# ---------------------------------------------------------------- preparing


def white_balance(img: np.ndarray, p: int = 6) -> np.ndarray:
    """Shades of gray: channels are scaled so that their p-norms agree."""
    f = img.astype(np.float64)
    norm = np.maximum((f**p).mean(axis=(0, 1)) ** (1 / p), 1e-6)
    return _bytes(f * (norm.mean() / norm))


def equalized(img: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of lightness: tiles' clipped histograms, blended between tile centres."""
    lab = to_lab(img)
    light = _bytes(np.rint(lab[..., 0] * 2.55))
    h, w = light.shape
    rows, cols = (np.linspace(0, n, grid + 1).astype(int) for n in (h, w))
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            tile = light[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)]
            hist = np.bincount(tile.ravel(), minlength=256).astype(float)
            limit = max(clip * tile.size / 256, 1.0)
            over = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / tile.size
    y, x = (np.clip((np.arange(n) + 0.5) * grid / n - 0.5, 0, grid - 1) for n in (h, w))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], light]
    out = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return from_lab(np.concatenate([np.clip(out, 0, 255)[..., None] / 2.55, lab[..., 1:]], -1))


def prepare(img: np.ndarray, balance: bool = True, equalize: bool = True, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """What train, validation, test and inference images all go through."""
    img = white_balance(img) if balance else img
    return equalized(img, clip, grid) if equalize else img


def denormalized(tensor: np.ndarray, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    """A normalised (channel, height, width) tensor as (height, width, channel) bytes."""
    img = tensor * np.reshape(std, (-1, 1, 1)) + np.reshape(mean, (-1, 1, 1))
    return np.rint(np.clip(img, 0, 1).transpose(1, 2, 0) * 255).astype(np.uint8)


def change(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of two images' values."""
    return float(np.abs(a.astype(np.int16) - b.astype(np.int16)).mean())


# ---------------------------------------------------------------- steps


def _table(img: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _bytes(values)[img]


def brightness_contrast(b: float = 0.3, c: float = 0.3) -> Step:
    """Absolute values of a scaled and shifted image."""
    return lambda img, rng: _bytes(np.rint(np.abs(img * (1 + rng.uniform(-c, c)) + rng.uniform(-b, b) * 255)))


def gamma(lo: float = 60, hi: float = 140) -> Step:
    return lambda img, rng: _table(img, (np.arange(256) / 255) ** (100 / rng.uniform(lo, hi)) * 255)


def hsv_jitter(h: float = 6, s: float = 30, v: float = 30) -> Step:
    """Hue by at most h half degrees, saturation and value by s and v of 255."""

    def run(img, rng):
        hsv = to_hsv(img)
        hsv[..., 0] = (hsv[..., 0] + 2 * rng.uniform(-h, h)) % 360
        for i, limit in ((1, s), (2, v)):
            hsv[..., i] = np.clip(hsv[..., i] + rng.uniform(-limit, limit) / 255, 0, 1)
        return from_hsv(hsv)

    return run


def tone_curve(scale: float = 0.3) -> Step:
    """Two points of the curve, at a quarter and three quarters, are moved and kept in order."""

    def run(img, rng):
        low, high = sorted(np.clip(rng.normal([0.25, 0.75], scale), 0.01, 0.99))
        return _table(img, np.interp(np.arange(256) / 255, [0, 0.25, 0.75, 1], [0, low, high, 1]) * 255)

    return run


def sensor_noise(colour: tuple[float, float] = (0.01, 0.05), strength: tuple[float, float] = (0.1, 0.5)) -> Step:
    """Normal noise of value and hue."""

    def run(img, rng):
        hsv = to_hsv(img)
        hsv[..., 2] = np.clip(hsv[..., 2] + rng.normal(0, rng.uniform(*strength) * 0.05, hsv.shape[:2]), 0, 1)
        hsv[..., 0] = (hsv[..., 0] + rng.normal(0, rng.uniform(*colour) * 360, hsv.shape[:2])) % 360
        return from_hsv(hsv)

    return run


def motion_blur(sizes: Sequence[int] = (3, 5)) -> Step:
    """The mean along a short line of a random direction; edges are mirrored."""

    def run(img, rng):
        k = int(rng.choice(sizes))
        angle = np.deg2rad(rng.uniform(0, 180))
        t = np.arange(k) - (k - 1) / 2
        steps = {(round(np.sin(angle) * s), round(np.cos(angle) * s)) for s in t}
        pad = k // 2 + 1
        wide = np.pad(img.astype(float), ((pad, pad), (pad, pad), (0, 0)), mode="reflect")
        h, w = img.shape[:2]
        return _bytes(np.rint(sum(wide[pad + y : pad + y + h, pad + x : pad + x + w] for y, x in steps) / len(steps)))

    return run


def shadows(n: tuple[int, int] = (1, 3), alpha: tuple[float, float] = (0.35, 0.65)) -> Step:
    """Dark triangles, as shadows that come and go whatever lies in the picture."""

    def run(img, rng):
        h, w = img.shape[:2]
        y, x = np.mgrid[:h, :w]
        out = img.astype(float)
        for _ in range(int(rng.integers(n[0], n[1] + 1))):
            p = np.stack([rng.integers(0, w, 3), rng.integers(0, h, 3)], 1)
            side = [(q[0] - o[0]) * (y - o[1]) - (q[1] - o[1]) * (x - o[0]) for o, q in zip(p, np.roll(p, -1, 0))]
            inside = np.all([s >= 0 for s in side], 0) | np.all([s <= 0 for s in side], 0)
            out *= 1 - rng.uniform(*alpha) * inside[..., None]
        return _bytes(out)

    return run


def training_recipe() -> Step:
    """The usual steps of training images: one change of colour, then noise, blur and shadows now and then."""
    colour = one_of(brightness_contrast(), gamma(), hsv_jitter(), tone_curve())
    return compose(chance(0.7, colour), chance(0.2, sensor_noise()), chance(0.1, motion_blur()), chance(0.3, shadows()))


# ---------------------------------------------------------------- shapes


def turned(img: np.ndarray, degrees: float, scale: float = 1.0, fill: int = 114) -> np.ndarray:
    """An image turned about its middle, as ``boxes.rotated`` turns its boxes; nearest pixels, a plain border."""
    h, w = img.shape[:2]
    c, s = np.cos(np.deg2rad(degrees)) / scale, np.sin(np.deg2rad(degrees)) / scale
    y, x = np.mgrid[:h, :w]
    dx, dy = x + 0.5 - w / 2, y + 0.5 - h / 2
    u, v = np.floor(w / 2 + c * dx - s * dy).astype(int), np.floor(h / 2 + s * dx + c * dy).astype(int)
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    out = np.full_like(img, fill)
    out[inside] = img[v[inside], u[inside]]
    return out


def flipped(img: np.ndarray, vertical: bool = False) -> np.ndarray:
    return img[::-1] if vertical else img[:, ::-1]


def letterboxed(img: np.ndarray, size: int, fill: int = 114) -> np.ndarray:
    """The longer side scaled to ``size``, the image centred on a plain square; nearest pixels."""
    h, w = img.shape[:2]
    scale = size / max(h, w)
    high, wide = max(1, round(h * scale)), max(1, round(w * scale))
    rows, cols = (np.minimum((np.arange(n) * m / n).astype(int), m - 1) for n, m in ((high, h), (wide, w)))
    out = np.full((size, size, img.shape[2]), fill, np.uint8)
    top, left = (size - high) // 2, (size - wide) // 2
    out[top : top + high, left : left + wide] = img[rows][:, cols]
    return out


def pasted(canvas: np.ndarray, patches: Sequence[np.ndarray], rng: np.random.Generator, tries: int = 50, gap: int = 2) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Patches on a canvas where they touch no other, each at the first of some random places that is free.

    Returns the image and (patch, x1, y1, x2, y2) of those placed. A fourth channel of a patch is
    its opacity; without one it covers what is below.
    """
    out, placed = canvas.astype(float), []
    h, w = canvas.shape[:2]
    for k, patch in enumerate(patches):
        ph, pw = patch.shape[:2]
        if ph > h or pw > w:
            continue
        for _ in range(tries):
            x, y = int(rng.integers(0, w - pw + 1)), int(rng.integers(0, h - ph + 1))
            if all(x >= b[3] + gap or x + pw + gap <= b[1] or y >= b[4] + gap or y + ph + gap <= b[2] for b in placed):
                alpha = patch[..., 3:4] / 255 if patch.shape[2] == 4 else 1.0
                part = out[y : y + ph, x : x + pw]
                part[...] = part * (1 - alpha) + patch[..., :3] * alpha
                placed.append((k, x, y, x + pw, y + ph))
                break
    return _bytes(np.rint(out)), placed


# ---------------------------------------------------------------- files


def png(img: np.ndarray) -> bytes:
    """An image as a PNG file."""
    h, w = img.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img[..., ::-1].reshape(h, -1)], 1)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def applied(images, recipe: Step, seed: int, batch: int = 16):
    """Images (file_name, width, height, data) after a recipe, with their mean absolute change; each row has its own generator."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[..., :3]
                new = recipe(img, np.random.default_rng([seed, zlib.crc32(r.file_name.encode())]))
                out.append((new.tobytes(), change(img, new)))
            yield frame.assign(data=[d for d, _ in out], change=[c for _, c in out])[["file_name", "width", "height", "data", "change"]]

    return images.select("file_name", "width", "height", "data").mapInPandas(run, "file_name string, width int, height int, data binary, change double")
