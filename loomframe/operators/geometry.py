"""Spatial transforms on packed frames.

Every output pixel is a weighted sum of input pixels of the same frame, so each
transform is a projection of the frame row: no explode, no join and no shuffle. Sizes,
offsets and matrices are columns; only the weighted sums run on Arrow batches, where a
dense frame takes milliseconds. ``rgba`` is row-major with four values per pixel, 8-bit
or linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from loomframe.functions.numeric import half_even
from loomframe.operators.pixels import rotation_matrix

_CUBIC = -0.75


def _pixelwise(fn: Callable[..., np.ndarray], eight_bit: bool = False):
    """Column function over ``rgba, width, height`` and further arguments of a frame.

    ``fn`` gets the frame as an array (height, width, 4). With ``eight_bit`` the result
    is rounded half to even into 0-255. A frame whose pixels do not fill it becomes null.
    """

    def run(rgba: pd.Series, width: pd.Series, height: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for values, w, h, *rest in zip(rgba, width, height, *more):
            fits = values is not None and w == w and h == h and len(values) == 4 * w * h > 0
            if not fits or any(r is None for r in rest):
                out.append(None)
                continue
            done = fn(np.asarray(values, dtype=np.float64).reshape(int(h), int(w), 4), *rest)
            if eight_bit:
                done = np.clip(np.rint(done), 0, 255).astype(np.int32)
            out.append(done.ravel())
        return pd.Series(out, dtype=object)

    kind = IntegerType() if eight_bit else DoubleType()
    return F.pandas_udf(run, ArrayType(kind))


def _frame(*more: Column | str) -> tuple:
    return ("rgba", "width", "height", *more)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("int")


# --- separable transforms ------------------------------------------------------------------


def _cubic_weights(f: np.ndarray) -> list[np.ndarray]:
    far = lambda d: _CUBIC * (((d - 5) * d + 8) * d - 4)
    near = lambda d: ((_CUBIC + 2) * d - (_CUBIC + 3)) * d * d + 1
    return [far(f + 1), near(f), near(1 - f), far(2 - f)]


@lru_cache(maxsize=256)
def _axis(n: int, target: int, method: str) -> np.ndarray:
    """Weights (target, n) that resize one axis by area, cubic or nearest sampling."""
    i = np.arange(target)[:, None]
    k = np.arange(n)[None, :]
    if n == target:
        return np.eye(n)
    if method == "area":
        covered = np.minimum((i + 1) * n / target, k + 1) - np.maximum(i * n / target, k)
        return np.clip(covered, 0.0, None) * target / n
    if method == "nearest":
        return (k == np.minimum(i * n // target, n - 1)).astype(float)
    at = (np.arange(target) + 0.5) * n / target - 0.5
    base = np.floor(at)
    weights = np.zeros((target, n))
    for offset, w in zip(range(-1, 3), _cubic_weights(at - base)):
        np.add.at(weights, (i[:, 0], np.clip(base + offset, 0, n - 1).astype(int)), w)
    return weights


@lru_cache(maxsize=256)
def _mirror(n: int, kernel: tuple[float, ...]) -> np.ndarray:
    """Weights (n, n) of a convolution whose border mirrors without repeating the edge."""
    period = max(2 * n - 2, 1)
    weights = np.zeros((n, n))
    for offset, w in enumerate(kernel):
        at = (np.arange(n) + offset - len(kernel) // 2) % period
        at = np.minimum(at, period - at) if n > 1 else at * 0
        np.add.at(weights, (np.arange(n), at), w)
    return weights


def _separable(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.einsum("bj,ajc->abc", columns, np.tensordot(rows, image, 1), optimize=True)


def _resample(image: np.ndarray, width: int, height: int, method: str) -> np.ndarray:
    h, w = image.shape[:2]
    return _separable(image, _axis(h, int(height), method), _axis(w, int(width), method))


def _resized(frames: DataFrame, rgba: Column, width: Column, height: Column) -> DataFrame:
    return frames.withColumn("rgba", rgba).withColumns({"width": width, "height": height})


def resize(frames: DataFrame, width: Column, height: Column, method: str) -> DataFrame:
    """Resize by ``area``, ``cubic`` or ``nearest``; values become doubles."""
    kernel = _pixelwise(lambda image, ow, oh: _resample(image, ow, oh, method))
    sized = frames.withColumns({"_w": width.cast("int"), "_h": height.cast("int")})
    done = kernel(*_frame("_w", "_h"))
    return _resized(sized, done, F.col("_w"), F.col("_h")).drop("_w", "_h")


def _window(image: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """Rectangle of an image; zero where it lies outside."""
    h, w = image.shape[:2]
    x, y = np.arange(width) + left, np.arange(height) + top
    inside = ((y >= 0) & (y < h))[:, None] & ((x >= 0) & (x < w))[None, :]
    picked = image[np.clip(y, 0, h - 1)][:, np.clip(x, 0, w - 1)]
    return picked * inside[:, :, None]


def _scaled_into(
    frames: DataFrame, scale: Column, width: int, height: int, left: Callable, top: Callable
) -> DataFrame:
    """Scale frames (area when shrinking, else cubic) and cut the target out of them.

    ``left`` and ``top`` give the cut's offset from the scaled width or height.
    """

    def fn(image: np.ndarray, ow: int, oh: int, factor: float, x: int, y: int) -> np.ndarray:
        scaled = image
        if factor != 1.0:
            scaled = _resample(image, ow, oh, "area" if factor < 1.0 else "cubic")
        return _window(scaled, int(x), int(y), width, height)

    size = lambda n: F.greatest(F.lit(1), half_even(F.col(n) * F.col("_scale")).cast("int"))
    planned = (
        frames.withColumn("_scale", scale)
        .withColumns({"_w": size("width"), "_h": size("height")})
        .withColumns({"_x": left(F.col("_w")).cast("int"), "_y": top(F.col("_h")).cast("int")})
    )
    done = _pixelwise(fn)(*_frame("_w", "_h", "_scale", "_x", "_y"))
    return _resized(planned, done, F.lit(width), F.lit(height)).drop(
        "_scale", "_w", "_h", "_x", "_y"
    )


def frame_fit(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Whole frame inside the target, transparent padding around it."""
    scale = F.least(F.lit(width) / F.col("width"), F.lit(height) / F.col("height"))
    pad = lambda target: lambda n: -_whole((F.lit(target) - n) / 2)
    return _scaled_into(frames, scale, width, height, pad(width), pad(height))


def frame_fill(
    frames: DataFrame, width: int, height: int, focus: tuple[float, float] = (0.5, 0.5)
) -> DataFrame:
    """Target fully covered, the excess cut around the focus."""
    scale = F.greatest(F.lit(width) / F.col("width"), F.lit(height) / F.col("height"))

    def cut(target: int, at: float) -> Callable[[Column], Column]:
        def offset(n: Column) -> Column:
            free = n - target
            return F.least(free, F.greatest(F.lit(0), half_even(free * float(at)).cast("int")))

        return offset

    return _scaled_into(
        frames, scale, width, height, cut(width, focus[0]), cut(height, focus[1])
    )


def crop_to_ratio(
    frames: DataFrame, width: int, height: int, focus: tuple[float, float] = (0.5, 0.5)
) -> DataFrame:
    """Largest part with the target's aspect, around the focus; pixels are not resampled."""
    ratio = width / height
    w, h = F.col("width"), F.col("height")
    wide = w / h > ratio
    cw = F.when(wide, F.greatest(F.lit(1), half_even(h * ratio).cast("int"))).otherwise(w)
    ch = F.when(wide, h).otherwise(F.greatest(F.lit(1), half_even(w / ratio).cast("int")))
    left = half_even((w - cw) * float(focus[0])).cast("int")
    top = half_even((h - ch) * float(focus[1])).cast("int")
    return crop_frames(frames, left, top, cw, ch)


def crop_frames(
    frames: DataFrame, left: Column, top: Column, width: Column, height: Column
) -> DataFrame:
    """Cut a rectangle out of packed frames."""
    kernel = _pixelwise(
        lambda image, x, y, w, h: _window(image, int(x), int(y), int(w), int(h))
    )
    planned = frames.withColumns({"_x": left, "_y": top, "_w": width, "_h": height})
    done = kernel(*_frame("_x", "_y", "_w", "_h"))
    return _resized(planned, done, F.col("_w"), F.col("_h")).drop("_x", "_y", "_w", "_h")


def pixelate(frames: DataFrame, block: int) -> DataFrame:
    """Shrink by area to one pixel per block, then repeat; any block size."""
    if not 2 <= block <= 128:
        raise ValueError("block must be between 2 and 128")

    def fn(image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        small = np.rint(_resample(image, max(1, w // block), max(1, h // block), "area"))
        return _resample(small, w, h, "nearest")

    return frames.withColumn("rgba", _pixelwise(fn, eight_bit=True)(*_frame()))


# --- blur --------------------------------------------------------------------------------


def gaussian_kernel(size: int, sigma: float | None = None) -> list[float]:
    """Normalised weights; the small sizes have their customary fixed weights."""
    # Kernels of size 1, 3, 5 and 7 when no sigma is given.
    fixed = {
        1: [1.0],
        3: [0.25, 0.5, 0.25],
        5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
        7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
    }
    if sigma is None:
        if size in fixed:
            return fixed[size]
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(raw) for v in raw]


def _convolve(image: np.ndarray, kernel: tuple[float, ...]) -> np.ndarray:
    h, w = image.shape[:2]
    return _separable(image, _mirror(h, kernel), _mirror(w, kernel))


def blur(frames: DataFrame, kernel: int = 3) -> DataFrame:
    """Gaussian blur of 8-bit frames; even sizes go up to the next odd one, at most 31."""
    size = round(kernel)
    if not 1 <= size <= 31:
        raise ValueError("kernel must be between 1 and 31")
    size += 1 - size % 2
    weights = tuple(gaussian_kernel(size))
    smooth = _pixelwise(lambda image: _convolve(image, weights), eight_bit=True)
    return frames.withColumn("rgba", smooth(*_frame()))


def sharpen(frames: DataFrame, amount: float = 1.0) -> DataFrame:
    """(1 + amount) times the frame minus amount times its blur."""
    if not 0.0 <= amount <= 3.0:
        raise ValueError("amount must be between 0 and 3")
    weights = tuple(gaussian_kernel(7, 1.0))

    def fn(image: np.ndarray) -> np.ndarray:
        smooth = np.clip(np.rint(_convolve(image, weights)), 0, 255)
        return image * (1.0 + amount) - smooth * amount

    return frames.withColumn("rgba", _pixelwise(fn, eight_bit=True)(*_frame()))


# --- warps -------------------------------------------------------------------------------


def _sample(
    image: np.ndarray, back: Sequence[float], width: int, height: int, method: str
) -> np.ndarray:
    """Image seen through the 3x3 map ``back`` from target to source positions.

    Positions are taken in steps of 1/32 pixel; outside of the image is zero.
    """
    m = np.asarray(back, dtype=np.float64).reshape(3, 3)
    y, x = np.mgrid[0:height, 0:width].astype(np.float64)
    scale = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    scale = np.where(scale == 0, np.inf, scale)
    sx, sy = (
        np.floor((m[r, 0] * x + m[r, 1] * y + m[r, 2]) / scale * 32.0 + 0.5) / 32.0
        for r in (0, 1)
    )
    x0, y0 = np.floor(sx), np.floor(sy)
    fx, fy = sx - x0, sy - y0
    if method == "linear":
        start, wx, wy = 0, [1 - fx, fx], [1 - fy, fy]
    else:
        start, wx, wy = -1, _cubic_weights(fx), _cubic_weights(fy)
    h, w = image.shape[:2]
    total = np.zeros((height, width, image.shape[2]))
    for j, weight_y in enumerate(wy, start):
        for i, weight_x in enumerate(wx, start):
            px, py = x0 + i, y0 + j
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            taken = image[
                np.clip(py, 0, h - 1).astype(int), np.clip(px, 0, w - 1).astype(int)
            ]
            total += taken * (weight_x * weight_y * inside)[:, :, None]
    return total


def inverse_affine(matrix: Column) -> Column:
    """3x3 map from target to source of a 2x3 matrix; null for singular ones."""
    a, b, c, d, e, f = (F.get(matrix, i) for i in range(6))
    det = a * e - b * d
    usable = F.when(F.abs(det) > 1e-12, det)
    part = lambda v: v / usable
    rows = [e, -b, b * f - c * e, -d, a, c * d - a * f]
    last = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return F.when(usable.isNotNull(), F.array(*[part(v) for v in rows], *last))


def warp(
    frames: DataFrame,
    width: int | None = None,
    height: int | None = None,
    matrix: str = "matrix",
    premultiplied: bool = False,
    method: str = "linear",
) -> DataFrame:
    """Affine warp by the 2x3 ``matrix`` column (source to target), zero outside.

    With ``premultiplied`` the colours are weighted by alpha, which keeps the edges of
    transparent areas clean. Singular matrices leave the frame null.
    """

    def fn(image: np.ndarray, back: np.ndarray, ow: int, oh: int) -> np.ndarray:
        if not premultiplied:
            return _sample(image, back, int(ow), int(oh), method)
        alpha = np.clip(image[:, :, 3:], 0.0, 1.0)
        ready = np.concatenate([image[:, :, :3] * alpha, alpha], axis=2)
        moved = _sample(ready, back, int(ow), int(oh), method)
        alpha = np.clip(moved[:, :, 3:], 0.0, 1.0)
        shown = alpha > 1e-8
        rgb = np.where(shown, moved[:, :, :3] / np.where(shown, alpha, 1.0), 0.0)
        return np.concatenate([np.clip(rgb, 0.0, 1.0), alpha], axis=2)

    ow = F.col("width") if width is None else F.lit(width)
    oh = F.col("height") if height is None else F.lit(height)
    planned = frames.withColumns({"_back": inverse_affine(F.col(matrix)), "_w": ow, "_h": oh})
    done = _pixelwise(fn)(*_frame("_back", "_w", "_h"))
    return _resized(planned, done, F.col("_w"), F.col("_h")).drop("_back", "_w", "_h")


def homography(
    source: Sequence[tuple[float, float]], target: Sequence[tuple[float, float]]
) -> list[float]:
    """3x3 matrix that maps four source points to four target points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target):
        rows.append([x, y, 1, 0, 0, 0, -u * x, -u * y])
        rows.append([0, 0, 0, x, y, 1, -v * x, -v * y])
        values.extend([u, v])
    if np.linalg.matrix_rank(np.array(rows, dtype=float)) < 8:
        raise ValueError("the four points are degenerate")
    return [*np.linalg.solve(np.array(rows, dtype=float), np.array(values, dtype=float)), 1.0]


def warp_perspective(
    frames: DataFrame,
    source: Sequence[tuple[float, float]],
    target: Sequence[tuple[float, float]],
    width: int,
    height: int,
) -> DataFrame:
    """Four-point perspective warp, zero outside."""
    back = np.linalg.inv(np.array(homography(source, target)).reshape(3, 3))
    kernel = _pixelwise(lambda image: _sample(image, back, width, height, "linear"))
    return _resized(frames, kernel(*_frame()), F.lit(width), F.lit(height))


def apply_transform_state(frames: DataFrame, state: str = "state") -> DataFrame:
    """Crop, then scale and turn about the crop's centre, then move.

    ``state`` is a struct column ``x, y, scale, rotation, crop``; identity states only
    crop.
    """
    s = F.col(state)
    cut = crop_frames(frames, *[F.get(s["crop"], i) for i in range(4)])
    still = (s["scale"] == 1.0) & (s["rotation"] == 0.0) & (s["x"] == 0.0) & (s["y"] == 0.0)
    identity = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    turned = rotation_matrix(F.col("width"), F.col("height"), s)
    placed = cut.withColumn("matrix", F.when(still, identity).otherwise(turned))
    return warp(placed).drop("matrix")
