"""Image decoding, resizing, normalising and blurring on numpy arrays, and their Arrow wrappers.

Images are [h, w, 3] bytes.  Portable pixmaps (PPM and PGM) are decoded here; other formats need
Pillow, which is used if it is installed.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.errors import CompileError

#: How a model wants its pixels: (subtract, divide by) (fixed values).
NORMALISATIONS = {"detector": (127.0, 128.0), "embedder": (127.5, 127.5), "embedder_128": (127.5, 128.0), "unit": (0.0, 255.0), "none": (0.0, 1.0)}
#: Boxes of at most that many pixels on a side are not blurred.
SMALL_BOX = 5


def decode(data: bytes) -> np.ndarray:
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at) + 1
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, top = fields
        if top > 255:
            raise ValueError("more than eight bits a sample")
        deep = 3 if data[:2] == b"P6" else 1
        pixels = np.frombuffer(data, np.uint8, w * h * deep, at + 1).reshape(h, w, deep)
        return np.repeat(pixels, 3, 2) if deep == 1 else pixels
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("only PPM and PGM images can be read without Pillow") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def encode_ppm(image: np.ndarray) -> bytes:
    return f"P6\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


def resize(image: np.ndarray, width: int, height: int, method: str = "nearest") -> np.ndarray:
    """Nearest pixel, or the mean over the box that a pixel covers."""
    h, w = image.shape[:2]
    if method == "nearest":
        y = np.minimum((np.arange(height) + 0.5) * h / height, h - 1).astype(int)
        x = np.minimum((np.arange(width) + 0.5) * w / width, w - 1).astype(int)
        return image[y][:, x]
    if method != "box":
        raise CompileError(f"unknown resize {method!r}")

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(n) + 1)
        own = np.clip(high - low, 0, None)
        return own / own.sum(1, keepdims=True)

    out = np.einsum("yh,hwc,xw->yxc", weights(h, height), image.astype(np.float64), weights(w, width), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def letterboxed(image: np.ndarray, size: int = 640, pad: int = 114) -> np.ndarray:
    h, w = image.shape[:2]
    scale = min(size / w, size / h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    out = np.full((size, size, 3), pad, np.uint8)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = resize(image, nw, nh)
    return out


def to_tensor(image: np.ndarray, normalisation: str = "unit") -> np.ndarray:
    """[3, h, w] floats."""
    less, by = NORMALISATIONS[normalisation]
    return ((image.astype(np.float32) - less) / by).transpose(2, 0, 1)


def _kernel(sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
    n = image.shape[axis]
    return sum(k * np.take(padded, np.arange(i, i + n), axis) for i, k in enumerate(kernel))


def blur(image: np.ndarray, strength: float, method: str = "gaussian") -> np.ndarray:
    kernels = {"gaussian": [_kernel(strength)], "box": [np.full(2 * max(1, int(strength)) + 1, 1.0)], "fast": [np.full(2 * max(1, int(strength / 2)) + 1, 1.0)] * 3}
    if method not in kernels:
        raise CompileError(f"unknown blur {method!r}")
    out = image.astype(np.float64)
    for k in kernels[method]:
        out = _along(_along(out, k / k.sum(), 0), k / k.sum(), 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def blur_regions(image: np.ndarray, boxes: list, strength: float = 10.0, method: str = "gaussian") -> np.ndarray:
    """A copy with boxes [x1, y1, x2, y2] blurred; boxes without area or of at most five pixels a side stay."""
    out = image.copy()
    for box in boxes:
        x1, y1, x2, y2 = (int(v) for v in box)
        if x2 - x1 <= SMALL_BOX or y2 - y1 <= SMALL_BOX:
            continue
        own = np.s_[max(0, y1) : y2, max(0, x1) : x2]
        if out[own].size:
            out[own] = blur(out[own], strength, method)
    return out


def blurred(df: DataFrame, shape: str, data: str, boxes: str, name: str = "blurred_img", strength: float = 10.0, method: str = "gaussian") -> DataFrame:
    """``df`` with its images' boxes blurred; null images stay null."""

    @F.pandas_udf("binary")
    def run(shapes, buffers, regions):
        import pandas as pd

        out = []
        for s, b, r in zip(shapes, buffers, regions, strict=True):
            if s is None or b is None:
                out.append(None)
                continue
            image = np.frombuffer(b, np.uint8).reshape(tuple(int(v) for v in s))
            out.append(blur_regions(image, list(r) if r is not None else [], strength, method).tobytes())
        return pd.Series(out)

    return df.withColumn(name, run(F.col(shape), F.col(data), F.col(boxes)))


def tensors(df: DataFrame, shape: str, data: str, name: str, width: int, height: int, normalisation: str, method: str = "nearest", boxed: bool = False) -> DataFrame:
    """``df`` with images resized and normalised as flat [3, height, width] floats."""

    @F.pandas_udf("array<float>")
    def run(shapes, buffers):
        import pandas as pd

        out = []
        for s, b in zip(shapes, buffers, strict=True):
            if s is None or b is None:
                out.append(None)
                continue
            image = np.frombuffer(b, np.uint8).reshape(tuple(int(v) for v in s))
            image = letterboxed(image, width) if boxed else resize(image, width, height, method)
            out.append(to_tensor(image, normalisation).ravel().tolist())
        return pd.Series(out)

    return df.withColumn(name, run(F.col(shape), F.col(data)))
