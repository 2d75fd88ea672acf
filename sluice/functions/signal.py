"""Spectral features of signals and images, with numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import CompileError

#: Buckets of the histogram, noise floor, share of samples that must survive it, and the floor otherwise (fixed values).
BUCKETS, FLOOR, LEAST_SHARE, LOW_FLOOR = 5, 0.05, 0.05, 0.01


def channel_features(signal: np.ndarray) -> np.ndarray:
    """Histogram of the magnitudes above the noise floor, and its upper edges.

    The greatest magnitude lies on the last edge and is in no bucket.
    """
    magnitude = np.abs(np.fft.fft(signal.astype(np.float32))).astype(np.float32)
    top = magnitude.max()
    loud = magnitude[magnitude >= top * np.float32(FLOOR)]
    if len(loud) <= LEAST_SHARE * len(signal):
        loud = magnitude[magnitude >= top * np.float32(LOW_FLOOR)]
    low = loud.min()
    width = (loud.max() - low) / np.float32(BUCKETS)
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.floor((loud - low) / width)
    # 0 / 0 counts as bucket 0, as a float to integer conversion of NaN does there.
    place = np.where(np.isnan(place), 0, place)
    histogram = np.bincount(place[place < BUCKETS].astype(int), minlength=BUCKETS).astype(np.float32)
    return np.concatenate([histogram, low + np.arange(1, BUCKETS + 1, dtype=np.float32) * width])


def fft_features(sequence: str, channels: int = 12) -> Column:
    """Ten features a channel of a flat [samples, channels] array; null if its length does not fit."""

    @F.pandas_udf("array<float>")
    def features(values):
        import pandas as pd

        out = []
        for v in values:
            x = None if v is None else np.asarray(v, np.float32)
            fits = x is not None and len(x) and len(x) % channels == 0
            out.append(np.concatenate([channel_features(c) for c in x.reshape(-1, channels).T]).tolist() if fits else None)
        return pd.Series(out)

    return features(F.col(sequence))


# --- images ----------------------------------------------------------------------------------

#: Rows sampled, rows averaged into one, transform length (fixed values).
STRATEGIES = {"baseline": (8, 1, 512), "thirds": (9, 3, 512), "luma_only": (8, 1, 512), "fft1024": (8, 1, 1024), "more_rows": (16, 1, 512)}
CONTRAST = 3
PEAKS = 5


def sampled_rows(height: int, n: int) -> np.ndarray:
    """Evenly spaced between a tenth and nine tenths of the height."""
    if n == 1:
        return np.array([height // 2])
    first, last = int(np.float32(height) * np.float32(0.1)), int(np.float32(height) * np.float32(0.9))
    return first + np.arange(n) * max(0, last - first) // (n - 1)


def resample(rows: np.ndarray, n: int) -> np.ndarray:
    """Each row at ``n`` points, linearly; no columns give zeros."""
    if not rows.shape[1]:
        return np.zeros((len(rows), n), np.float32)
    at = np.arange(n, dtype=np.float32) * np.float32((rows.shape[1] - 1) / max(n - 1, 1))
    low = np.floor(at)
    t = (at - low).astype(np.float32)
    i = np.minimum(low.astype(int), rows.shape[1] - 1)
    j = np.minimum(i + 1, rows.shape[1] - 1)
    return rows[:, i] * (1 - t) + rows[:, j] * t


def spectrum_stats(rows: np.ndarray, n: int) -> np.ndarray:
    """The five strongest of the mean spectrum, their frequencies, and the share of high frequencies."""
    return _spectra(rows[None], n)[0]


def _spectra(rows: np.ndarray, n: int) -> np.ndarray:
    """As :func:`spectrum_stats`, for each of [images, rows, columns]."""
    m, k, w = rows.shape
    spectrum = np.abs(np.fft.rfft(resample(rows.reshape(m * k, w).astype(np.float32), n), axis=1)).reshape(m, k, -1).mean(1)
    peaks = spectrum.copy()
    peaks[:, 0] = 0
    order = _strongest(peaks)
    # Summed image by image: a sum over an axis adds in another order.
    total, high = (np.array([one[low:].sum() for one in spectrum], np.float32) for low in (1, n // 20))
    share = np.divide(high, total, out=np.zeros_like(total), where=total > 0)
    return np.concatenate([np.take_along_axis(peaks, order, 1), order / n, share[:, None]], axis=1).astype(np.float32)


def _strongest(peaks: np.ndarray) -> np.ndarray:
    """Places of the greatest of each row, one after another: of equal ones the first."""
    left, at = peaks.copy(), np.arange(len(peaks))
    out = np.empty((len(peaks), PEAKS), np.int64)
    for i in range(PEAKS):
        out[:, i] = left.argmax(1)
        left[at, out[:, i]] = -1
    return out


def image_features(image: np.ndarray, strategy: str = "thirds") -> np.ndarray:
    """59 features of an [h, w, 3] image, or 26 with ``luma_only``."""
    return features_of_images(image[None], strategy)[0]


def features_of_images(images: np.ndarray, strategy: str = "thirds") -> np.ndarray:
    """As :func:`image_features`, for each of [images, h, w, 3]."""
    if strategy not in STRATEGIES:
        raise CompileError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    n_rows, averaged, n = STRATEGIES[strategy]
    m, h, w = images.shape[:3]
    rows = images[:, sampled_rows(h, n_rows)].astype(np.float32)
    rows = rows.reshape(m, n_rows // averaged, averaged, w, 3).mean(2)
    luma = rows.mean(3)
    contrast = np.abs(luma[:, :, CONTRAST:] - luma[:, :, : max(0, w - CONTRAST)])
    channels = [luma, contrast] if strategy == "luma_only" else [luma, *(rows[..., c] for c in range(3)), contrast]
    sizes = np.broadcast_to(np.array([w, h, w * h, w / h], np.float32), (m, 4))
    return np.concatenate([sizes, *(_spectra(c, n) for c in channels)], axis=1)


#: Pixels of images that are worked on together.
TILE_PIXELS = 1 << 14


def with_image_features(df: DataFrame, shape: str, data: str, strategy: str = "thirds", name: str = "features") -> DataFrame:
    """``df`` with the features of images given as shape [h, w, 3] and bytes; null where they do not fit.

    Images of one shape in a batch are worked on together.
    """

    @F.pandas_udf("array<float>")
    def features(shapes, buffers):
        import pandas as pd

        out, alike = [None] * len(shapes), {}
        for i, (s, b) in enumerate(zip(shapes, buffers, strict=True)):
            size = () if s is None or b is None else tuple(s.tolist() if isinstance(s, np.ndarray) else s)
            if len(size) == 3 and size[2] == 3 and size[0] * size[1] * 3 == len(b) > 0:
                alike.setdefault((int(size[0]), int(size[1]), 3), []).append((i, b))
        for size, found in alike.items():
            step = max(1, TILE_PIXELS // (size[0] * size[1]))
            for at in range(0, len(found), step):
                part = found[at : at + step]
                images = np.frombuffer(b"".join(b for _, b in part), np.uint8).reshape(len(part), *size)
                for (i, _), f in zip(part, features_of_images(images, strategy), strict=True):
                    out[i] = f
        return pd.Series(out)

    return df.withColumn(name, features(F.col(shape), F.col(data)))
