"""Feature modules: functions from vectors to vectors, frame by frame or over neighbouring frames.

Each takes a column with a vector and its dimension and returns the same for its
result. Sums of few products are spelled out, so that they are compiled with the
rest of the stage; larger matrices and Fourier transforms go through Arrow to numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .frames import elements

#: Products up to which a matrix is spelled out.
SPELLED = 600
#: The least power and the mel scale's constants.
POWER_FLOOR, MEL_HZ, MEL_SCALE = 1e-10, 1400.0, 2595.0

Vector = tuple[Column, int]


def _sum(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def matrix_times(x: Column, dim: int, matrix: np.ndarray, bias: Sequence[float] | None = None, floor: float | None = None) -> Vector:
    """A x + b, no element below `floor`."""
    rows = len(matrix)
    b = [0.0] * rows if bias is None else [float(v) for v in bias]
    if rows * dim <= SPELLED:
        parts = elements(x, dim)
        out = []
        for row, shift in zip(matrix.tolist(), b, strict=True):
            terms = [p * F.lit(float(c)) for p, c in zip(parts, row, strict=True) if c]
            y = _sum([*terms, F.lit(shift)]) if terms else F.lit(shift)
            out.append(y if floor is None else F.greatest(y, F.lit(floor)))
        return F.array(*out), rows
    a, shift = np.asarray(matrix, float), np.array(b)

    @F.pandas_udf("array<double>")
    def apply(s: pd.Series) -> pd.Series:
        y = np.stack(s.to_numpy()) @ a.T + shift if len(s) else np.zeros((0, rows))
        return pd.Series(list(y if floor is None else np.maximum(y, floor)))

    return apply(x), rows


def normalization(x: Column, dim: int, mean: Sequence[float], scale: Sequence[float]) -> Vector:
    """(x - mean) * scale."""
    return F.array(*[(p - F.lit(float(m))) * F.lit(float(s)) for p, m, s in zip(elements(x, dim), mean, scale, strict=True)]), dim


def lin_transform(x: Column, dim: int, matrix: Sequence[float] | None = None, bias: Sequence[float] | None = None) -> Vector:
    """A x + b with A given row by row; identity and zero unless given."""
    a = np.eye(dim) if matrix is None else np.array(matrix, float).reshape(-1, dim)
    return matrix_times(x, dim, a, bias)


def power(x: Column, dim: int) -> Vector:
    """Natural logarithm of the sum."""
    return F.array(F.log(_sum(elements(x, dim)) + F.lit(POWER_FLOOR))), 1


def mel_power(x: Column, dim: int) -> Vector:
    """Natural logarithm of the sum of exponentials."""
    return F.array(F.log(_sum([F.exp(p) for p in elements(x, dim)]) + F.lit(POWER_FLOOR))), 1


def dct_matrix(dim: int, out: int, zeroth: bool = False) -> np.ndarray:
    rows = [[math.cos((i + 1) * (b + 0.5) * math.pi / dim) for b in range(dim)] for i in range(out - zeroth)]
    return np.array(rows + [[1.0] * dim] * zeroth)


def dct(x: Column, dim: int, out: int, zeroth: bool = False) -> Vector:
    """Cosine transform without scaling; with `zeroth` the sum takes the last place."""
    return matrix_times(x, dim, dct_matrix(dim, out, zeroth))


def mel_dim(sample_rate: float) -> int:
    return int(23 * math.log10(1 + sample_rate / MEL_HZ) / math.log10(1 + 16000 / MEL_HZ) - 2)


def mel_matrix(dim: int, sample_rate: float, bins: int | None = None) -> np.ndarray:
    """Triangles on the mel scale, each divided by the sum of its weights."""
    bins = mel_dim(sample_rate) if bins is None else bins
    step = MEL_SCALE * math.log10(1 + sample_rate / MEL_HZ) / (bins + 2)
    edge = [MEL_HZ * (10 ** ((i + 1) * step / MEL_SCALE) - 1) * (dim - 1) / sample_rate for i in range(bins + 2)]
    out = np.zeros((bins, dim))
    for b in range(bins):
        low, top, high = edge[b] - 1, edge[b + 1], edge[b + 2]
        t = np.arange(max(math.ceil(low), 0), dim)
        rising, falling = (t - low) / (top - low), (high - t) / (high - top)
        out[b, t] = np.where(t < top, rising, np.where(t < high, falling, 0.0))
    total = out.sum(1, keepdims=True)
    return out / np.where(total > 0, total, 1.0)


def mel(x: Column, dim: int, sample_rate: float, root: bool = False, bins: int | None = None) -> Vector:
    """Logarithm of one plus each mel bin, or its tenth root."""
    y, n = matrix_times(x, dim, mel_matrix(dim, sample_rate, bins))
    return F.transform(y, lambda v: F.pow(v, F.lit(0.1)) if root else F.log(v + F.lit(1.0))), n


def fft(x: Column, dim: int, magnitude: bool = True, log: bool = False) -> Vector:
    """Power spectrum under a Hamming window, or its root; then perhaps its logarithm."""
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(dim) / max(1, dim - 1))

    @F.pandas_udf("array<double>")
    def spectrum(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        y = np.abs(np.fft.rfft(np.stack(s.to_numpy()) * window, axis=1)) ** (1 if magnitude else 2)
        return pd.Series(list(np.log(np.maximum(y, 1e-50)) if log else y))

    return spectrum(x), dim // 2 + 1


def merge(*vectors: Vector) -> Vector:
    return F.concat(*[x for x, _ in vectors]), sum(n for _, n in vectors)


def quanteq(x: Column, dim: int, alpha: Sequence[float], gamma: Sequence[float], top: Sequence[float]) -> Vector:
    """Quantile equalization q (a (x/q)^g + (1-a) x/q), as it is fitted."""
    out = []
    for p, a, g, q in zip(elements(x, dim), alpha, gamma, top, strict=True):
        y = p / F.lit(float(q))
        out.append(F.lit(float(q)) * (F.lit(float(a)) * F.pow(y, F.lit(float(g))) + F.lit(float(1 - a)) * y))
    return F.array(*out), dim


def sinc(t: np.ndarray) -> np.ndarray:
    return np.sinc(np.asarray(t, float))


def interpolation_matrix(places: np.ndarray, dim: int, radius: int, lanczos: bool = True) -> np.ndarray:
    """Rows that read a vector at places between its elements; radius 0 is linear."""
    out = np.zeros((len(places), dim))
    for b, at in enumerate(places):
        if radius:
            cent = int(at + 0.5)
            i = np.arange(max(cent - radius, 0), min(cent + radius + 1, dim))
            c = sinc(i - at)
            if lanczos:
                c = np.where(np.abs(i - at) < radius, c * sinc((i - at) / radius), 0.0)
            out[b, i] = c
        else:
            low, high = int(math.floor(at)), min(int(math.ceil(at)), dim - 1)
            out[b, low] += math.ceil(at) - at if high != low else 1.0
            if high != low:
                out[b, high] += 1 - (math.ceil(at) - at)
    return out


def warped_bins(dim: int, warp: float = 1.0, kind: str = "pwlin", turn: float = 0.8, params: Sequence[float] = ()) -> np.ndarray:
    """Where each spectral bin is read from: piecewise linear, bilinear or sines of the all-pass family."""
    t, last = np.arange(dim, dtype=float), dim - 1
    if kind == "blin":
        w = np.pi * t / last
        out = t + 2 * np.arctan2((warp - 1) * np.sin(w), 1 + (1 - warp) * np.cos(w)) / np.pi * last
    elif kind == "slapt":
        out = t + sum(p * np.sin((i + 1) * np.pi * t / last) * last for i, p in enumerate(params))
    else:
        out = warp * t
        border = turn * last
        bend = np.flatnonzero((t >= border) | (out >= border))
        if len(bend) and bend[0] < last:
            k = bend[0]
            out[k:] = out[k] + (last - out[k]) / (last - k) * (t[k:] - k)
    out[-1] = last
    return out


def vtln(x: Column, dim: int, warp: float = 1.0, kind: str = "pwlin", radius: int = 8, lanczos: bool = True, turn: float = 0.8, params: Sequence[float] = ()) -> Vector:
    """A warped spectrum, not below 0 where it is interpolated by sinc."""
    a = interpolation_matrix(warped_bins(dim, warp, kind, turn, params), dim, radius, lanczos)
    return matrix_times(x, dim, a, floor=0.0 if radius else None)


def vtln_all_pass(x: Column, dim: int, warp: float) -> Vector:
    """Bilinear warping of cepstra: back to the spectrum, read at warped places, and to cepstra again."""
    return matrix_times(x, dim, all_pass_matrix(dim, warp))


def all_pass_matrix(dim: int, warp: float) -> np.ndarray:
    grid = 8 * dim
    w = np.pi * (np.arange(grid) + 0.5) / grid
    bent = w + 2 * np.arctan2((warp - 1) * np.sin(w), 1 + (1 - warp) * np.cos(w))
    order = np.arange(1, dim + 1)
    return 2 / grid * np.cos(np.outer(order, w)) @ np.cos(np.outer(bent, order))


def sr_norm(x: Column, dim: int, in_frames: int, out_frames: int, rate: float, order: int = 4) -> Vector:
    """A supervector of `in_frames` frames read at another speech rate, not below 0."""
    width = dim // in_frames
    places = (np.arange(out_frames) - (out_frames - 1) / 2) / rate + (in_frames - 1) / 2
    a = interpolation_matrix(places, in_frames, order)
    return matrix_times(x, dim, np.kron(a, np.eye(width)), floor=0.0)


def delta(x: Column, dim: int, w: WindowSpec, width: int = 2) -> Vector:
    """Slope of a line through 2 width + 1 frames: later minus earlier ones."""
    norm = width * (width + 1) * (2 * width + 1) / 3
    out = []
    for i in range(dim):
        p = F.element_at(x, i + 1)
        out.append(_sum([(F.lead(p, k).over(w) - F.lag(p, k).over(w)) * F.lit(float(k)) for k in range(1, width + 1)]) / F.lit(norm))
    return F.array(*out), dim


def mean_subtractor(x: Column, dim: int, w: WindowSpec, left: int = 75, right: int = 75) -> Vector:
    """x less its mean over the frames from `left` before to `right` after."""
    near = w.rowsBetween(-left, right)
    return F.array(*[p - F.avg(p).over(near) for p in elements(x, dim)]), dim


def concat(x: Column, dim: int, w: WindowSpec, left: int, right: int) -> Vector:
    """The vectors from `left` frames before to `right` after, in one; null where one of them is not there, as at the edges of what was padded."""
    near = F.flatten(F.collect_list(x).over(w.rowsBetween(-left, right)))
    return F.when(F.size(near) == dim * (left + right + 1), near), dim * (left + right + 1)
