"""Raster arithmetic on struct(data, w, h), with numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")]))
GRID = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())])


def grid(img) -> np.ndarray:
    """Height x width x channels; bytes are row-major."""
    h, w = int(img["h"]), int(img["w"])
    return np.frombuffer(img["data"], dtype=np.uint8).reshape(h, w, -1)


def pack(a: np.ndarray) -> dict:
    return {"data": np.ascontiguousarray(a, dtype=np.uint8).tobytes(), "w": a.shape[1], "h": a.shape[0]}


def row_runs(dark: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Runs of rows with enough dark pixels; one blank row is bridged."""
    active = np.flatnonzero(dark >= least)
    if not len(active):
        return []
    cuts = np.flatnonzero(np.diff(active) > 2)
    return list(zip(active[np.append(0, cuts + 1)].tolist(), active[np.append(cuts, len(active) - 1)].tolist(), strict=True))


def text_rows(a: np.ndarray, threshold: int = 128) -> list[dict]:
    """Boxes of text rows, padded and clipped; flat wide rules are no text."""
    dark = a[:, :, 0] < threshold
    h, w = dark.shape
    out = []
    for top, bottom in row_runs(dark.sum(axis=1)):
        columns = np.flatnonzero(dark[top : bottom + 1].any(axis=0))
        left, right = int(columns[0]), int(columns[-1]) + 1
        if bottom - top + 1 <= 3 and right - left > 0.9 * w:
            continue
        out.append({"x0": max(left - 3, 0), "y0": max(top - 2, 0), "x1": min(right + 4, w), "y1": min(bottom + 1 + 2, h)})
    return out


def components8(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, ends exclusive) of 8-connected components, by runs
    of each row joined to the overlapping runs of the row before."""
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    boxes: list[list[int]] = []
    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for x0, x1 in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            me = len(root)
            root.append(me)
            boxes.append([x0, y, x1, y + 1])
            for a0, a1, label in above:
                if a0 <= x1 and x0 <= a1:  # corners touch
                    root[find(label)] = find(me)
            here.append((x0, x1, me))
        above = here
    merged: dict[int, list[int]] = {}
    for i, b in enumerate(boxes):
        m = merged.setdefault(find(i), list(b))
        m[:] = [min(m[0], b[0]), min(m[1], b[1]), max(m[2], b[2]), max(m[3], b[3])]
    return sorted(map(tuple, merged.values()), key=lambda b: (b[1], b[0]))


def resize(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return np.rint(top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy).astype(np.uint8)


def resize_area(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Whole-number means over the boxes that a smaller picture's pixels cover;
    bilinear where the picture does not shrink both ways."""
    if w >= a.shape[1] or h >= a.shape[0]:
        return resize(a, w, h)
    ys, xs = ((np.arange(n + 1) * (size / n)).astype(int) for n, size in ((h, a.shape[0]), (w, a.shape[1])))
    sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1, a.shape[2]), dtype=np.int64)
    sums[1:, 1:] = a.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    top, bottom, left, right = ys[:-1], ys[1:], xs[:-1], xs[1:]
    box = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    return (box // ((bottom - top)[:, None] * (right - left)[None, :])[:, :, None]).astype(np.uint8)


def crop(a: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """The part of a picture inside a box, which is clipped to it."""
    return a[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)]


def tensor(a: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    """Channel planes of (x / 255 - mean) / std in float32."""
    x = (a.astype(np.float32) / 255 - np.array(mean, dtype=np.float32)) / np.array(std, dtype=np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1))


def bright_border(a: np.ndarray, strip: int = 4, least: float = 230.0) -> bool:
    """Whether all four border strips average brighter than a limit."""
    g = a[:, :, 0].astype(np.float64)
    return all(s.mean() > least for s in (g[:strip], g[-strip:], g[:, :strip], g[:, -strip:]))


def rect_mean(a: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> float:
    return float(a[y0:y1, x0:x1, 0].mean()) if x1 > x0 and y1 > y0 else 0.0


def skew_angle(a: np.ndarray, threshold: int = 128) -> float:
    """The angle (-6 to 6 by half degrees) whose row profile varies most, the first on ties."""
    ys, xs = np.nonzero(a[:, :, 0] < threshold)
    best, found = 0.0, -1.0
    for angle in np.arange(-6, 6.5, 0.5):
        rows = np.rint(ys * np.cos(np.radians(angle)) - xs * np.sin(np.radians(angle))).astype(int)
        profile = np.bincount(rows - rows.min()) if len(rows) else np.zeros(1)
        if profile.var() > found:
            best, found = float(angle), float(profile.var())
    return best


@F.pandas_udf(BOX)
def text_row_boxes(img: pd.DataFrame) -> pd.Series:
    return pd.Series([text_rows(grid(i)) for i in img.to_dict("records")])


@F.pandas_udf(BOX)
def component_boxes(img: pd.DataFrame) -> pd.Series:
    return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in components8(grid(i)[:, :, 0] > 0)] for i in img.to_dict("records")])


@F.pandas_udf(GRID)
def resized(img: pd.DataFrame, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pack(resize(grid(i), int(a), int(b))) for i, a, b in zip(img.to_dict("records"), w, h, strict=True)])


@F.pandas_udf(GRID)
def shrunk(img: pd.DataFrame, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pack(resize_area(grid(i), int(a), int(b))) for i, a, b in zip(img.to_dict("records"), w, h, strict=True)])


@F.pandas_udf(GRID)
def cropped(img: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([pack(crop(grid(i), *(int(b[c]) for c in ("x0", "y0", "x1", "y1")))) for i, b in zip(img.to_dict("records"), box.to_dict("records"), strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def tensor_planes(img: pd.DataFrame) -> pd.Series:
    """Channel planes, one after another, with mean and deviation 0.5."""
    return pd.Series([tensor(g, [0.5] * g.shape[2], [0.5] * g.shape[2]).astype(np.float64).ravel().tolist() for g in map(grid, img.to_dict("records"))])


@F.pandas_udf(T.DoubleType())
def skew(img: pd.DataFrame) -> pd.Series:
    return pd.Series([skew_angle(grid(i)) for i in img.to_dict("records")])


@F.pandas_udf(T.BooleanType())
def has_bright_border(img: pd.DataFrame) -> pd.Series:
    return pd.Series([bright_border(grid(i)) for i in img.to_dict("records")])
