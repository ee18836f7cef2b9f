"""Page images as numpy arrays in Arrow batches: one map over ``pages``, never a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.png import decode_png, encode_png
from ..schema import PAGES

def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return a.reshape(height, width) if channels == 1 else a.reshape(height, width, channels)


def to_gray(img: np.ndarray) -> np.ndarray:
    """Blue, green, red to luminance; gray stays."""
    return img if img.ndim == 2 else np.rint(img[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def to_bgr(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2)


def otsu(gray: np.ndarray) -> int:
    """The threshold with the largest variance between the two sides."""
    h = np.bincount(gray.ravel(), minlength=256).astype(float)
    n, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n))
    return int(np.nanargmax(np.where(np.isfinite(v), v, -1)))


def binarize(gray: np.ndarray, method: str = "otsu", window: int = 31, offset: float = 10, k: float = 0.2) -> np.ndarray:
    """none, otsu, adaptive (local mean less an offset) or sauvola; ValueError for another name."""
    if method == "none":
        return gray
    if method == "otsu":
        return np.where(gray > otsu(gray), 255, 0).astype(np.uint8)
    if method not in ("adaptive", "sauvola"):
        raise ValueError(f"unknown method: {method}")
    mean = box_mean(gray.astype(float), window)
    if method == "adaptive":
        limit = mean - offset
    else:
        dev = np.sqrt(np.maximum(box_mean(gray.astype(float) ** 2, window) - mean**2, 0))
        limit = mean * (1 + k * (dev / 128 - 1))
    return np.where(gray > limit, 255, 0).astype(np.uint8)


def box_mean(a: np.ndarray, window: int) -> np.ndarray:
    r = window // 2
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    w = 2 * r + 1
    return (p[w:, w:] - p[:-w, w:] - p[w:, :-w] + p[:-w, :-w]) / w**2


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, nearest pixel, white outside."""
    h, w = img.shape[:2]
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sx, sy = np.rint(np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2).astype(int), np.rint(np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(img, 255)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def estimate_skew(gray: np.ndarray, most: float = 10.0, step: float = 0.5) -> float:
    """The rotation whose row profile of ink has the largest squared differences."""
    ink = (gray <= otsu(gray)).astype(np.uint8) * 255
    angles = np.arange(-most, most + step / 2, step)
    score = [(np.diff((255 - rotate(255 - ink, a)).sum(1, dtype=float)) ** 2).sum() for a in angles]
    return float(angles[int(np.argmax(score))])


def deskew(img: np.ndarray) -> tuple[np.ndarray, float]:
    angle = estimate_skew(to_gray(img))
    return (img, 0.0) if abs(angle) < 0.1 else (rotate(img, angle), angle)


def limit_size(img: np.ndarray, longest: int = 2500) -> tuple[np.ndarray, float]:
    """Scaled down by whole averaging steps or nearest pixels so that no side is longer; and the scale."""
    scale = min(1.0, longest / max(img.shape[:2]))
    if scale == 1.0:
        return img, 1.0
    y = (np.arange(int(img.shape[0] * scale)) / scale).astype(int)
    x = (np.arange(int(img.shape[1] * scale)) / scale).astype(int)
    return img[y][:, x], scale


def crop(img: np.ndarray, box: tuple[float, float, float, float], pad: int = 0) -> np.ndarray | None:
    x1, y1 = max(0, int(box[0]) - pad), max(0, int(box[1]) - pad)
    x2, y2 = min(img.shape[1], int(box[2]) + pad), min(img.shape[0], int(box[3]) + pad)
    return None if x2 - x1 < 2 or y2 - y1 < 2 else img[y1:y2, x1:x2]


def auto_crop(img: np.ndarray, pad: int = 12, least: float = 0.05) -> np.ndarray:
    """Cut to the ink's box and a margin; as it is where that holds under 5 % of the page or nothing."""
    gray = to_gray(img)
    ink = gray <= otsu(gray) if gray.min() < gray.max() else np.zeros_like(gray, bool)
    ys, xs = np.nonzero(ink)
    if not len(ys) or (np.ptp(ys) + 1) * (np.ptp(xs) + 1) < least * gray.size:
        return img
    return img[max(0, ys.min() - pad) : ys.max() + pad + 1, max(0, xs.min() - pad) : xs.max() + pad + 1]


def median(gray: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    p = np.pad(gray, r, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3)).astype(np.uint8)


def stretch(gray: np.ndarray) -> np.ndarray:
    """Contrast by percentiles; stands in for tile-wise equalisation, which needs an image library."""
    lo, hi = np.percentile(gray, [1, 99])
    return gray if hi <= lo else np.clip((gray - lo) * (255.0 / (hi - lo)), 0, 255).astype(np.uint8)


def ink_ratio(gray: np.ndarray, threshold: int | None = None) -> float:
    return float((gray <= (otsu(gray) if threshold is None else threshold)).mean()) if gray.size else 0.0


def find_boxes(gray: np.ndarray, height: float) -> list[tuple[int, int, int, int]]:
    """Empty or ticked squares by their frames: sides 0.45 to 2 label heights, aspect 0.6 to 1.7."""
    ink = gray < 128
    out, (h, w) = [], gray.shape
    low, high = max(4, int(0.45 * height)), int(2.0 * height)
    run = np.zeros((h, w + 1), int)
    for x in range(w - 1, -1, -1):
        run[:, x] = np.where(ink[:, x], run[:, x + 1] + 1, 0)
    down = np.zeros((h + 1, w), int)
    for y in range(h - 1, -1, -1):
        down[y] = np.where(ink[y], down[y + 1] + 1, 0)
    start = ink & ~np.pad(ink, ((0, 0), (1, 0)))[:, :-1] & ~np.pad(ink, ((1, 0), (0, 0)))[:-1]
    for y, x in zip(*np.nonzero(start & (run[:, :-1] >= low) & (down[:-1] >= low))):
        bw, bh = run[y, x], down[y, x]
        if low <= bw <= high and low <= bh <= high and 0.6 <= bw / bh <= 1.7 and down[y, x + bw - 1] >= 0.9 * bh and run[min(y + bh - 1, h - 1), x] >= 0.9 * bw:
            out.append((int(x), int(y), int(x + bw), int(y + bh)))
    return out


def ticked(gray: np.ndarray, box: tuple[int, int, int, int], least: float = 0.05) -> bool:
    """Whether the middle half of a box holds ink."""
    x1, y1, x2, y2 = box
    dx, dy = (x2 - x1) // 4, (y2 - y1) // 4
    return ink_ratio(gray[y1 + dy : y2 - dy, x1 + dx : x2 - dx], 128) > least


def signed(gray: np.ndarray, label: tuple[float, float, float, float], least: float = 0.004) -> bool:
    """Whether the space below a label, from 0.2 to 3.2 label heights (8 pixels at least) and 1.2 wider at each side, holds ink."""
    h = max(label[3] - label[1], 8.0)
    area = crop(gray, (label[0] - 1.2 * h, label[3] + 0.2 * h, label[2] + 1.2 * h, label[3] + 3.2 * h))
    return area is not None and float(dark(area).mean()) > least


def dark(gray: np.ndarray) -> np.ndarray:
    """Where an image is ink by its own threshold; nowhere if it has one shade."""
    return gray <= otsu(gray) if gray.min() < gray.max() else np.zeros_like(gray, bool)


def outlines(ink: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes around the connected parts of the ink (corners touch), without those inside another's box."""
    part: list[int] = []
    box: list[list[int]] = []
    above: list[tuple[int, int, int]] = []

    def root(k: int) -> int:
        while part[k] != k:
            k = part[k]
        return k

    for y, row in enumerate(ink):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).tolist()
        here = []
        for x1, x2 in zip(edge[::2], edge[1::2]):
            touched = sorted({root(k) for a1, a2, k in above if a1 <= x2 and x1 <= a2})
            if not touched:
                touched = [len(part)]
                part.append(len(part))
                box.append([x1, y, x2, y + 1])
            k = touched[0]
            for other in [[x1, y, x2, y + 1], *(box[t] for t in touched[1:])]:
                box[k] = [min(box[k][0], other[0]), min(box[k][1], other[1]), max(box[k][2], other[2]), max(box[k][3], other[3])]
            for t in touched[1:]:
                part[t] = k
            here.append((x1, x2, k))
        above = here
    whole = [tuple(box[k]) for k in range(len(part)) if part[k] == k]
    inside = lambda a, b: a != b and b[0] <= a[0] and b[1] <= a[1] and a[2] <= b[2] and a[3] <= b[3]
    return [a for a in whole if not any(inside(a, b) for b in whole)]


def box_ink(gray: np.ndarray, label: tuple[float, float, float, float]) -> float | None:
    """The share of ink in the middle half of the box or circle to the left of a label; None where there is none.

    It is looked for within 2.4 label heights (6 pixels at least); its height is 0.45 to 2 of them, its
    aspect 0.6 to 1.7, and the one nearest to the label counts.
    """
    h = max(label[3] - label[1], 6.0)
    area = crop(gray, (label[0] - 2.4 * h, label[1] - 0.3 * h, label[0] + 0.3 * h, label[3] + 0.3 * h))
    if area is None:
        return None
    sizes = [(x1, y1, x2 - x1, y2 - y1) for x1, y1, x2, y2 in outlines(dark(area))]
    fit = [s for s in sizes if min(s[2:]) >= 4 and 0.6 <= s[2] / s[3] <= 1.7 and 0.45 * h <= s[3] <= 2.0 * h]
    if not fit:
        return None
    x, y, w, tall = max(fit, key=lambda s: s[0])
    middle = area[y + tall // 4 : y + 3 * tall // 4, x + w // 4 : x + 3 * w // 4]
    return float((middle < 128).mean()) if middle.size else 0.0


STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "gray": to_gray,
    "limit_size": lambda a: limit_size(a)[0],
    "deskew": lambda a: deskew(a)[0],
    "contrast": lambda a: stretch(to_gray(a)),
    "denoise": lambda a: median(to_gray(a)),
    "binarize": lambda a: binarize(to_gray(a)),
    "crop": auto_crop,
}
SCAN, TEXT_LAYER = ("gray", "limit_size", "deskew", "contrast", "denoise", "binarize", "crop"), ("gray", "contrast")


def preprocess(pages: DataFrame, steps: tuple[str, ...] = SCAN) -> DataFrame:
    """``pages`` with their images run through the steps; rows without an image stay as they are."""

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                if r["image"] is not None:
                    a = decode(r["image"], r["height"], r["width"], r["channels"])
                    for s in steps:
                        a = STEPS[s](a)
                    r |= {"image": np.ascontiguousarray(a).tobytes(), "height": a.shape[0], "width": a.shape[1], "channels": 1 if a.ndim == 2 else a.shape[2]}
                rows.append(r)
            yield pd.DataFrame(rows, columns=f.columns)

    return pages.mapInPandas(run, pages.schema)


def from_files(files: DataFrame) -> DataFrame:
    """Pages of ``files(path, content)`` that are PNG; the image of another or a damaged file is null and its sizes 0."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content):
                try:
                    a = decode_png(content)
                    rows.append((path, 0, 72, a.shape[1], a.shape[0], 1 if a.ndim == 2 else 3, a.tobytes()))
                except ValueError:
                    rows.append((path, 0, 72, 0, 0, 0, None))
            yield pd.DataFrame(rows, columns=["source", "page_index", "dpi", "width", "height", "channels", "image"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def to_files(pages: DataFrame) -> DataFrame:
    """``(source, page_index, content)``: PNG files of pages; null without an image."""

    @F.pandas_udf("binary")
    def png(img: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else encode_png(decode(*x)) for x in zip(img, h, w, c)], dtype=object)

    return pages.select("source", "page_index", png("image", "height", "width", "channels").alias("content"))


def overlay(pages: DataFrame, lines: DataFrame, colour: tuple[int, int, int] = (0, 200, 0), thick: int = 2) -> DataFrame:
    """Pages in colour with a frame around each of their lines; a page's lines are one small group."""
    boxes = lines.groupBy(F.col("doc_id").alias("source"), "page_index").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                found = r.pop("boxes")
                if r["image"] is not None:
                    a = to_bgr(decode(r["image"], r["height"], r["width"], r["channels"])).copy()
                    for b in found if found is not None else ():
                        x1, y1, x2, y2 = (max(0, round(b[k])) for k in ("x1", "y1", "x2", "y2"))
                        for part in (np.s_[y1 : y1 + thick, x1:x2], np.s_[max(y1, y2 - thick) : y2, x1:x2], np.s_[y1:y2, x1 : x1 + thick], np.s_[y1:y2, max(x1, x2 - thick) : x2]):
                            a[part] = colour
                    r |= {"image": a.tobytes(), "channels": 3}
                rows.append(r)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])

    return pages.join(boxes, ["source", "page_index"], "left").select(*[x.split()[0] for x in PAGES.split(", ")], "boxes").mapInPandas(run, PAGES)


def ink(pages: DataFrame) -> DataFrame:
    """``(source, page_index, ink)``: the share of dark pixels."""

    @F.pandas_udf("double")
    def share(img: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([ink_ratio(to_gray(decode(*x)), 128) for x in zip(img, h, w, c)])

    return pages.select("source", "page_index", share("image", "height", "width", "channels").alias("ink"))
