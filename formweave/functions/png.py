"""PNG files as numpy arrays and back, with the standard library's zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: its signature, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Gray, or blue, green and red; alpha is dropped. ValueError for what isn't a PNG of 8-bit samples in one pass."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG file")
    at, head, palette, packed = len(SIGNATURE), None, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6] or (head[3] == 3 and palette is None):
        raise ValueError("PNG of an unsupported kind")
    width, height, kind = head[0], head[1], head[3]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * SAMPLES[kind])
    except zlib.error as e:
        raise ValueError(f"damaged PNG: {e}") from e
    img = _unfilter(rows[:, 0], rows[:, 1:].reshape(height, width, SAMPLES[kind]))
    if kind == 3:
        img = palette[np.minimum(img[..., 0], len(palette) - 1)]
    return img[..., 0] if kind in (0, 4) else np.ascontiguousarray(img[..., 2::-1])


def _unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Undo the filter of each row. A pixel needs its left and upper neighbours, so all pixels of a diagonal are done at once."""
    height, width, samples = x.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("damaged PNG: unknown filter")
    if not kinds.any():
        return x
    # One row and column of zeros stand before the image.
    out = np.zeros((height + 1, width + 1, samples), np.uint8)
    for step in range(height + width - 1):
        r = np.arange(max(0, step - width + 1), min(height, step + 1))
        c, kind = step - r, kinds[r][:, None]
        left, up, corner = (out[r + i, c + j].astype(np.int16) for i, j in ((1, 0), (0, 1), (0, 0)))
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[r + 1, c + 1] = (x[r, c] + guess).astype(np.uint8)
    return out[1:, 1:]


def encode_png(img: np.ndarray) -> bytes:
    """A PNG of a gray image, or of one in blue, green and red."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = img.shape[:2]
    x = img.reshape(height, width) if img.ndim == 2 else img[..., 2::-1].reshape(height, 3 * width)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), x], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
