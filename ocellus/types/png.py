"""A small PNG codec for 8-bit grey, grey-alpha, RGB and RGBA images."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """PNG of an array (height, width) or (height, width, channels) of bytes."""
    a = np.ascontiguousarray(pixels, np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    kind = next(k for k, n in CHANNELS.items() if n == a.shape[2])
    rows = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], axis=1)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a.astype(int) + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels of a PNG without interlacing and palette: (height, width) for grey, else with channels."""
    if not data.startswith(MAGIC):
        raise ValueError("not a PNG")
    at, packed = len(MAGIC), b""
    width = height = channels = 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            width, height, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or laced or color not in CHANNELS:
                raise ValueError("only plain 8-bit PNGs can be read")
            channels = CHANNELS[color]
        elif kind == b"IDAT":
            packed += body
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    if not rows[:, 0].any():
        out = rows[:, 1:].reshape(height, width, channels).copy()
        return out[:, :, 0] if channels == 1 else out
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].reshape(width, channels).copy()
        if kind == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            left = corner = np.zeros(channels, np.uint8)
            for x in range(width):
                guess = ((left.astype(int) + above[x]) // 2).astype(np.uint8) if kind == 3 else _paeth(left, above[x], corner)
                line[x] = line[x] + guess
                left, corner = line[x], above[x]
        out[y] = above = line
    return out[:, :, 0] if channels == 1 else out
