"""Run-length bitmaps of graphic subtitles: codes found by jumping from zero byte to zero byte, pixels by numpy."""

from __future__ import annotations

import numpy as np

INK, PAPER = 0, 255


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, colours); a line end is a run of length 0. Bytes that are missing at the end read as 0.

    Any other byte than 0 is a pixel of its own, so only the codes that a 0 begins are stepped through; what lies between two of them is taken whole.
    """
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    b = np.frombuffer(data + b"\0\0\0", np.uint8)
    zeros = np.flatnonzero(b[: len(data)] == 0)
    flags = b[zeros + 1]
    size = 2 + ((flags & 0x40) > 0) + ((flags & 0x80) > 0)
    after = np.searchsorted(zeros, zeros + size)  # the first zero byte beyond each code that might begin there
    heads, k = [], 0
    step = after.tolist()
    while k < len(step):
        heads.append(k)
        k = step[k]
    at, flags, size = zeros[heads], flags[heads], size[heads]
    length = (flags & 0x3F).astype(np.int64)
    long = (flags & 0x40) > 0
    length = np.where(long, length << 8 | b[np.minimum(at + 2, len(b) - 1)], length)
    colour = np.where(flags & 0x80, b[np.minimum(at + 2 + long, len(b) - 1)], 0).astype(np.uint8)
    # Bytes that no code covers are single pixels; all runs go in the order of their first bytes.
    covered = np.zeros(len(b) + 2, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, np.minimum(at + size, len(b) + 1), -1)
    single = np.flatnonzero(np.cumsum(covered)[: len(data)] == 0)
    order = np.argsort(np.concatenate([at, single]), kind="stable")
    return np.concatenate([length, np.ones(len(single), np.int64)])[order], np.concatenate([colour, b[single]])[order]


def ink_table(luma: np.ndarray) -> np.ndarray:
    """Pixel of each palette entry: bright entries are ink, dark and unset ones paper; short palettes are unset beyond their end."""
    full = np.zeros(256, np.uint8)
    full[: min(len(luma), 256)] = luma[:256]
    return np.where(full > 127, INK, PAPER).astype(np.uint8)


def bitmap(data: bytes, luma: np.ndarray) -> np.ndarray:
    """Rows x columns of ink and paper.

    The width is what stands before the first line end at which more than one pixel has been counted since the width was last set; without any it
    is 1 pixel. The last row is filled up with colour 0. ValueError where the width comes out as 0 for a bitmap with lines but no pixels.
    """
    if not data:
        return np.zeros((0, 1), np.uint8)
    length, colour = runs(data)
    total, width = np.cumsum(length), 1
    for k in np.flatnonzero(length == 0):
        width = int(total[k])
        if width >= 2:
            break
    if width == 0:
        raise ValueError("a bitmap without pixels")
    table = ink_table(luma)
    pixels = np.repeat(table[colour], length)
    rows = -(-len(pixels) // width)
    return np.concatenate([pixels, np.full(rows * width - len(pixels), table[0], np.uint8)]).reshape(rows, width)


def palette_luma(payload: bytes) -> np.ndarray:
    """256 luma values of a palette segment's 5-byte entries (id, Y, Cr, Cb, alpha); the last of an id counts, a cut one doesn't."""
    out = np.zeros(256, np.uint8)
    body = np.frombuffer(payload[2:], np.uint8)
    entries = body[: len(body) // 5 * 5].reshape(-1, 5)
    out[entries[:, 0]] = entries[:, 1]
    return out


def encode(lengths, colours) -> bytes:
    """The shortest codes of runs, for tests and made streams; a run of length 0 is a line end. Lengths are below 16384."""
    out = []
    for n, c in zip(lengths, colours):
        if n == 1 and c:
            out.append(bytes([c]))
        else:
            flag = (0x40 if n > 0x3F else 0) | (0x80 if c else 0)
            size = bytes([flag | n >> 8, n & 0xFF]) if n > 0x3F else bytes([flag | n])
            out.append(b"\0" + size + (bytes([c]) if c else b""))
    return b"".join(out)
