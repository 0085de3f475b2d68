"""Baseline JPEG files of RGB pictures, without chroma subsampling, in numpy."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the JPEG standard's annex K: quantisation of luminance and chrominance at quality 50, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Fixed values of JFIF: rows of Y, Cb and Cr.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
COSINES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos(np.pi * (2 * np.arange(8) + 1) * np.arange(8)[:, None] / 16)
#: All symbols of a kind have codes of the same length: 4 bits for sizes of DC, 8 for runs and sizes of AC.
DC_SYMBOLS, DC_BITS = list(range(12)), 4
AC_SYMBOLS, AC_BITS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)], 8
END, SIXTEEN = 0, 1
AC_CODE = np.zeros(256, np.int64)
AC_CODE[AC_SYMBOLS] = np.arange(len(AC_SYMBOLS))


def scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    """The usual scale of qualities from 1 to 100."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * percent + 50) // 100, 1, 255)


def coefficients(picture: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Quantised coefficients [blocks, 3, 64] in zigzag order; edges are repeated up to whole blocks."""
    h, w = picture.shape[:2]
    padded = np.pad(picture, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(float)
    planes = padded @ YCC.T - np.array([128.0, 0.0, 0.0])
    rows, columns = planes.shape[0] // 8, planes.shape[1] // 8
    blocks = planes.reshape(rows, 8, columns, 8, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, 8, 8)
    found = (COSINES @ blocks @ COSINES.T).reshape(-1, 3, 64) / np.stack([tables[0], tables[1], tables[1]])
    return np.clip(np.round(found), -1023, 1023).astype(np.int64)[:, :, ZIGZAG]


def sizes(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(values))[1].astype(np.int64)


def extra(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a code: negative numbers count from zero up."""
    return np.where(values < 0, values + (1 << size) - 1, values)


def entropy_coded(found: np.ndarray) -> bytes:
    dc = np.diff(found[:, :, 0], axis=0, prepend=0).reshape(-1)
    size = sizes(dc)
    # (place in the stream, value, bits) of everything: a block's DC is at 0, what belongs to its k-th coefficient at 4k
    block = np.arange(len(dc)) * 512
    items = [(block, size << size | extra(dc, size), DC_BITS + size)]
    ac = found.reshape(-1, 64)
    at, k = np.nonzero(ac[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], at[1:] != at[:-1]]), 0, np.concatenate([[0], k[:-1]]))
    run, values = k - before - 1, ac[at, k]
    size = sizes(values)
    items.append((block[at] + 4 * k + 1, AC_CODE[(run % 16) << 4 | size] << size | extra(values, size), AC_BITS + size))
    long_runs = np.repeat(block[at] + 4 * k, run // 16)
    items.append((long_runs, np.full(len(long_runs), SIXTEEN), np.full(len(long_runs), AC_BITS)))
    open_ended = block[ac[:, 63] == 0] + 4 * 64
    items.append((open_ended, np.full(len(open_ended), END), np.full(len(open_ended), AC_BITS)))
    place, value, bits = (np.concatenate(x) for x in zip(*items, strict=True))
    order = np.argsort(place, kind="stable")
    value, bits = value[order], bits[order]
    owner = np.repeat(np.arange(len(bits)), bits)
    back = np.repeat(np.cumsum(bits), bits) - np.arange(len(owner)) - 1
    stream = (value[owner] >> back & 1).astype(np.uint8)
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")


def jpeg(picture: np.ndarray, quality: int) -> bytes:
    """An 8-bit RGB (h, w, 3) or grey (h, w) picture as JPEG."""
    picture = np.repeat(picture[..., None], 3, axis=2) if picture.ndim == 2 else picture
    tables = [scaled(t, quality) for t in (LUMINANCE, CHROMINANCE)]
    h, w = picture.shape[:2]

    def segment(marker: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data

    def huffman(kind: int, symbols: list[int], bits: int) -> bytes:
        counts = [0] * 16
        counts[bits - 1] = len(symbols)
        return segment(0xC4, bytes([kind << 4, *counts, *symbols]))

    parts = [b"\xff\xd8", segment(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0))]
    parts += [segment(0xDB, bytes([k, *t[ZIGZAG]])) for k, t in enumerate(tables)]
    parts.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(3))))
    parts += [huffman(0, DC_SYMBOLS, DC_BITS), huffman(1, AC_SYMBOLS, AC_BITS)]
    parts.append(segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])))
    return b"".join(parts) + entropy_coded(coefficients(picture, tables)) + b"\xff\xd9"
