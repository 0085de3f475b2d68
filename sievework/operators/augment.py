"""Image augmentation on arrays, in Arrow batches: masks, transforms on a white canvas, and composites on a background.

Each row's random draws come from its own path, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import names

#: Seed, output side, largest saturation of a plain backdrop, and the ranges of draws.
SEED, SIZE, BACKDROP = 20260924, 320, 55
TRANSFORM = {"angle": 22.0, "scale": (0.54, 0.86), "jitter": 36}
COMPOSITE = {"angle": 28.0, "scale": (0.42, 0.80), "jitter": 45, "light": (0.93, 1.07), "scene_angle": 12.0, "scene_light": (0.9, 1.1), "centre": (0.25, 0.75), "margin": 1.5}
SIDE = 32
#: Swaps that bring the middle of nine values to the fifth place.
MEDIAN_SWAPS = ((1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2))
#: interpolated(): places at once, and how near to a half single precision isn't trusted.
PLACES_AT_ONCE, UNSURE = 51200, 0.001
#: Of four samples fetched as one number: the bits of three, and what the last is shifted by.
FIRST, SECOND, THIRD, LAST = (np.array(v, np.uint32) for v in (0xFF, 0xFF00, 0xFF0000, 24))
#: augmented(): rasters whose subjects are cut out and turned at once.
ROWS_AT_ONCE = 16


def generator(path: str, seed: int = SEED) -> random.Random:
    """A row's own generator, from the BLAKE2b digest (8 bytes) of `seed/path`."""
    return random.Random(int.from_bytes(hashlib.blake2b(f"{seed}/{path}".encode(), digest_size=8).digest(), "big"))


def saturation(rgb: np.ndarray) -> np.ndarray:
    """HSV saturation, 0 to 255, rounded down."""
    channels = [rgb[..., k] for k in range(3)]
    high, low = functools.reduce(np.maximum, channels).astype(int), functools.reduce(np.minimum, channels)
    return np.where(high > 0, (high - low) * 255 // np.maximum(high, 1), 0)


def exterior(open_: np.ndarray) -> np.ndarray:
    """Of the open cells those that touch the border through others, up, down, left and right; further axes are pictures of a stack.

    A breadth-first front over flat indices, so a pass costs no more than the cells it adds.
    """
    h, w = open_.shape[:2]
    free = np.zeros((h + 2, w + 2, *open_.shape[2:]), bool)
    free[1:-1, 1:-1] = open_
    rim = np.zeros_like(free)
    rim[1, 1:-1] = rim[-2, 1:-1] = rim[1:-1, 1] = rim[1:-1, -2] = True
    across = math.prod(open_.shape[2:])
    shape, free, steps = free.shape, free.ravel(), across * np.array([[1], [-1], [w + 2], [-w - 2]])
    last = np.empty(free.size, np.int64)
    front = np.flatnonzero(rim.ravel() & free)
    while front.size:
        free[front] = False
        near = (front + steps).ravel()
        near = near[free[near]]
        # of equal cells the last one stays
        last[near] = np.arange(near.size)
        front = near[last[near] == np.arange(near.size)]
    return open_ & ~free.reshape(shape)[1:-1, 1:-1]


def sliding(image: np.ndarray, size: int, reduce) -> np.ndarray:
    """A rank filter over size x size neighbourhoods; edges are repeated.

    Largest and least values are taken along one axis, then the other; the median of nine bytes by a network of swaps.
    """
    pad = size // 2
    edged = np.pad(image, [(pad, pad), (pad, pad)] + [(0, 0)] * (image.ndim - 2), mode="edge")
    h, w = image.shape[:2]
    if reduce in (np.max, np.min):
        pick = np.maximum if reduce is np.max else np.minimum
        edged = functools.reduce(pick, [edged[k : k + h] for k in range(size)])
        return functools.reduce(pick, [edged[:, k : k + w] for k in range(size)])
    if reduce is np.median and size == 3 and image.dtype == np.uint8:
        v = [edged[y : y + h, x : x + w] for y in range(3) for x in range(3)]
        for i, j in MEDIAN_SWAPS:
            v[i], v[j] = np.minimum(v[i], v[j]), np.maximum(v[i], v[j])
        return v[4]
    return reduce(np.lib.stride_tricks.sliding_window_view(edged, (size, size), axis=(0, 1)), axis=(-2, -1)).astype(image.dtype)


def blurred(mask: np.ndarray, sigma: float) -> np.ndarray:
    kernel = np.exp(-(np.arange(-3, 4) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    mask = mask.astype(float)
    for axis in (0, 1):
        n = mask.shape[axis]
        edged = np.pad(mask, [(3, 3) if k == axis else (0, 0) for k in range(mask.ndim)], mode="edge")
        mask = sum(edged.take(range(k, k + n), axis) * kernel[k] for k in range(7))
    return np.floor(mask + 0.5).astype(np.uint8)


def subject_masks(rgb: np.ndarray) -> np.ndarray:
    """Masks (h, w, n) of n pictures (h, w, n, 3) of a size, 0 to 255: what isn't backdrop, closed (7), smoothed (median 3) and feathered (0.7)."""
    mask = np.where(exterior(saturation(rgb) <= BACKDROP), 0, 255).astype(np.uint8)
    mask = sliding(sliding(mask, 7, np.max), 7, np.min)
    return blurred(sliding(mask, 3, np.median), 0.7)


def subject_mask(rgb: np.ndarray) -> np.ndarray:
    """One picture's mask. Raises ValueError where nothing is left."""
    mask = subject_masks(rgb[:, :, None])[:, :, 0]
    if not mask.any():
        raise ValueError("no subject found")
    return mask


def box(mask: np.ndarray) -> tuple[slice, slice]:
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)


def by_channel(image: np.ndarray, run: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """run on each channel of an image; equal channels only once."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    out = []
    for k in range(image.shape[2]):
        channel = image[:, :, k]
        found = next((r for c, r in done if np.array_equal(c, channel)), None)
        if found is None:
            found = run(channel)
            done.append((channel, found))
        out.append(found)
    return np.stack(out, axis=2)


@functools.lru_cache(maxsize=16)
def lanczos(n_in: int, n_out: int, begin: float = 0.0, end: float | None = None) -> np.ndarray:
    """The matrix that resamples n_in values between begin and end to n_out; widened when shrinking. Not to be changed."""
    end = n_in if end is None else end
    scale = (end - begin) / n_out
    wide = max(scale, 1)
    centres = begin + (np.arange(n_out) + 0.5) * scale
    # the places that a centre reaches, a few of all
    first = np.floor(centres - 3 * wide).astype(int) - 1
    places = first[:, None] + np.arange(math.ceil(6 * wide) + 3)
    x = (places + 0.5 - centres[:, None]) / wide
    near = (places >= 0) & (places < n_in) & (np.abs(x) < 3)
    weights = np.zeros((n_out, n_in))
    rows = np.broadcast_to(np.arange(n_out)[:, None], places.shape)
    weights[rows[near], places[near]] = np.sinc(x[near]) * np.sinc(x[near] / 3)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, w: int, h: int, area: tuple[float, float, float, float] | None = None) -> np.ndarray:
    x0, y0, x1, y1 = area or (0, 0, image.shape[1], image.shape[0])
    down, across = lanczos(image.shape[0], h, y0, y1), lanczos(image.shape[1], w, x0, x1)
    ties = False

    def run(channel):
        nonlocal ties
        if (channel == channel[0, 0]).all():  # weights add up to one
            return np.full((h, w), channel[0, 0], np.uint8)
        out = down @ channel.astype(float) @ across.T
        out += 0.5
        ties = ties or bool((np.abs(out - np.rint(out)) < 1e-9).any())
        return np.clip(out, 0, 255, out=out).astype(np.uint8)  # rounded down

    quick = by_channel(image, run)
    if not ties:
        return quick
    # midway between two values the order of sums decides: that of all channels at once
    out = np.einsum("yi,ijc,xj->yxc", down, image.astype(float), across, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def within(image: np.ndarray, side: int, enlarge: bool) -> np.ndarray:
    """Scaled to fit a square, its proportions kept; smaller images grow only if they may."""
    h, w = image.shape[:2]
    factor = side / max(w, h)
    if factor > 1 and not enlarge:
        return image
    return resized(image, max(1, round(w * factor)), max(1, round(h * factor)))


def cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def cubic_shares(t: np.ndarray, out: np.ndarray) -> None:
    """Twice the cubic() of the four samples around places that lie t, 0 to 1, after the second; those of the first and last without their sign."""
    first, second, third, last = out
    np.subtract(1, t, out=second)
    np.multiply(t, second, out=first)
    np.multiply(first, t, out=last)
    second += first
    second *= 2
    np.multiply(last, 3, out=third)
    second -= third
    np.add(first, 2, out=third)
    third -= second
    first -= last


class Scratch:
    """Arrays for up to n places that interpolated() fills again and again."""

    def __init__(self, n: int) -> None:
        self.down, self.across, self.pairs = (np.empty((k, n), np.float32) for k in (4, 4, 2))
        self.value, self.row, self.term = np.empty((3, n), np.float32)
        self.at, self.got, self.part = np.empty(n, np.int64), np.empty(n, np.uint32), np.empty(n, np.uint32)
        self.least, self.most = np.zeros(n, np.int32), np.full(n, 255, np.int32)  # np.minimum() takes arrays faster than numbers


@functools.lru_cache(maxsize=4)
def scratch(n: int) -> Scratch:
    return Scratch(n)


def room(use: str, n: int, dtype: type) -> np.ndarray:
    """n numbers to fill; for a use the same ones again, if they aren't many, as new pages cost more than what is done to them."""
    return held_room(use, 1 << n.bit_length(), dtype)[:n] if n <= 1 << 18 else np.empty(n, dtype)


@functools.lru_cache(maxsize=12)
def held_room(use: str, n: int, dtype: type) -> np.ndarray:
    return np.empty(n, dtype)


def interpolated(raw: np.ndarray, width: int, n: int, step: int, places: Callable, fractions: Callable) -> np.ndarray:
    """Rounded bicubic values of n places, from a flat uint8 picture of that width.

    `step` places at once, in single precision: places(k, at, t, spare) sets the first of the sixteen samples of each place from
    the k-th on, and how far it lies, down and across, after the second; it may use spare's arrays. What comes so near to a half that
    the error could tell is done again in double precision, from fractions(which). Four samples side by side are fetched as one number.
    """
    packed = room("packed", len(raw), np.uint32)
    np.copyto(packed, np.ndarray(len(raw), np.uint32, np.concatenate([raw, np.zeros(3, np.uint8)]), 0, (1,)))
    out, unsure, buffers = np.empty(n, np.uint8), [], scratch(step)
    for k in range(0, n, step):
        m = min(step, n - k)
        t, down, across = buffers.pairs[:, :m], buffers.down[:, :m], buffers.across[:, :m]
        value, row, term = buffers.value[:m], buffers.row[:m], buffers.term[:m]
        at, got, part = buffers.at[:m], buffers.got[:m], buffers.part[:m]
        whole = part.view(np.int32)
        places(k, at, t, (value, row, term))
        cubic_shares(t[0], down)
        cubic_shares(t[1], across)
        across[1] *= np.float32(2.0**-8)  # samples stay in the byte where they were fetched
        across[2] *= np.float32(2.0**-16)
        first, second, third, last = across
        for j in (1, 2, 0, 3):
            packed[j * width :].take(at, out=got, mode="clip")
            np.bitwise_and(got, SECOND, part)
            row[:] = whole
            row *= second
            np.bitwise_and(got, THIRD, part)
            term[:] = whole
            term *= third
            row += term
            np.bitwise_and(got, FIRST, part)
            term[:] = whole
            term *= first
            row -= term
            np.right_shift(got, LAST, part)
            term[:] = whole
            term *= last
            row -= term
            if j == 1:
                np.multiply(row, down[j], out=value)
                continue
            row *= down[j]
            if j == 2:
                value += row
            else:
                value -= row
        value *= np.float32(0.25)
        value += np.float32(0.5)
        np.rint(value, out=row)
        row -= value
        np.abs(row, out=row)
        near = where(row < np.float32(UNSURE))
        unsure.append((near + k, at[near]))
        np.copyto(whole, value, casting="unsafe")
        np.maximum(whole, buffers.least[:m], out=whole)
        np.minimum(whole, buffers.most[:m], out=whole)
        out[k : k + m] = whole
    again, first = (np.concatenate(x) for x in zip(*unsure, strict=True)) if unsure else ([], [])
    if len(again):
        samples = np.arange(-1, 3)[:, None]
        down, across = (cubic(t - samples) for t in fractions(again))
        terms = (across * down[:, None]).reshape(16, -1) * raw[first + (width * np.arange(4)[:, None] + np.arange(4)).reshape(16, 1)]
        exact = functools.reduce(np.add, terms)
        out[again] = np.clip(np.floor(exact + 0.5), 0, 255)
    return out


def where(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of few flags, eight looked at as one number."""
    whole = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:whole].view(np.uint64))
    cells = (8 * words[:, None] + np.arange(8)).ravel()
    return np.concatenate([cells[flags[cells]], whole + np.flatnonzero(flags[whole:])])


def bicubic(channel: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    """A channel's rounded values at places (sy, sx); beyond the edge its last values count."""
    return bicubic_all([channel], [(sy, sx)])[0]


def bicubic_all(channels: list[np.ndarray], places: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """bicubic() of channels at places of each, all in one run."""
    h, width = max(len(c) for c in channels) + 6, max(c.shape[1] for c in channels) + 6
    edged = np.zeros((len(channels), h, width), np.uint8)
    for c, whole in zip(channels, edged, strict=True):
        rows, columns = (np.arange(-3, n + 3).clip(0, n - 1) for n in c.shape)
        whole[: len(rows), : len(columns)] = c[rows[:, None], columns]
    counts = [len(y) for y, _ in places]
    y, x = (np.concatenate(v) for v in zip(*places, strict=True))
    iy, ix = np.floor(y), np.floor(x)
    at = ((iy + 2) * width + ix + 2).astype(np.int64) + np.repeat(h * width * np.arange(len(channels)), counts)
    y, x = y - iy, x - ix

    def some(k, first, t, _):
        first[:] = at[k : k + len(first)]
        t[0], t[1] = y[k : k + len(first)], x[k : k + len(first)]

    found = interpolated(edged.ravel(), width, len(y), PLACES_AT_ONCE, some, lambda which: (y[which], x[which]))
    return np.split(found, np.cumsum(counts)[:-1])


def turned(w: int, h: int, degrees: float, expand: bool, margin: int) -> tuple[np.ndarray, ...]:
    """(c dx, s dx, s dy, c dy) of a rotated picture's columns and rows around its centre."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    nw, nh = (math.ceil(abs(w * c) + abs(h * s)), math.ceil(abs(w * s) + abs(h * c))) if expand else (w, h)
    dx, dy = np.arange(margin, nw - margin) + 0.5 - nw / 2, np.arange(margin, nh - margin) + 0.5 - nh / 2
    return c * dx, s * dx, s * dy, c * dy


def rotated(image: np.ndarray, degrees: float, expand: bool, margin: int = 0) -> np.ndarray:
    """Turned counter-clockwise about the centre, by bicubic sampling; what comes from outside is zero.

    Of the result, a margin on all sides is left out.
    """
    return rotated_all([image], [degrees], expand, margin)[0]


def rotated_all(images: list[np.ndarray], degrees: list[float], expand: bool, margin: int = 0) -> list[np.ndarray]:
    """rotated() of each image, sampled in one run; of equal channels one is sampled, even ones aren't."""
    out, asked = [], []
    for image, angle in zip(images, degrees, strict=True):
        h, w = image.shape[:2]
        cdx, sdx, sdy, cdy = turned(w, h, angle, expand, margin)
        sx, sy = (cdx - sdy[:, None] + w / 2 - 0.5), (sdx + cdy[:, None] + h / 2 - 0.5)
        inside = (sx >= -0.5) & (sx < w - 0.5) & (sy >= -0.5) & (sy < h - 0.5)
        cells = np.flatnonzero(inside)
        places = sy.ravel()[cells], sx.ravel()[cells]
        found = np.zeros((*inside.shape, image.shape[2]), np.uint8)
        out.append(found)
        for channel, owners in distinct(image):
            if (channel == channel[0, 0]).all():  # weights add up to one
                found[:, :, owners] = (inside * channel[0, 0])[:, :, None]
            else:
                asked.append((channel, places, found, inside, cells, owners))
    if asked:
        sampled = bicubic_all([a[0] for a in asked], [a[1] for a in asked]) if asked[1:] else [bicubic(asked[0][0], *asked[0][1])]
        for values, (_, _, found, _, cells, owners) in zip(sampled, asked, strict=True):
            found.reshape(-1, found.shape[2])[np.ix_(cells, owners)] = values[:, None]
    return out


def distinct(image: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
    """An image's different channels, each with the numbers of those equal to it."""
    found: list[tuple[np.ndarray, list[int]]] = []
    for k in range(image.shape[2]):
        channel = np.ascontiguousarray(image[:, :, k])
        owners = next((o for c, o in found if np.array_equal(c, channel)), None)
        if owners is None:
            found.append((channel, [k]))
        else:
            owners.append(k)
    return found


def lit(image: np.ndarray, factor: float) -> np.ndarray:
    table = np.clip(np.arange(256) * factor, 0, 255).astype(np.uint8).tobytes()
    return np.frombuffer(image.tobytes().translate(table), np.uint8).reshape(image.shape)


def resampled(channel: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray | None:
    """resized() of one channel that is enlarged; None where a value lies midway between two.

    In single precision; what comes so near to a half that the error could tell is done again in double precision.
    """
    shape = len(down), across.shape[1]
    out, off = (room(use, math.prod(shape), np.float32).reshape(shape) for use in ("resampled", "off"))
    rows = down @ channel.astype(float)
    np.matmul(rows.astype(np.float32), across.astype(np.float32), out=out)
    out += np.float32(0.5)
    np.rint(out, out=off)
    off -= out
    np.abs(off, out=off)
    again = where((off < np.float32(UNSURE)).ravel())
    np.clip(out, 0, 255, out=out)
    found = out.astype(np.uint8)  # rounded down
    y, x = np.divmod(again, shape[1])
    exact = np.einsum("nk,nk->n", rows[y], across.T[x]) + 0.5
    if len(again) and np.abs(exact - np.rint(exact)).min() < 1e-9:
        return None
    found.ravel()[again] = np.clip(exact, 0, 255)
    return found


def shown(image: np.ndarray, wide: int, area: tuple[float, float, float, float], degrees: float, margin: int, light: float) -> np.ndarray:
    """lit(rotated(resized(image, wide, wide, area), degrees, False, margin), light), resampling only the rows and columns that it reaches."""

    def plainly():
        return lit(rotated(resized(image, wide, wide, area), degrees, False, margin), light).copy()

    cdx, sdx, sdy, cdy = turned(wide, wide, degrees, False, margin)
    reach = [v + wide / 2 - 0.5 for v in (*np.subtract.outer(cdx[[0, -1]], sdy[[0, -1]]).ravel(), *np.add.outer(sdx[[0, -1]], cdy[[0, -1]]).ravel())]
    low, high = math.floor(min(reach)) - 2, math.floor(max(reach)) + 4
    width, columns = high - low, len(cdx)
    x0, y0, x1, y1 = area
    # single precision counts up to 2 ** 24 cells, and adds up few of them: those that an enlarged picture's cell is made of
    if low < 0 or high > wide or width > 2048 or max(x1 - x0, y1 - y0) > wide:
        return plainly()
    down, across = lanczos(image.shape[0], wide, y0, y1)[low:high], lanczos(image.shape[1], wide, x0, x1)[low:high].T
    # whole parts and fractions of what columns and rows add to the places
    parts = [cdx + (wide / 2 - 1.5 - low), -sdy, sdx + (wide / 2 - 1.5 - low), cdy]
    wholes = [np.floor(v) for v in parts]
    tx, tx_row, ty, ty_row = ((v - f).astype(np.float32) for v, f in zip(parts, wholes, strict=True))
    at_column, at_row = (wholes[0] + width * wholes[2]).astype(np.float32), (wholes[1] + width * wholes[3]).astype(np.float32)
    step = max(1, PLACES_AT_ONCE // columns) * columns

    def some(k, first, t, spare):
        rows, (number, carry, _) = slice(k // columns, (k + len(first)) // columns), spare
        for sums, column, row in ((t[0], ty, ty_row), (t[1], tx, tx_row), (number, at_column, at_row)):
            np.add(column, row[rows, None], out=sums.reshape(-1, columns))
        for fraction, weight in zip(t, (np.float32(width), np.float32(1)), strict=True):
            np.floor(fraction, out=carry)
            fraction -= carry
            carry *= weight
            number += carry
        first[:] = number.astype(np.int32)

    def fractions(which):
        row, column = np.divmod(which, columns)
        x, y = (cdx[column] - sdy[row] + wide / 2 - 0.5), (sdx[column] + cdy[row] + wide / 2 - 0.5)
        return y - np.floor(y), x - np.floor(x)

    out = np.empty((len(sdy), columns, image.shape[2]), np.uint8)
    for channel, owners in distinct(image):
        value = channel[:1, :1]
        if not (channel == value).all():  # weights add up to one
            picture = resampled(channel, down, across)
            if picture is None:
                return plainly()
            value = interpolated(picture.ravel(), width, out[:, :, 0].size, step, some, fractions).reshape(out.shape[:2])
        value = lit(value, light)
        for k in owners:
            out[:, :, k] = value
    return out


def pasted(scene: np.ndarray, subject: np.ndarray, rng: random.Random, jitter: int) -> np.ndarray:
    """The scene with a subject (RGBA) over its centre, moved by two draws and kept inside. The scene is changed."""
    at = []
    for room in (scene.shape[1] - subject.shape[1], scene.shape[0] - subject.shape[0]):
        at.append(max(0, min(room, room // 2 + rng.randint(-jitter, jitter))))
    view = scene[at[1] : at[1] + subject.shape[0], at[0] : at[0] + subject.shape[1]]
    part = subject[: view.shape[0], : view.shape[1]]
    over = part[:, :, 3] / 255
    under = 1 - over
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(3):
        below, above = view[:, :, k].copy(), part[:, :, k].copy()
        mixed = next((m for x, y, m in done if np.array_equal(x, below) and np.array_equal(y, above)), None)
        if mixed is None:
            mixed = below * under
            mixed += above * over
            mixed += 0.5
            done.append((below, above, mixed))
        view[:, :, k] = mixed  # rounded down
    return scene


def cutout(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.dstack([rgb, mask])[box(mask)]


def as_rgb(data: bytes, shape) -> np.ndarray:
    """A raster of (height, width, channels) bytes; grey becomes RGB."""
    picture = np.frombuffer(data, np.uint8).reshape(tuple(shape))
    return np.repeat(picture, 3, axis=2) if picture.shape[2] == 1 else picture


def mask_for(kind: str, rgb: np.ndarray) -> np.ndarray:
    """The mask that transform() (of the smoothed picture) or composite() uses where none is given."""
    return subject_mask(sliding(rgb, 3, np.median) if kind == "transform" else rgb)


def transform(rgb: np.ndarray, rng: random.Random, mask: np.ndarray | None = None, size: int = SIZE) -> np.ndarray:
    """The subject, smoothed, turned and scaled, on white. Draws: angle, scale, x, y."""
    rgb = sliding(rgb, 3, np.median)
    subject = rotated(cutout(rgb, subject_mask(rgb) if mask is None else mask), rng.uniform(-TRANSFORM["angle"], TRANSFORM["angle"]), True)
    subject = within(subject, round(size * rng.uniform(*TRANSFORM["scale"])), True)
    return pasted(np.full((size, size, 3), 255, np.uint8), subject, rng, TRANSFORM["jitter"])


def composite(rgb: np.ndarray, background: np.ndarray, rng: random.Random, mask: np.ndarray | None = None, size: int = SIZE) -> np.ndarray:
    """The subject on a part of the background. Draws: light, angle, scale, scene's centre x and y, its angle and light, x, y."""
    return next(composites([rgb], [background], [rng], [subject_mask(rgb) if mask is None else mask], size))


def composites(rgbs: list[np.ndarray], backgrounds: list[np.ndarray], rngs: list[random.Random], masks: list[np.ndarray], size: int = SIZE) -> Iterator[np.ndarray]:
    """composite() of each row, one after another; the subjects of all are turned in one run."""
    k = COMPOSITE
    cut = [cutout(lit(rgb, rng.uniform(*k["light"])), mask) for rgb, mask, rng in zip(rgbs, masks, rngs, strict=True)]
    subjects = rotated_all(cut, [rng.uniform(-k["angle"], k["angle"]) for rng in rngs], True)
    wide = round(size * k["margin"])
    for subject, background, rng in zip(subjects, backgrounds, rngs, strict=True):
        subject = within(subject, round(size * rng.uniform(*k["scale"])), False)
        h, w = background.shape[:2]
        side = min(h, w)
        x, y = (w - side) * rng.uniform(*k["centre"]), (h - side) * rng.uniform(*k["centre"])
        angle, light = rng.uniform(-k["scene_angle"], k["scene_angle"]), rng.uniform(*k["scene_light"])
        scene = shown(background, wide, (x, y, x + side, y + side), angle, (wide - size) // 2, light)
        yield pasted(np.ascontiguousarray(scene[:size, :size]), subject, rng, k["jitter"])


def colours(grey: bytes) -> np.ndarray:
    """A raster's bytes as the saturation of a reddish picture, so that its dark cells are backdrop."""
    values = np.frombuffer(grey, np.uint8).reshape(SIDE, SIDE)
    return np.dstack([np.full_like(values, 255), 255 - values, 255 - values])


def augmented(rows: DataFrame, key: str = "relpath", size: int = SIZE) -> DataFrame:
    """doc_id, state and sha256 of the augmented picture of each row (doc_id, key, pixels, background or null).

    A row without a subject gets the state `no_subject` and no digest: one bad picture doesn't stop the rest.
    """

    def pictures(paths, pixels, backgrounds):
        """Digests, None for rows without a subject, of up to ROWS_AT_ONCE rows."""
        digests, ready = [None] * len(paths), []
        for k, (path, grey, behind) in enumerate(zip(paths, pixels, backgrounds, strict=True)):
            try:
                rgb = colours(bytes(grey))
                if behind is None:
                    digests[k] = hashlib.sha256(transform(rgb, generator(path), size=size)).hexdigest()
                else:
                    ready.append((k, rgb, colours(bytes(behind)), generator(path)))
            except ValueError:
                pass
        if ready:
            masks = np.moveaxis(subject_masks(np.stack([rgb for _, rgb, _, _ in ready], axis=2)), 2, 0)
            found = [(*row, mask) for row, mask in zip(ready, masks, strict=True) if mask.any()]
            if found:
                numbers, rgbs, scenes, rngs, cut = zip(*found, strict=True)
                for k, picture in zip(numbers, composites(rgbs, scenes, rngs, cut, size), strict=True):
                    digests[k] = hashlib.sha256(picture).hexdigest()
        return digests

    def run(batches):
        for pdf in batches:
            digests = []
            for k in range(0, len(pdf), ROWS_AT_ONCE):
                digests += pictures(*(pdf[c].iloc[k : k + ROWS_AT_ONCE] for c in ("path", "pixels", "background")))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "state": ["no_subject" if d is None else "done" for d in digests], "digest": digests})

    picked = rows.where(F.col("pixels").isNotNull()).select("doc_id", F.col(key).alias("path"), "pixels", "background")
    spread = picked.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)  # a picture costs far more than its move
    return spread.mapInPandas(run, "doc_id long, state string, digest string")


def mask_summary(rows: DataFrame, raster: Callable = bytes) -> DataFrame:
    """doc_id, subject (cells that the exterior doesn't reach) and their bounding box (-1 without any).

    raster makes a row's pixels from what stands there, one row after another, so that no batch of them is held at once.
    """
    names = ["doc_id", "subject", "x0", "y0", "x1", "y1"]

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(1):
                inside = ~exterior(np.frombuffer(raster(value.as_py()), np.uint8).reshape(SIDE, SIDE) <= BACKDROP)
                y, x = box(inside) if inside.any() else (slice(-1, 0), slice(-1, 0))
                out.append((int(inside.sum()), x.start, y.start, x.stop - 1, y.stop - 1))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]], names=names)

    return rows.where(F.col("pixels").isNotNull()).select(F.col("doc_id").cast("long"), "pixels").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def unit(path: Column, draw: str) -> Column:
    """A number from 0 to 1 that the seed, the path and the draw's name determine."""
    return F.conv(F.substring(names.seeded_key(SEED, path, F.lit(draw)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def drawn(rows: DataFrame) -> DataFrame:
    """doc_id, angle and side of the transform, in SQL mode: draws by SHA-256 instead of the row's generator."""
    path, (low, high) = F.col("relpath"), TRANSFORM["scale"]
    return rows.select(
        "doc_id",
        F.round(unit(path, "angle") * 2 * TRANSFORM["angle"] - TRANSFORM["angle"], 6).alias("angle"),
        F.bround((unit(path, "scale") * (high - low) + low) * SIZE, 0).cast("long").alias("side"),
    )


def drawn_sql(images: str) -> str:
    draw = "('0x' || substr(sha256('" + str(SEED) + ":' || relpath || '/{}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0"
    low, high = TRANSFORM["scale"]
    angle, scale = draw.format("angle"), draw.format("scale")
    return f"WITH {images} SELECT doc_id, round({angle} * 44.0::DOUBLE - 22.0::DOUBLE, 6) AS angle, round_even(({scale} * ({high}::DOUBLE - {low}::DOUBLE) + {low}::DOUBLE) * 320, 0)::BIGINT AS side FROM images"
