"""Sinks: a plan of actions first, then its application to guarded folders, file by file and atomically."""

from __future__ import annotations

import os
import re
import stat
import struct
import tempfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import names
from sievework.sources.exif import UPRIGHT, orientation
from sievework.sources.jpeg import jpeg

#: Fixed value: the form of numbered outputs.
NUMBERED = r"^\d+\.jpg$"


def foreign_content(listing: DataFrame, numbered: bool = False) -> DataFrame:
    """Rows of a listing (name, is_file, is_link) that forbid clearing the folder: links, folders, and files of another kind."""
    fits = F.col("name").rlike(NUMBERED) if numbered else names.is_image(F.col("name"))
    return listing.where(F.col("is_link") | ~F.col("is_file") | ~fits)


def sync_actions(existing: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """key and action: `write` for what is expected, `delete` for what exists without being expected."""
    stale = existing.select(*key).join(expected.select(*key), key, "left_anti").withColumn("action", F.lit("delete"))
    return expected.select(*key).withColumn("action", F.lit("write")).unionByName(stale)


def list_folder(spark, folder: str) -> DataFrame:
    """name, is_file and is_link of a local folder's entries (none where there is no folder)."""
    entries = [(e.name, e.is_file(follow_symlinks=False), e.is_symlink()) for e in os.scandir(folder)] if os.path.isdir(folder) else []
    return spark.createDataFrame(entries, "name string, is_file boolean, is_link boolean")


def checked(spark, folder: str, numbered: bool = False) -> None:
    """Raises ValueError if the folder is a link or no folder, or holds foreign content; changes nothing."""
    if os.path.islink(folder) or (os.path.exists(folder) and not os.path.isdir(folder)):
        raise ValueError(f"not a folder: {folder}")
    found = foreign_content(list_folder(spark, folder), numbered).select("name").limit(1).collect()
    if found:
        raise ValueError(f"{folder} holds {found[0][0]}; nothing was cleared")


def guarded(spark, folder: str, numbered: bool = False) -> str:
    """The checked folder, made if need be."""
    checked(spark, folder, numbered)
    os.makedirs(folder, exist_ok=True)
    return folder


def write_atomically(path: str, content: bytes) -> None:
    """By way of a temporary file beside it, which never stays."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), suffix=os.path.splitext(path)[1])
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def delete_file(path: str, roots: set[str]) -> bool:
    """Whether a regular file right in one of the roots was deleted; links, and anything elsewhere, are left alone."""
    place, name = os.path.split(os.path.abspath(path))
    try:
        kinds = [os.lstat(p).st_mode for p in (place, os.path.join(place, name))]
    except FileNotFoundError:
        return False
    if place in roots and stat.S_ISDIR(kinds[0]) and stat.S_ISREG(kinds[1]):
        os.unlink(path)
        return True
    return False


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """name and written for rows (name, content), written by the executors into a folder that all of them share.

    The plan is lazy: an action on the result writes. A null content, or a target that is a link, is skipped.
    """

    def run(batches):
        for pdf in batches:
            done = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                target = os.path.join(folder, name)
                plain = content is not None and re.fullmatch(r"[^/]+", name) is not None and not os.path.islink(target)
                if plain:
                    write_atomically(target, bytes(content))
                done.append(plain)
            yield pdf[["name"]].assign(written=done)

    return rows.select("name", "content").mapInPandas(run, "name string, written boolean")


def png(picture: np.ndarray) -> bytes:
    """An 8-bit grey (h, w) or colour (h, w, 3 or 4) picture as PNG."""
    picture = picture[..., None] if picture.ndim == 2 else picture
    h, w, depth = picture.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), picture.reshape(h, w * depth)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(picture: np.ndarray) -> bytes:
    """A colour (h, w, 3) picture as an uncompressed bitmap: rows from below, blue first, padded to four bytes."""
    h, w, _ = picture.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = picture[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def like(picture: np.ndarray, head: bytes, quality: int) -> bytes:
    """A colour picture in the format of the file that begins with head: JPEG of that quality, bitmap, or else PNG."""
    return jpeg(picture, quality) if head[:2] == b"\xff\xd8" else bmp(picture) if head[:2] == b"BM" else png(picture)


def encoded(picture: np.ndarray, name: str, quality: int) -> bytes:
    """A picture in the format that its name asks for: JPEG of that quality, or else PNG."""
    return jpeg(picture, quality) if re.search(r"\.jpe?g$", name, re.IGNORECASE) else png(picture)


def turned_files(spark, root: str) -> DataFrame:
    """place (the path without its scheme) and orientation of the files below root that don't stand upright."""

    def run(batches):
        for pdf in batches:
            found = pdf[["place"]].assign(orientation=[orientation(bytes(c)) for c in pdf["content"]])
            yield found[found["orientation"] != 1]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("place"), "content").mapInPandas(run, "place string, orientation int")


def read_pictures(spark, root: str) -> DataFrame:
    """path, width, height, channels and data (RGB or grey, row by row) of the pictures below root; undecodable ones are dropped.

    Decoding is Spark's own (JPEG, PNG, GIF, BMP); its BGR order is turned in Arrow batches, and pictures are made upright
    by their EXIF orientation.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                picture = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                picture = UPRIGHT[r.orientation](picture if r.channels == 1 else picture[..., 2::-1])
                out.append((r.path, picture.shape[1], picture.shape[0], picture.shape[2], picture.tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "data"])

    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    flat = found.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    placed = flat.withColumn("place", F.regexp_replace("path", "^file:/+", "/")).join(turned_files(spark, root), "place", "left")
    return placed.select(*flat.columns, F.coalesce("orientation", F.lit(1)).alias("orientation")).mapInPandas(run, flat.schema)


def unreadable(spark, root: str) -> DataFrame:
    """path of the files below root that have a picture's suffix, but that no decoder reads (WebP, or broken ones)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select("path", F.regexp_replace("path", "^file:/+", "/").alias("place")).where(names.is_image(F.regexp_extract("path", "([^/]+)$", 1)))
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    return listed.join(found.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("place")), "place", "left_anti").select("path")
