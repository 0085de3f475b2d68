"""Column expressions over file names and paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of images, for the combined set and (without the animated format) for augmentation.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
AUGMENT_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


def suffix(name: Column) -> Column:
    """The last dot and what follows it; none for names that begin with their only dot or end with a dot."""
    return F.regexp_extract(name, r"^.+([.][^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def is_image(name: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    return F.lower(suffix(name)).isin(*suffixes)


def prefixed(group: Column, name: Column) -> Column:
    """The name with its group and an underscore before it, unless it has them already, in either case."""
    prefix = F.concat(group, F.lit("_"))
    return F.when(F.lower(name).startswith(F.lower(prefix)), name).otherwise(F.concat(prefix, name))


def folded(text: Column) -> Column:
    """Full case folding, in Arrow batches: `Straße` and `STRASSE` are alike."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.str.casefold()

    return fold(text)


def relative(path: Column, root: str) -> Column:
    """The path below root."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def seeded_key(seed: int, *parts: Column) -> Column:
    """The SHA-256 digest, in hex, of `seed:part/part...`; ordering by it is a seeded shuffle that reruns repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws("/", *parts)).cast("binary"), 256)
