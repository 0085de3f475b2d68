"""The two runs over trees of picture files: combining classes without near duplicates, and augmenting.

Both check first, then plan in DataFrames, and write last; folders must be shared by driver and executors.
"""

from __future__ import annotations

import hashlib
import os
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import names
from sievework.operators import augment, mask_cache, selection, visual
from sievework.operators.iteration import checkpointed
from sievework.sources import commit, manifest, sinks, tree

#: The classes, in the order in which they are numbered, and the seed of manifest samples.
CLASSES = ("P", "N")
SEED = selection.SEED
#: JPEG qualities of cropped and of augmented pictures.
CROP_QUALITY, AUGMENT_QUALITY = 95, 92


def square(data: bytes, w: int, h: int, channels: int) -> np.ndarray:
    """The centred square of a picture, as RGB."""
    picture = np.frombuffer(data, np.uint8).reshape(h, w, channels)
    side = min(w, h)
    picture = picture[(h - side) // 2 : (h - side) // 2 + side, (w - side) // 2 : (w - side) // 2 + side]
    return np.repeat(picture, 3, axis=2) if channels == 1 else picture


def small(picture: np.ndarray) -> tuple[bytes, bytes]:
    """A picture's grey raster for the hash, and the bytes of its small RGB version for the pixel test."""
    rgb = np.clip(np.round(augment.resized(picture, visual.SIDE, visual.SIDE)), 0, 255)
    grey = np.round(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return grey.tobytes(), rgb.astype(np.uint8).tobytes()


def gathered(spark: SparkSession, root: str, source: str, manifest_path: str | None) -> DataFrame:
    """phase, grp (below root), leaf, name and path of what a class takes: all groups of source, then the manifest's samples.

    Raises ValueError with the first error of the manifest; a manifest that isn't there names no sources. Only folders
    that are named are listed.
    """
    groups = tree.listing(spark, source).select(F.lit(0).alias("phase"), F.concat(F.lit(f"{os.path.relpath(source, root)}/"), "grp").alias("grp"), F.col("grp").alias("leaf"), "name", "path", "length", "modified")
    if manifest_path is None or not os.path.isfile(manifest_path):
        return groups
    entries = manifest.read_manifest(spark, manifest_path)
    wanted = entries.select(manifest.clean_path(F.col("path")).alias("grp"), "count").where("grp IS NOT NULL")
    named = sorted({r["grp"] for r in wanted.collect() if r["grp"] and ".." not in r["grp"].split("/")})  # a row for each entry of a file that people write
    inside = [f for f in named if tree.inside(os.path.join(root, f), root)]
    files = tree.listing(spark, root, folders=inside, empty=True)
    told = spark.createDataFrame([(f, os.path.realpath(os.path.join(root, f)), f in set(inside)) for f in named if os.path.isdir(os.path.join(root, f))], "path string, real string, inside boolean")
    counts = files.groupBy(F.col("grp").alias("path")).agg(F.count("name").alias("available"))
    wrong = manifest.first_manifest_error(entries, told.join(counts, "path", "left").fillna(0, ["available"])).first()
    if wrong:
        raise ValueError(f"{manifest_path}: source {wrong['idx']} ({wrong['path']}): {wrong['error']}")
    chosen = selection.top_by_hash(files.where("name IS NOT NULL").join(wanted, "grp"), F.col("count"), ["grp"], names.seeded_key(SEED, F.col("grp"), F.col("name")), ["name"])
    return groups.unionByName(chosen.select(F.lit(1).alias("phase"), "grp", F.regexp_extract("grp", "([^/]+)$", 1).alias("leaf"), "name", "path", "length", "modified"))


def prepared(rows: DataFrame, pictures: DataFrame) -> DataFrame:
    """side, path, output, cropped, pixels and rgb of rows: output names, and what duplicates are found by.

    Rows without a picture are dropped before naming.
    """
    joined = rows.join(pictures.select("path"), "path").withColumn("wanted", names.prefixed(F.col("leaf"), F.col("name")))
    rank = F.concat_ws("/", F.col("phase").cast("string"), F.lower("grp"), F.lower("name"), "name")
    named = selection.unique_names(joined.select("side", "path", "wanted", rank.alias("rank")), "side", "rank", "wanted").select("side", "path", F.col("unique").alias("output"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                grey, rgb = small(square(r.data, r.width, r.height, r.channels))
                out.append((r.side, r.path, r.output, r.width != r.height, grey, rgb))
            yield pd.DataFrame(out, columns=["side", "path", "output", "cropped", "pixels", "rgb"])

    return named.join(pictures, "path").mapInPandas(run, "side string, path string, output string, cropped boolean, pixels binary, rgb binary")


def contents(rows: DataFrame, pictures: DataFrame) -> DataFrame:
    """grp, name and content of rows (grp, name, path, cropped): the files' own bytes, or, cropped, their squares in the same format.

    Pictures come along only where they are cropped; content is null for a file that is gone.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    with open(r.path, "rb") as file:
                        own = file.read() if not r.cropped else file.read(16)
                    out.append((r.grp, r.name, own if not r.cropped else sinks.like(square(r.data, int(r.width), int(r.height), int(r.channels)), own, CROP_QUALITY)))
                except FileNotFoundError:
                    out.append((r.grp, r.name, None))
            yield pd.DataFrame(out, columns=["grp", "name", "content"])

    whole = rows.where("NOT cropped").select("grp", "name", "path", "cropped", *[F.lit(None).cast(k).alias(c) for c, k in pictures.dtypes if c != "path"])
    cut = rows.where("cropped").join(pictures, "path").select(*whole.columns)
    return whole.unionByName(cut).mapInPandas(run, "grp string, name string, content binary")


def duplicates(rows: DataFrame, choices: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """side, output and action of rows (side, output, pixels, rgb).

    `drop_internal`: a leader of the class matches. Then conflicts between the classes' leaders: `drop_cross`, or
    `unresolved` where neither choices (output of the component's first P, choice) nor the default tell. Else `keep`.
    """
    order = [F.when(F.col("side") == CLASSES[0], 0).otherwise(1), F.lower("output"), "output"]
    ranked = selection.number_within(visual.dct_hash(rows.select("side", "output", "pixels", "rgb")), [], order, "id")
    ranked = checkpointed(ranked.select("id", "side", "output", F.col("phash").alias("h"), "rgb", visual.digest(F.col("rgb")).alias("digest")))
    # equal pictures match the same leaders: the first stands for all
    firsts = ranked.groupBy("side", "h", "digest").agg(F.min("id").alias("id"))
    distinct = checkpointed(firsts)

    def matches(left: DataFrame, right: DataFrame) -> DataFrame:
        return visual.verified_pairs(visual.hamming_join(left, right, visual.MAX_BITS), ranked.select("id", F.col("rgb").alias("pixels")))

    within = None
    for side in CLASSES:
        one = distinct.where(F.col("side") == side)
        found = matches(one, one).where("l < r").select(F.col("l").alias("a"), F.col("r").alias("b"))
        within = found if within is None else within.unionByName(found)
    led = checkpointed(distinct.join(visual.leaders(distinct, within), "id"))
    kept = led.where("id = leader")
    across = matches(*[kept.where(F.col("side") == side) for side in CLASSES]).select(F.col("l").alias("p"), F.col("r").alias("n"))
    members = checkpointed(visual.cross_components(across))
    chosen = members.where("false").select("component", F.lit(None).cast("string").alias("choice"))
    if choices is not None:
        named = ranked.where(F.col("side") == CLASSES[0]).select(F.col("id").alias("component"), "output")
        chosen = choices.join(named, "output").select("component", "choice")
    judged = visual.resolve(members, chosen, default).select(F.col("id").alias("leader"), F.col("action").alias("judged"))
    same = (ranked["side"] == led["side"]) & (ranked["h"] == led["h"]) & (ranked["digest"] == led["digest"])
    full = ranked.join(led, same).select(ranked["id"], ranked["side"], "output", "leader").join(judged, "leader", "left")
    action = F.when(F.col("id") != F.col("leader"), "drop_internal").when(F.col("judged") == "delete", "drop_cross").when(F.col("judged") == "unresolved", "unresolved").otherwise("keep")
    return full.select("side", "output", action.alias("action"))


def normalize_output(spark: SparkSession, folder: str) -> int:
    """Cuts the pictures right in an output folder that aren't square to their centred squares; how many were replaced.

    Square ones, links and files that can't be read stay as they are. ValueError: a link or no folder.
    """
    if os.path.islink(folder) or not os.path.isdir(folder):
        raise ValueError(f"not a folder: {folder}")
    parent, grp = os.path.split(os.path.abspath(folder))
    listed = tree.listing(spark, folder, flat=True).where("NOT is_link")
    pictures = tree.decoded(listed)
    wide = checkpointed(listed.select("name", "path").join(pictures.where("width <> height").select("path"), "path"))
    if wide.isEmpty():
        return 0
    rows = wide.select(F.lit(grp).alias("grp"), "name", "path", F.lit(True).alias("cropped"))
    return commit.update_files(contents(rows, pictures), parent)[1]["written"]


def fingerprint(rows: DataFrame) -> str:
    """A name for what rows of gathered() are, whatever their order: other files, sizes or times give another one."""
    told = rows.agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(k), "side", "phase", "grp", "name", "path", "length", "modified").cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k in range(2)]).first()
    return hashlib.sha256(repr(tuple(told)).encode()).hexdigest()[:32]


def decoded_once(rows: DataFrame, work: str | None, decodes=None) -> tuple[DataFrame, DataFrame, str | None]:
    """The pictures of rows, what prepared() makes of them, and the folder that they were stored in or read from, if any.

    With a work folder, a later call over the same files, by their fingerprint, takes both from there.
    """
    spark = rows.sparkSession
    if work is None:
        pictures = tree.decoded(rows, decodes=decodes)
        return pictures, checkpointed(prepared(rows, pictures)), None
    folder = f"{work}/{fingerprint(rows)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ready/_SUCCESS")  # written last
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        tree.decoded(rows, decodes=decodes).write.mode("overwrite").parquet(f"{folder}/pictures")
        prepared(rows, spark.read.parquet(f"{folder}/pictures")).write.mode("overwrite").parquet(f"{folder}/ready")
    return spark.read.parquet(f"{folder}/pictures"), spark.read.parquet(f"{folder}/ready"), folder


def combine(spark: SparkSession, root: str, sources: dict[str, str], outputs: dict[str, str], manifests: dict[str, str] | None = None, choices: DataFrame | None = None, default: str | None = None, counts: dict | None = None, work: str | None = None, decodes=None) -> DataFrame:
    """Fills a folder for each class (P, N) from its source tree and manifest, squared and without near duplicates.

    Returns side, path, output, cropped and action of every decodable picture; those of `keep` are written. Files that
    can't be decoded are told by a warning. counts, if given, gets what was done, by success: unreadable, non_square (of
    those kept), and, for each output folder's parent, written, removed and failed. Everything is checked before any
    folder changes: ValueError for a source that isn't there, a bad manifest, an output folder with other content than
    pictures, or a conflict between the classes that neither choices nor the default resolve. Each file is decoded once;
    folders are replaced in two phases, see sources.commit.

    With a work folder, a run that stops at an open conflict leaves its pictures there, and the next one, over the same
    files and with more choices, goes on from them; what is stored goes when a run is through. decodes: see tree.decoded.
    """
    for side in CLASSES:
        if not os.path.isdir(sources[side]):
            raise ValueError(f"no source folder: {sources[side]}")
    taken = [gathered(spark, root, sources[side], (manifests or {}).get(side)).withColumn("side", F.lit(side)) for side in CLASSES]
    places = {side: os.path.split(os.path.abspath(outputs[side])) for side in CLASSES}
    for side in CLASSES:
        commit.check(spark, places[side][0], [places[side][1]])
    rows = checkpointed(taken[0].unionByName(taken[1]))
    pictures, ready, stored = decoded_once(rows, work, decodes)
    skipped = checkpointed(tree.unreadable(rows, pictures))
    n_skipped = skipped.count()
    if n_skipped:
        some = ", ".join(r["path"] for r in skipped.orderBy("path").limit(5).collect())
        warnings.warn(f"{n_skipped} files can't be read: {some}", stacklevel=2)
    plan = checkpointed(ready.select("side", "path", "output", "cropped").join(duplicates(ready, choices, default), ["side", "output"]))
    open_ones = [r["output"] for r in plan.where("action = 'unresolved'").orderBy("output").limit(5).collect()]
    if open_ones:
        raise ValueError(f"unresolved conflicts: {', '.join(open_ones)}")
    kept = plan.where("action = 'keep'")
    told = {"unreadable": n_skipped, "non_square": kept.where("cropped").count()}
    grp = F.create_map(*[F.lit(x) for side in CLASSES for x in (side, places[side][1])])[F.col("side")]
    for parent in sorted({places[side][0] for side in CLASSES}):
        here = [side for side in CLASSES if places[side][0] == parent]
        own = kept.where(F.col("side").isin(here)).select(grp.alias("grp"), F.col("output").alias("name"), "path", "cropped")
        told[parent] = commit.replace_folders(contents(own, pictures), parent, [places[side][1] for side in here])[1]
    if stored is not None:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    if counts is not None:
        counts.update(told)
    return plan


def augment_tree(spark: SparkSession, root: str, transforms: str, composites: str, backgrounds: str, output: str, exclusions: str | None = None, plain: str = "plain", total: int = selection.TRANSFORM_COUNT, size: int = augment.SIZE, cache: str | None = None, counts: dict | None = None) -> DataFrame:
    """Augments a stratified sample of `transforms` and all of `composites`, each on a background, into output/kind_group.

    The four folders hold groups and lie below root. Returns kind, grp, path, number, output and background. Excluded
    pictures leave gaps in the numbers and keep their backgrounds. Files are JPEG, named `0001.jpg` and so on.
    With a cache folder, masks of unchanged pictures come from there, and new ones are added. Only pictures that are used
    are read, and each is decoded once; all folders are replaced together, in two phases (sources.commit). counts, if
    given, gets the numbers of files written, removed and failed.
    ValueError: an empty tree, unknown exclusions, too few backgrounds, foreign content, or a picture without a subject.
    """

    def assets(folder: str) -> DataFrame:
        found = tree.listing(spark, folder, suffixes=names.AUGMENT_SUFFIXES)
        rows = found.select("grp", "name", "path", "length", "modified").withColumn("relpath", names.relative(F.col("path"), os.path.abspath(root)))
        if rows.isEmpty():
            raise ValueError(f"no pictures: {folder}")
        return rows

    sample = checkpointed(selection.stratified_sample(assets(transforms), total))
    every = selection.number_within(assets(composites), [], [F.lower("grp"), "grp", F.lower("name"), "name"], "slot")
    grounds = assets(backgrounds).select("path", F.when(F.col("grp") == plain, "plain").otherwise("textured").alias("kind"))
    lines = manifest.read_exclusions(spark, exclusions) if exclusions and os.path.isfile(exclusions) else spark.createDataFrame([], "path string")
    unknown = lines.join(sample.select("relpath").union(every.select("relpath")).withColumnRenamed("relpath", "path"), "path", "left_anti")
    missing = sorted(r["path"] for r in unknown.limit(20).collect())
    if missing:
        raise ValueError(f"excluded, but not there: {missing}")
    dealt = selection.round_robin(every.select("slot"), grounds)
    composed = every.join(dealt.select("slot", "background"), "slot", "left")
    if not composed.where("background IS NULL").isEmpty():
        raise ValueError("too few backgrounds")
    jobs = selection.numbered(sample, lines).withColumns({"kind": F.lit("transform"), "background": F.lit(None).cast("string")})
    columns = ["kind", "grp", "path", "relpath", "length", "modified", "number", "output", "background"]
    jobs = checkpointed(jobs.select(*columns).unionByName(selection.numbered(composed, lines).withColumn("kind", F.lit("composite")).select(*columns)))
    folders = [f"{r['kind']}_{r['grp']}" for r in jobs.select("kind", "grp").distinct().collect()]  # a row for each group
    commit.check(spark, output, folders, numbered=True)

    used = jobs.select("path").unionByName(jobs.where("background IS NOT NULL").select(F.col("background").alias("path")))
    pictures = tree.decoded(used).select("path", F.array("height", "width", "channels").alias("shape"), F.col("data").alias("picture"))
    scenes = pictures.select(F.col("path").alias("background"), F.col("shape").alias("scene_shape"), F.col("picture").alias("scene"))
    held = jobs.join(pictures, "path", "left").join(scenes, "background", "left")

    if cache is None:
        held = held.withColumn("mask", F.lit(None).cast("binary"))
    else:
        subjects = jobs.join(pictures, "path").select("kind", "relpath", mask_cache.signature(F.col("length"), F.col("modified")).alias("signature"), "shape", "picture")
        held = held.join(mask_cache.subject_masks(subjects, cache), ["kind", "relpath"], "left")

    def run(batches):
        for pdf in batches:
            contents = []
            for kind, rel, shape, picture, scene_shape, scene, found in zip(*[pdf[c] for c in ("kind", "relpath", "shape", "picture", "scene_shape", "scene", "mask")], strict=True):
                try:
                    rng = augment.generator(rel)
                    if picture is None or (kind == "composite" and scene is None):
                        contents.append(None)
                    else:
                        subject = augment.as_rgb(picture, shape)
                        mask = None if found is None else np.frombuffer(found, np.uint8).reshape(subject.shape[:2])
                        made = augment.transform(subject, rng, mask, size) if kind == "transform" else augment.composite(subject, augment.as_rgb(scene, scene_shape), rng, mask, size)
                        contents.append(sinks.jpeg(np.ascontiguousarray(made), AUGMENT_QUALITY))
                except ValueError:  # no subject
                    contents.append(None)
            yield pd.DataFrame({"kind": pdf["kind"], "grp": pdf["grp"], "relpath": pdf["relpath"], "output": pdf["output"], "content": contents})

    made = checkpointed(held.select("kind", "grp", "relpath", "output", "shape", "picture", "scene_shape", "scene", "mask").repartition(F.col("relpath")).mapInPandas(run, "kind string, grp string, relpath string, output string, content binary"))
    bad = [r["relpath"] for r in made.where("content IS NULL").select("relpath").limit(1).collect()]
    if bad:
        raise ValueError(f"no subject: {bad[0]}")
    rows = made.select(F.concat_ws("_", "kind", "grp").alias("grp"), F.col("output").alias("name"), "content")
    told = commit.replace_folders(rows, output, folders, numbered=True)[1]
    if counts is not None:
        counts.update(told)
    return jobs.drop("length", "modified")
