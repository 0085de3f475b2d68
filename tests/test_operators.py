"""Golden cases and properties of the operators over assets."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import geometry, names
from sievework.operators import augment, selection, visual
from sievework.plans import catalog, duplicates
from sievework.sources import manifest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_largest_remainder(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 3), ("c", 4)], "grp string, n long")
    assert rows(selection.largest_remainder(sizes, 5).select("grp", "quota")) == [("a", 2), ("b", 1), ("c", 2)]
    assert rows(selection.largest_remainder(sizes, 50).select("grp", "quota")) == [("a", 3), ("b", 3), ("c", 4)]


def test_crop_boxes(spark):
    boxes = spark.createDataFrame([(5, 3), (4, 3), (3, 5)], "w long, h long").select(*geometry.crop_box(F.col("w"), F.col("h")))
    assert [tuple(r) for r in boxes.collect()] == [(1, 0, 4, 3), (0, 0, 3, 3), (0, 1, 3, 4)]


def test_suffixes_and_prefixes(spark):
    listed = spark.createDataFrame([("a.JPG",), (".jpg",), ("a.",), ("a.tar.gz",), ("G_a.png",)], "name string")
    assert [r[0] for r in listed.where(names.is_image(F.col("name"))).collect()] == ["a.JPG", "G_a.png"]
    assert [r[0] for r in listed.select(names.prefixed(F.lit("g"), F.col("name"))).collect()][-1] == "G_a.png"


def naive_names(wanted):
    seen, out = set(), []
    for name in wanted:
        dot = name.rfind(".")
        stem, ending, choice, k = name[:dot], name[dot:], name, 2
        while choice.casefold() in seen:
            choice, k = f"{stem}_{k}{ending}", k + 1
        seen.add(choice.casefold())
        out.append(choice)
    return out


def test_unique_names_cascade(spark):
    rng = random.Random(5)
    lists = [["a.jpg", "a.jpg", "a_2.jpg"], ["g_a.jpg", "G_a.jpg"]]
    lists += [[rng.choice(["a", "A", "a_2", "a_2_2", "b"]) + rng.choice([".jpg", ".png"]) for _ in range(rng.randint(0, 9))] for _ in range(30)]
    data = [(str(k), f"{i:03d}", name) for k, names_ in enumerate(lists) for i, name in enumerate(names_)]
    out = selection.unique_names(spark.createDataFrame(data, "scope string, rank string, name string"), "scope", "rank", "name")
    got = {(r["scope"], r["rank"]): r["unique"] for r in out.collect()}
    for k, wanted in enumerate(lists):
        assert [got[str(k), f"{i:03d}"] for i in range(len(wanted))] == naive_names(wanted)


def serial_names(wanted):
    """The rule, name by name; suffixes begin with a last dot that is neither first nor last."""
    seen, out = set(), []
    for name in wanted:
        dot = name.rfind(".")
        cut = dot if 0 < dot < len(name) - 1 else len(name)
        choice, k = name, 2
        while choice.casefold() in seen:
            choice, k = f"{name[:cut]}_{k}{name[cut:]}", k + 1
        seen.add(choice.casefold())
        out.append(choice)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_of_crowded_families(spark, seed):
    """Names that others' numbers make, asked for early and late, with cascades of them, and letters that fold into two."""
    rng = random.Random(100 + seed)
    stems = ["a", "A", "a_2", "a_3", "a_5", "a_2_2", "a_2_3", "A_2_2_2", "a_02", "a_1", "a_10", "ß", "SS", "ss_2", "_2", "a_", ".a", "b_2"]
    data, wanted = [], {}
    for k in range(25):
        names_ = [rng.choice(stems) + rng.choice([".jpg", ".jpg", ".JPG", "", "."]) for _ in range(rng.randint(1, 60))]
        for i, (name, out) in enumerate(zip(names_, serial_names(names_), strict=True)):
            data.append((str(k), f"{i:03d}", name, "x"))
            wanted[str(k), f"{i:03d}"] = (name, out)
    rows_ = spark.createDataFrame(data, "scope string, rank string, name string, other string").repartition(3)
    out = selection.unique_names(rows_, "scope", "rank", "name")
    assert out.columns == ["scope", "rank", "name", "other", "unique"]
    assert {(r["scope"], r["rank"]): (r["name"], r["unique"]) for r in out.collect()} == wanted


def test_unique_names_of_one_name_spread_over_tasks(spark):
    n = 400_000
    same = spark.range(n).select(F.lit("s").alias("scope"), F.format_string("%07d", "id").alias("rank"), F.when(F.col("id") == 77, "IMAGE_500.jpg").otherwise("image.jpg").alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = visual.checkpointed(selection.unique_names(same, "scope", "rank", "name"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.select(F.lower("unique")).distinct().count() == n == out.count()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.6 * n
    got = {r["rank"]: r["unique"] for r in out.where("rank IN ('0000000', '0000001', '0000076', '0000077', '0000498', '0000499', '0000500', '0399999')").collect()}
    # 500 is skipped: the name itself was asked for before the number came up
    assert got == {"0000000": "image.jpg", "0000001": "image_2.jpg", "0000076": "image_77.jpg", "0000077": "IMAGE_500.jpg", "0000498": "image_498.jpg", "0000499": "image_499.jpg", "0000500": "image_501.jpg", "0399999": "image_400000.jpg"}


def test_renumbering_a_large_group(spark):
    n = 300_000
    used = lambda k: k % 3 == 0 or 1000 <= k < 5000
    files = spark.range(1, n + 1).select(F.lit("bg").alias("grp"), F.when((F.col("id") % 3 == 0) | F.col("id").between(1000, 4999), F.concat(F.lit("bg_"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit(".png"))).otherwise(F.format_string("x%07d.jpg", "id")).alias("name"))
    out = selection.renumbered(files)
    got = {r["name"]: r["target"] for r in out.collect()}
    free = (k for k in range(1, 2 * n) if not used(k) or k > n)
    for k in range(1, n + 1):
        if used(k):
            assert got[f"bg_{k:07}.png"] == f"bg_{k:07}.png"
        else:
            assert got[f"x{k:07}.jpg"] == f"bg_{next(free):03}.jpg"


def test_renumbering_keeps_equal_numbers_and_zero(spark):
    files = spark.createDataFrame([("bg", n) for n in ("bg_002.jpg", "bg_002.png", "bg_000.jpg", "bg_1000.jpg", "a.jpg", "b.jpg", "c.jpg")], "grp string, name string")
    assert {r["name"]: r["target"] for r in selection.renumbered(files).collect() if r["name"][:2] != "bg"} == {"a.jpg": "bg_001.jpg", "b.jpg": "bg_003.jpg", "c.jpg": "bg_004.jpg"}


def test_renumbering(spark):
    files = spark.createDataFrame([("bg", n) for n in ("bg_001.jpg", "bg_3.png", "x.JPG", "y.webp")], "grp string, name string")
    assert rows(selection.renumbered(files).select("name", "target")) == [("bg_001.jpg", "bg_001.jpg"), ("bg_3.png", "bg_002.png"), ("x.JPG", "bg_003.jpg"), ("y.webp", "bg_004.webp")]


@pytest.mark.parametrize(("count", "plain", "textured", "wanted"), [(700, 10, 60, 105), (100, 4, 5, 40), (100, 2, 5, None), (10, 9, 9, 2), (30, 9, 9, 4), (50, 9, 9, 8)])
def test_plain_split(spark, count, plain, textured, wanted):
    row = spark.createDataFrame([(count, plain, textured)], "c long, p long, t long")
    assert row.select(selection.plain_split(F.col("c"), F.col("p"), F.col("t"))).first()[0] == wanted


def test_round_robin_is_balanced(spark):
    slots = spark.range(1, 101).select(F.col("id").alias("slot"))
    backgrounds = spark.createDataFrame([(f"p{k}", "plain") for k in range(3)] + [(f"t{k}", "textured") for k in range(9)], "path string, kind string")
    out = selection.round_robin(slots, backgrounds).collect()
    assert len(out) == 100 and sum(r["kind"] == "plain" for r in out) == 15
    for kind in ("plain", "textured"):
        uses = {}
        for r in out:
            if r["kind"] == kind:
                uses[r["background"]] = uses.get(r["background"], 0) + 1
        assert max(uses.values()) - min(uses.values()) <= 1 and max(uses.values()) <= selection.MAX_USES


def test_numbers_keep_gaps(spark):
    files = spark.createDataFrame([("g", f"f{k}", f"g/f{k}") for k in (1, 2, 3)], "grp string, name string, relpath string")
    out = selection.numbered(files, spark.createDataFrame([("g/f2",)], "path string"))
    assert rows(out.select("output", "name")) == [("0001.jpg", "f1"), ("0003.jpg", "f3")]


def test_manifest_rules(spark):
    entries = spark.createDataFrame([(1, '{"path": "a", "count": true}'), (2, '{"path": "a", "count": 2}'), (3, '{"path": "A", "count": 1}'), (4, '{"path": "b/../../x", "count": 1}'), (5, "[]")], "idx long, entry string")
    folders = spark.createDataFrame([("a", 2), ("A", 1)], "path string, available long")
    errors = {r["idx"]: r["error"] for r in manifest.manifest_errors(manifest.parse_entries(entries), folders).collect()}
    assert errors == {1: "bad_count", 2: "repeated", 3: "repeated", 4: "outside", 5: "not_object"}
    assert manifest.first_manifest_error(manifest.parse_entries(entries), folders).first()["idx"] == 1


def test_manifest_file_and_exclusions(spark, tmp_path):
    (tmp_path / "m.json").write_text('﻿{"sources": [{"path": "a", "count": 2, "more": [1]}, {"path": "b", "count": 1.0}]}', encoding="utf-8")
    assert rows(manifest.read_manifest(spark, str(tmp_path / "m.json")).select("idx", "path", "count")) == [(1, "a", 2), (2, "b", None)]
    (tmp_path / "x.txt").write_text("# note\n\n  a\\b.png \nc/d.png\nc/d.png\n", encoding="utf-8")
    assert rows(manifest.read_exclusions(spark, str(tmp_path / "x.txt"))) == [("a/b.png",), ("c/d.png",)]


def test_asset_listing(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("g/a.jpg", "g/b.txt", "h/c.PNG", "h/deep/d.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    assert rows(manifest.list_assets(spark, str(root)).select("grp", "name")) == [("g", "a.jpg"), ("h", "c.PNG")]


def greedy(n, edges):
    out, lead = {}, []
    for k in range(n):
        out[k] = next((x for x in lead if (x, k) in edges), k)
        if out[k] == k:
            lead.append(k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_greedy(spark, seed):
    rng = random.Random(seed)
    n = 30
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.1} | {(0, 1), (1, 2)}
    for small in (0, 1000):
        got = visual.leaders(spark.range(n), spark.createDataFrame(sorted(edges), "a long, b long"), small)
        assert {r["id"]: r["leader"] for r in got.collect()} == greedy(n, edges)


@pytest.mark.parametrize("seed", range(2))
def test_leaders_by_blocks_equal_greedy(spark, seed):
    rng = random.Random(50 + seed)
    n = 60
    edges = {(k, k + 1) for k in range(n - 1)} | {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.03}
    got = visual.leaders(spark.range(n), spark.createDataFrame(sorted(edges), "a long, b long"), 0, 16)
    assert {r["id"]: r["leader"] for r in got.collect()} == greedy(n, edges)


def test_leaders_of_a_long_chain(spark, monkeypatch):
    n, rounds = 1_000_001, []
    plain = visual.checkpointed
    monkeypatch.setattr(visual, "checkpointed", lambda df: (rounds.append(1), plain(df))[1])
    got = visual.leaders(spark.range(n), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), 0)
    assert got.where(F.col("leader") != F.col("id") - F.col("id") % 2).isEmpty() and got.count() == n
    assert len(rounds) <= 20


def test_cross_components_and_policy(spark):
    pairs = spark.createDataFrame([(1, 11), (2, 11), (2, 12), (5, 15)], "p long, n long")
    assert rows(visual.cross_components(pairs, small=0)) == rows(visual.cross_components(pairs))
    members = visual.cross_components(pairs)
    assert rows(members) == [("N", 11, 1), ("N", 12, 1), ("N", 15, 5), ("P", 1, 1), ("P", 2, 1), ("P", 5, 5)]
    choices = spark.createDataFrame([(1, "P")], "component long, choice string")
    actions = {(r["side"], r["id"]): r["action"] for r in visual.resolve(members, choices).collect()}
    assert actions["P", 2] == "delete" and actions["N", 12] == "keep" and actions["P", 5] == "unresolved"


@pytest.mark.parametrize("most", [0, 6, 18])
def test_hamming_join_loses_nothing(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(63) for _ in range(40)]
    near = []
    for x in base:
        for bit in rng.sample(range(63), rng.randint(0, most + 2)):
            x ^= 1 << bit
        near.append(x)
    values = base + near
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    wanted = sorted((a, b) for a in range(80) for b in range(80) if (values[a] ^ values[b]).bit_count() <= most)
    assert rows(visual.hamming_join(df, df, most)) == wanted
    for joint in (1, 2, 3) if most < 18 else (1, 2):
        assert rows(visual.hamming_join(df, None, most, joint=joint)) == [(a, b) for a, b in wanted if a < b]


@pytest.mark.parametrize(("bands", "most", "size"), [(1, 2, 9), (2, 3, 9), (3, 4, 11), (5, 18, 63), (7, 6, 63), (4, 3, 8)])
def test_radius_bands_lose_nothing(bands, most, size):
    plan = visual.radius_bands(bands, most, size)
    assert sum(r + 1 for *_, r in plan) == most + 1 and sum(b for _, b, _ in plan) == size
    rng = random.Random(bands)
    for _ in range(500):
        differ = sum(1 << b for b in rng.sample(range(size), rng.randint(0, most)))
        assert any((differ >> at & (1 << bits) - 1).bit_count() <= radius for at, bits, radius in plan)


@pytest.mark.parametrize(("most", "turned"), [(18, False), (18, True), (6, False)])
def test_hamming_join_by_radius(spark, monkeypatch, most, turned):
    rng = random.Random(most)
    near = lambda x: x ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, most + 3)))
    values = [rng.getrandbits(63) for _ in range(60)]
    values += [near(x) for x in values] + values[:3]
    wanted = sorted((a, b) for a in range(len(values)) for b in range(len(values)) if (values[a] ^ values[b]).bit_count() <= most)
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    monkeypatch.setattr(visual, "best_radius_plan", lambda n, m, most, size, alone: visual.radius_bands(5, most, size))
    monkeypatch.setattr(visual, "radius_cost", lambda *a: (0, 0))
    some = df.where("id < 30")
    left, right = (df, some) if turned else (some, df)
    assert rows(visual.hamming_join(left, right, most)) == [(a, b) for a, b in wanted if (b if turned else a) < 30]
    assert rows(visual.hamming_join(df, None, most)) == [(a, b) for a, b in wanted if a < b]


def test_hamming_join_of_many_bits_compares_under_a_third(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    df = visual.checkpointed(spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "h": rng.integers(0, 1 << 63, n)})))
    plan = visual.best_radius_plan(n, n, visual.BITS * 2 // 7, visual.BITS, True)
    met = visual.met_by_radius(df, df, plan).where("l < r").count()
    assert met < n * (n - 1) / 2 / 3
    assert abs(met / visual.radius_cost(plan, n, n, True)[1] - 1) < 0.05


def test_pixels_are_fetched_for_few(spark):
    rng = np.random.default_rng(4)
    base = np.repeat(rng.integers(20, 220, (40, 16)), 64, axis=1) + rng.integers(-10, 11, (40, 1024))
    pixels = np.concatenate([base, np.clip(base + rng.integers(-20, 21, base.shape), 0, 255), np.clip(base + 25, 0, 255), np.clip(base[:, ::-1], 0, 255)]).astype(np.uint8)
    rows_ = spark.createDataFrame([(k, p.tobytes()) for k, p in enumerate(pixels)] + [(900, b""), (901, b"\0" * 512), (902, None)], "id long, pixels binary")
    ids = [*range(len(pixels)), 900, 901, 902]
    every = [(a, b) for a in ids for b in ids if a < b]
    fetched = spark.sparkContext.accumulator(0)
    got = rows(visual.checkpointed(visual.verified_pairs(spark.createDataFrame(every, "l long, r long"), rows_, fetched=fetched)))
    assert got == [(a, b) for a, b in every if b < 900 and np.abs(pixels[a].astype(int) - pixels[b]).mean() <= visual.MAX_MEAN]
    assert len(got) <= fetched.value < 0.5 * len(every)


def test_dct_hash_bits(spark):
    rng = np.random.default_rng(1)
    pixels = [rng.integers(0, 256, 1024).astype(np.uint8).tobytes() for _ in range(5)] + [None]
    out = visual.dct_hash(spark.createDataFrame([(k, p) for k, p in enumerate(pixels)], "id int, pixels binary")).orderBy("id").collect()
    assert all(r["phash"].bit_count() == 31 for r in out[:5]) and out[5]["phash"] is None


def test_thresholds_are_inclusive(spark):
    pair = spark.createDataFrame([([0, 0], [18, 18])], "a array<int>, b array<int>")
    assert pair.select(visual.mean_difference(F.col("a"), F.col("b"))).first()[0] == 18.0


def test_exterior_and_mask():
    open_ = np.ones((9, 9), bool)
    open_[2:7, 2:7] = False
    open_[4, 4] = True  # a hole: open, but not reached
    assert not augment.exterior(open_)[2:7, 2:7].any() and augment.exterior(open_).sum() == 81 - 25
    picture = np.full((40, 40, 3), 255, np.uint8)
    with pytest.raises(ValueError, match="no subject"):
        augment.subject_mask(picture)
    picture[10:30, 12:28] = (250, 120, 10)
    assert augment.subject_mask(picture)[20, 20] == 255 and augment.subject_mask(picture)[0, 0] == 0


def test_augmented_pictures_repeat():
    picture = np.full((64, 64, 3), 255, np.uint8)
    picture[16:48, 20:44] = (250, 120, 10)
    one, two = (augment.transform(picture, augment.generator("a/b.png")) for _ in range(2))
    assert one.shape == (320, 320, 3) and (one == two).all() and (one != 255).any()
    scene = np.random.default_rng(0).integers(0, 255, (50, 70, 3)).astype(np.uint8)
    assert augment.composite(picture, scene, augment.generator("a/b.png")).shape == (320, 320, 3)


def test_resampling_keeps_flat_pictures_flat():
    flat = np.full((10, 14, 3), 77, np.uint8)
    assert (augment.resized(flat, 5, 31) == 77).all() and augment.within(flat, 28, True).shape == (20, 28, 3) and augment.within(flat, 28, False) is flat


def test_numbers_within_groups_of_any_size(spark):
    data = [("hot" if k % 3 else None if k % 2 else f"g{k % 5}", (k * 7919) % 1000, k) for k in range(2000)]
    rows_in = spark.createDataFrame(data, "grp string, key int, id int").repartition(7)
    got = {r["id"]: r["n"] for r in selection.number_within(rows_in, ["grp"], ["key", "id"], "n").collect()}
    seen, want = {}, {}
    for grp, _, k in sorted(data, key=lambda x: (x[0] or "", x[1], x[2])):
        seen[grp] = want[k] = seen.get(grp, 0) + 1
    assert got == want
    over_all = {r["id"]: r["n"] for r in selection.number_within(rows_in, [], ["key", "id"], "n").collect()}
    assert over_all == {k: n + 1 for n, (_, _, k) in enumerate(sorted(data, key=lambda x: x[1:]))}
    assert selection.number_within(rows_in.where("false"), ["grp"], ["key"], "n").count() == 0


def test_top_by_hash_takes_the_quota_of_a_hot_group(spark):
    data = [("hot", k) for k in range(500)] + [("cold", k) for k in range(3)]
    frame = spark.createDataFrame(data, "grp string, id int")
    got = selection.top_by_hash(frame, F.lit(40), ["grp"], F.sha2(F.col("id").cast("string"), 256), ["id"])
    first = sorted(range(500), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())[:40]
    assert got.columns == ["grp", "id"]
    assert sorted((r["grp"], r["id"]) for r in got.collect()) == sorted([("hot", k) for k in first] + [("cold", k) for k in range(3)])


def test_rasters_hold_whole_texts():
    from sievework.plans.duplicates import PIXELS, folded

    assert folded("") == bytes(PIXELS)
    text = "añ€😀" * 700
    assert list(folded(text)) == [sum(map(ord, text[k::PIXELS])) % 256 for k in range(PIXELS)]


def test_curation_needs_equal_pixels_too(spark, tmp_path):
    """A raster and its copy 80 grey levels brighter have one hash; only the copy by pixels goes."""
    rng = np.random.default_rng(31)
    dark = rng.integers(32, 120, 1024)
    texts = ["".join(map(chr, dark)), "".join(map(chr, dark + 80)), "".join(map(chr, dark + 1)), "".join(map(chr, dark + 80)), "".join(map(chr, dark))]
    docs = [(4 * k + 1, t, "en", "a", len(t)) for k, t in enumerate(texts)]  # such ids have the names of pictures
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(13, 0, 0), (17, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: (r["leader"], r["action"]) for r in duplicates.curation_pipeline(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "keep"), 5: (5, "keep"), 9: (1, "drop_internal"), 13: (13, "drop_cross"), 17: (17, "drop_cross")}
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert {r[0]: r[3:] for r in con.sql(duplicates.ORACLES["curation_pipeline"]).fetchall()} == got


def test_flagship_is_the_whole_curation(monkeypatch):
    monkeypatch.setitem(catalog.QUERIES, "curation_pipeline", lambda spark, sf_dir: "whole")
    monkeypatch.setitem(catalog.QUERIES, "leader_clusters", lambda spark, sf_dir: "part")
    assert catalog.flagship(None, "") == "whole"


def rotated_slowly(image, degrees, expand):
    """augment.rotated() in double precision, all samples one by one."""
    h, w = image.shape[:2]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    nw, nh = (math.ceil(abs(w * c) + abs(h * s)), math.ceil(abs(w * s) + abs(h * c))) if expand else (w, h)
    y, x = np.mgrid[0:nh, 0:nw] + 0.5
    dx, dy = x - nw / 2, y - nh / 2
    sx, sy = c * dx - s * dy + w / 2 - 0.5, s * dx + c * dy + h / 2 - 0.5
    inside = (sx >= -0.5) & (sx < w - 0.5) & (sy >= -0.5) & (sy < h - 0.5)
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((nh, nw, image.shape[2]))
    for j in range(-1, 3):
        for i in range(-1, 3):
            weight = augment.cubic(sx - ix - i) * augment.cubic(sy - iy - j)
            out += weight[..., None] * image[np.clip(iy + j, 0, h - 1), np.clip(ix + i, 0, w - 1)]
    return np.where(inside[..., None], np.clip(np.floor(out + 0.5), 0, 255), 0).astype(np.uint8)


def test_rotation_and_filters_equal_the_plain_forms():
    rng = np.random.default_rng(8)
    for shape, degrees, expand, margin in (((31, 44, 4), 17.3, True, 0), ((160, 120, 3), -11.2, False, 20), ((5, 3, 3), 28, True, 0), ((40, 40, 1), 0, True, 0)):
        image = rng.integers(0, 256, shape, np.uint8)
        image[..., -1] = image[..., 0]
        want = rotated_slowly(image, degrees, expand)
        assert np.array_equal(augment.rotated(image, degrees, expand, margin), want[margin : want.shape[0] - margin, margin : want.shape[1] - margin])
    image = rng.integers(0, 256, (23, 31), np.uint8)
    for size, reduce in ((7, np.max), (7, np.min), (3, np.median)):
        pad = size // 2
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), (size, size))
        assert np.array_equal(augment.sliding(image, size, reduce), reduce(windows, axis=(-2, -1)).astype(np.uint8))


def test_a_composite_costs_few_samples(monkeypatch):
    """Of a backdrop with three equal or even channels, one is sampled, and only in the part that is shown."""
    sampled, before = [], augment.bicubic
    monkeypatch.setattr(augment, "bicubic", lambda channel, y, x: sampled.append(len(y)) or before(channel, y, x))
    rng = np.random.default_rng(9)
    pixels = [augment.colours(rng.integers(0, 256, 1024, np.uint8).tobytes()) for _ in range(2)]
    augment.composite(*pixels, augment.generator("a/b.png"))
    assert sum(sampled) <= augment.SIZE**2 + 2 * 46**2


def test_scenes_resample_only_what_is_shown(monkeypatch):
    """Pixels are those of the whole picture resampled, turned and lit; that is done only where shrinking, corners or ties ask for it."""
    rng = np.random.default_rng(10)
    plain, asked = augment.resized, []
    monkeypatch.setattr(augment, "resized", lambda *args: asked.append(args) or plain(*args))
    pictures = [augment.colours(rng.integers(0, 256, 1024, np.uint8).tobytes()), rng.integers(0, 256, (37, 52, 3), np.uint8), np.full((20, 20, 3), 9, np.uint8), rng.integers(0, 256, (700, 640, 3), np.uint8)]
    for picture in pictures:
        for degrees, light in ((-12.0, 0.9), (3.3, 1.1), (0.0, 1.0)):
            side = min(picture.shape[:2])
            area = (0.3 * (picture.shape[1] - side), 0.6 * (picture.shape[0] - side), 0.3 * (picture.shape[1] - side) + side, 0.6 * (picture.shape[0] - side) + side)
            got = augment.shown(picture, 480, area, degrees, 80, light)
            want = rotated_slowly(plain(picture, 480, 480, area), degrees, False)[80:400, 80:400] if side < 50 else augment.rotated(plain(picture, 480, 480, area), degrees, False, 80)
            assert np.array_equal(got, np.clip(np.arange(256) * light, 0, 255).astype(np.uint8)[want])
    assert [args[0].shape for args in asked] == [(700, 640, 3)] * 3
    halves, area = np.tile(np.array([[0, 1], [1, 0]], np.uint8), (8, 8))[:, :, None], (0.5, 0, 16.5, 16)  # means of two lie midway
    assert np.array_equal(augment.shown(halves, 16, area, 5.0, 5, 1.0), augment.rotated(plain(halves, 16, 16, area), 5.0, False, 5)) and len(asked) == 4
    assert np.array_equal(augment.shown(halves, 16, area, 30.0, 0, 1.0), augment.rotated(plain(halves, 16, 16, area), 30.0, False)) and len(asked) == 5


def test_augmented_rows_equal_single_pictures(spark, monkeypatch):
    """Subjects are cut out and turned several at once; a row without one, or with a wrong raster, leaves the others as they are."""
    rng = np.random.default_rng(12)
    rasters = [rng.integers(0, 256, 1024, np.uint8).tobytes() if k % 7 else bytes(1024) for k in range(40)]
    rasters[5] = b"too short"
    data = [(k, f"g/{k}.png", rasters[k], rasters[k - 1] if k % 5 else None) for k in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, relpath string, pixels binary, background binary")
    want = []
    for k, path, pixels, background in data:
        try:
            rgb, draws = augment.colours(pixels), augment.generator(path)
            picture = augment.transform(rgb, draws) if background is None else augment.composite(rgb, augment.colours(background), draws)
            want.append((k, "done", hashlib.sha256(picture.tobytes()).hexdigest()))
        except ValueError:
            want.append((k, "no_subject", None))
    assert sorted(map(tuple, augment.augmented(frame).collect())) == want and sum(w[2] is None for w in want) == 8
    stack = [rng.integers(0, 256, (23, 31, 3), np.uint8) // 4 * np.uint8(k % 3) + np.uint8(60) for k in range(9)]
    masks = augment.subject_masks(np.stack(stack, axis=2))
    for k, one in enumerate(stack):
        open_ = augment.saturation(one) <= augment.BACKDROP
        reached = np.zeros((25, 33), bool)
        around = np.pad(open_, 1, constant_values=True)  # beyond the border all is open
        reached[0, 0] = True
        while True:
            more = reached.copy()
            more[1:] |= reached[:-1]
            more[:-1] |= reached[1:]
            more[:, 1:] |= reached[:, :-1]
            more[:, :-1] |= reached[:, 1:]
            if np.array_equal(more & around, reached):
                break
            reached = more & around
        assert np.array_equal(augment.exterior(open_), reached[1:-1, 1:-1])
        assert np.array_equal(masks[:, :, k], augment.subject_masks(one[:, :, None])[:, :, 0])


@pytest.mark.parametrize("alone", [True, False])
def test_hashes_compared_in_blocks_equal_all_pairs(spark, alone, monkeypatch):
    """At 18 bits no join on keys is made, so that rows don't multiply; blocks are small here."""
    monkeypatch.setattr(visual, "BLOCK_ROWS", 70)
    monkeypatch.setattr(visual, "PAIRS_OUT", 50)
    rng = random.Random(44)
    base = [rng.getrandbits(63) for _ in range(40)]
    near = lambda: rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 24)))
    left, right = [(k, near()) for k in range(500)], [(k, near()) for k in range(230)]
    frame = lambda side: spark.createDataFrame([*side, (9999, None)], "id long, h long")
    found = visual.hamming_join(frame(left), None if alone else frame(right), 18)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(x, y) for x, h in left for y, g in (left if alone else right) if (not alone or x < y) and (h ^ g).bit_count() <= 18]
    assert want and rows(found) == sorted(want)


def test_verified_pairs_fold_each_text_once(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("binary")
    def counted(values: pd.Series) -> pd.Series:
        made.add(len(values))
        return values

    pixels = [(k, bytes((k // 2 * 7 + i) % 256 for i in range(1024))) for k in range(40)]
    plain = spark.createDataFrame(pixels, "doc_id long, pixels binary")
    monkeypatch.setattr(duplicates, "rasters", lambda *_: plain.select("doc_id", counted.asNondeterministic()("pixels").alias("pixels")))
    assert all(a % 2 == b % 2 == 0 for a, b in rows(duplicates.verified_pairs(spark, None)))
    assert made.value == 40


def test_masks_take_one_pass_of_python(spark, tmp_path):
    """Folding and masking in one worker, not in two that each hold a batch of the other's rows."""
    from sievework.plans import augmenting, duplicates

    texts = ["", "a plain text", "\u00e9\u4e2d" * 900, None, "z" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one = augmenting.saturation_flood_mask(spark, str(tmp_path))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, augment.mask_summary(duplicates.rasters(spark, str(tmp_path))).collect()))


def test_edges_within_classes_are_those_of_brute_force(spark):
    """No edge joins two classes, so that none has to be dealt out to learn its ends' classes."""
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(k, rng.choice(base) ^ (1 << rng.randrange(63)), rng.choice("PN")) for k in range(150)]
    found = duplicates.edges_within(spark.createDataFrame(rows, "id long, h long, side string"), 3)
    wanted = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and (a[1] ^ b[1]).bit_count() <= 3]
    assert sorted(tuple(r) for r in found.collect()) == wanted and len(wanted) > 100
