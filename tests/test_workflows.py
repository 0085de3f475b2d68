"""The two runs over small trees of pictures."""

from __future__ import annotations

import json

import numpy as np
import pytest

from sievework.operators import mask_cache
from sievework.plans import workflows
from sievework.sources import sinks


def scene(seed: int, h: int = 40, w: int = 40) -> np.ndarray:
    """A smooth picture that no other seed resembles."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / 40
    waves = [sum(rng.uniform(-1, 1) * np.cos(2 * np.pi * (rng.uniform(0, 3) * x + rng.uniform(0, 3) * y) + rng.uniform(0, 6)) for _ in range(6)) for _ in range(3)]
    return np.clip(128 + 40 * np.dstack(waves), 0, 255).astype(np.uint8)


def put(folder, name: str, picture: np.ndarray) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(sinks.png(picture))


def subject(seed: int) -> np.ndarray:
    picture = np.full((60, 60, 3), 250, np.uint8)
    picture[15:45, 20:40] = np.array([[220, 20 + seed, 30]], np.uint8)
    return picture


@pytest.fixture
def classes(tmp_path):
    good, bad = tmp_path / "in" / "good", tmp_path / "in" / "bad"
    put(good / "a", "x.png", scene(1))
    put(good / "a", "x_again.png", np.clip(scene(1).astype(int) + 1, 0, 255).astype(np.uint8))
    put(good / "b", "wide.png", scene(2, 40, 60))
    put(bad / "a", "y.png", scene(3))
    put(bad / "a", "same.png", scene(1))
    (good / "b" / "broken.png").write_bytes(b"no picture")
    for k in range(4):
        put(tmp_path / "in" / "pool", f"p{k}.png", scene(10 + k))
    (tmp_path / "in" / "good.json").write_text("﻿" + json.dumps({"sources": [{"path": "pool", "count": 2}]}), encoding="utf-8")
    return tmp_path


def combine(spark, base, **options):
    root = str(base / "in")
    return workflows.combine(spark, root, {"P": f"{root}/good", "N": f"{root}/bad"}, {"P": str(base / "P"), "N": str(base / "N")}, {"P": f"{root}/good.json"}, **options)


def test_combine(spark, classes):
    plan = {(r["side"], r["output"]): r for r in combine(spark, classes, default="N").collect()}
    actions = {k: r["action"] for k, r in plan.items() if not k[1].startswith("pool_")}
    assert actions == {("P", "a_x.png"): "keep", ("P", "a_x_again.png"): "drop_internal", ("P", "b_wide.png"): "keep", ("N", "a_y.png"): "keep", ("N", "a_same.png"): "drop_cross"}
    assert sum(k[1].startswith("pool_") for k in plan) == 2
    assert plan["P", "b_wide.png"]["cropped"] and not plan["P", "a_x.png"]["cropped"]
    assert sorted(p.name for p in (classes / "N").iterdir()) == ["a_y.png"]
    assert (classes / "P" / "a_x.png").read_bytes() == (classes / "in" / "good" / "a" / "x.png").read_bytes()
    (wide,) = [r for r in sinks.read_pictures(spark, str(classes / "P")).collect() if r["path"].endswith("b_wide.png")]
    assert (wide["width"], wide["height"]) == (40, 40) and bytes(wide["data"]) == scene(2, 40, 60)[:, 10:50].tobytes()
    # again, with the other choice and an old picture in the folder
    put(classes / "N", "old.png", scene(5))
    choices = spark.createDataFrame([("a_x.png", "P")], "output string, choice string")
    again = {(r["side"], r["output"]): r["action"] for r in combine(spark, classes, choices=choices).collect()}
    assert again["P", "a_x.png"] == "drop_cross" and again["N", "a_same.png"] == "keep"
    assert sorted(p.name for p in (classes / "N").iterdir()) == ["a_same.png", "a_y.png"]


def test_combine_changes_nothing_if_a_check_fails(spark, classes):
    (classes / "N").mkdir()
    (classes / "N" / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="notes.txt"):
        combine(spark, classes)
    (classes / "N" / "notes.txt").unlink()
    (classes / "in" / "good.json").write_text(json.dumps({"sources": [{"path": "pool", "count": 9}]}))
    with pytest.raises(ValueError, match="too_few"):
        combine(spark, classes)
    assert not list((classes / "N").iterdir())


def test_combine_stops_on_an_open_conflict(spark, classes):
    with pytest.raises(ValueError, match="unresolved conflicts: .*a_x.png"):
        combine(spark, classes)
    assert not (classes / "P").exists() and not (classes / "N").exists()


def test_augment_tree(spark, tmp_path):
    root = tmp_path / "in"
    for k in range(3):
        put(root / "t" / "g", f"t{k}.png", subject(k))
        put(root / "c" / "g", f"c{k}.png", subject(10 + k))
        put(root / "b" / "plain", f"b{k}.png", scene(20 + k, 60, 60))
        put(root / "b" / "wood", f"w{k}.png", scene(30 + k, 60, 60))
    (tmp_path / "skip.txt").write_text("# list\nc\\g\\c1.png\n", encoding="utf-8")

    def go(output, **options):
        return workflows.augment_tree(spark, str(root), str(root / "t"), str(root / "c"), str(root / "b"), str(output), str(tmp_path / "skip.txt"), size=48, **options).collect()

    jobs = go(tmp_path / "out")
    assert sorted((r["kind"], r["output"], r["background"] is None) for r in jobs) == [("composite", "0001.jpg", False), ("composite", "0003.jpg", False)] + [("transform", f"000{k}.jpg", True) for k in (1, 2, 3)]
    first = {p.relative_to(tmp_path / "out"): p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")}
    assert len(first) == 5 and all(x[:2] == b"\xff\xd8" for x in first.values())
    (tmp_path / "out" / "composite_g" / "0002.jpg").write_bytes(b"stale")
    go(tmp_path / "out")
    assert {p.relative_to(tmp_path / "out"): p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")} == first
    # masks are kept: five at first, and one more for a picture that changed
    kept = str(tmp_path / "masks")
    for _ in range(2):
        go(tmp_path / "cached", cache=kept)
        assert {p.relative_to(tmp_path / "cached"): p.read_bytes() for p in (tmp_path / "cached").rglob("*.jpg")} == first
        assert mask_cache.entries(spark, kept).count() == 5
    put(root / "c" / "g", "c0.png", subject(14)[:, 5:])
    go(tmp_path / "cached", cache=kept)
    assert mask_cache.entries(spark, kept).count() == 5  # the changed picture's mask has taken the old one's place
    (tmp_path / "skip.txt").write_text("t/g/none.png\n")
    with pytest.raises(ValueError, match="none.png"):
        go(tmp_path / "other")
    assert not (tmp_path / "other").exists()


def masks(spark, rows):
    return spark.createDataFrame([(key, sign, 2, 1, bytearray(mask)) for key, sign, mask in rows], mask_cache.SCHEMA)


def test_mask_cache_keeps_the_latest_of_each_key(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert mask_cache.entries(spark, folder).count() == 0
    for k in range(12):
        mask_cache.add(masks(spark, [("a", f"s{k}", bytes([k, 1])), (f"k{k % 3}", "s", bytes([k, 2])), ("broken", "s", b"x")]), folder)
        held = {r["key"]: (r["signature"], bytes(r["mask"])) for r in mask_cache.entries(spark, folder).collect()}
        assert held["a"] == (f"s{k}", bytes([k, 1])) and held[f"k{k % 3}"] == ("s", bytes([k, 2])) and "broken" not in held
        assert len(held) == 1 + min(k + 1, 3)
    folders = [p.name for p in (tmp_path / "cache").iterdir() if p.is_dir()]
    now = mask_cache.snapshot(spark, folder)
    assert set(folders) == {*now["folders"], *now["before"]} and len(now["folders"]) <= mask_cache.MOST_FOLDERS


def test_a_reader_of_the_mask_cache_sees_one_snapshot(spark, tmp_path):
    folder = str(tmp_path / "cache")
    for k in range(3):
        mask_cache.add(masks(spark, [("a", f"s{k}", b"11"), (f"k{k}", "s", b"22")]), folder)
    reader = mask_cache.entries(spark, folder)
    mask_cache.compact(spark, folder)
    assert sorted((r["key"], r["signature"]) for r in reader.collect()) == [("a", "s2"), ("k0", "s"), ("k1", "s"), ("k2", "s")]
    assert sorted((r["key"], r["signature"]) for r in mask_cache.entries(spark, folder).collect()) == [("a", "s2"), ("k0", "s"), ("k1", "s"), ("k2", "s")]
    assert len(mask_cache.snapshot(spark, folder)["folders"]) == 1
    # a write that stops before the swap changes nothing
    masks(spark, [("a", "s9", b"99")]).write.parquet(f"{folder}/masks-lost")
    assert {r["signature"] for r in mask_cache.entries(spark, folder).where("key = 'a'").collect()} == {"s2"}


def test_combine_counts_what_was_done(spark, classes):
    for name in ("P", "N"):
        (classes / name).mkdir()
    put(classes / "N", "old.png", scene(5))
    wide = scene(6, 40, 50)
    (classes / "in" / "bad" / "a" / "flat.bmp").write_bytes(sinks.bmp(wide))
    counts = {}
    with pytest.warns(UserWarning, match="1 files can't be read: .*broken.png"):
        plan = combine(spark, classes, default="N", counts=counts)
    kept = plan.where("action = 'keep'").count()
    assert counts == {"unreadable": 1, "non_square": 2, str(classes): {"written": kept, "removed": 1, "failed": 0}}
    (flat,) = [r for r in sinks.read_pictures(spark, str(classes / "N")).collect() if r["path"].endswith("a_flat.bmp")]
    assert (classes / "N" / "a_flat.bmp").read_bytes()[:2] == b"BM" and bytes(flat["data"]) == wide[:, 5:45].tobytes()


def test_manifest_folders_are_resolved(spark, classes, tmp_path):
    inside, outside = classes / "in" / "again", tmp_path / "outside"
    put(outside, "o.png", scene(7))
    inside.symlink_to(classes / "in" / "pool")
    (classes / "in" / "away").symlink_to(outside)
    (classes / "in" / "empty").mkdir()
    for sources, error in (([{"path": "pool", "count": 1}, {"path": "again", "count": 1}], "source 2 .again.: repeated"), ([{"path": "away", "count": 1}], "source 1 .away.: outside"), ([{"path": "empty", "count": 1}], "too_few"), ([{"path": "none", "count": 1}], "no_folder")):
        (classes / "in" / "good.json").write_text(json.dumps({"sources": sources}))
        with pytest.raises(ValueError, match=error):
            combine(spark, classes, default="N")
    assert not (classes / "P").exists() and not (classes / "N").exists()


def test_combine_goes_on_after_an_open_conflict(spark, classes):
    decodes, work = spark.sparkContext.accumulator(0), str(classes / "work")
    with pytest.raises(ValueError, match="unresolved"):
        combine(spark, classes, work=work, decodes=decodes)
    first = decodes.value
    assert first == 7 and not (classes / "P").exists()
    choices = spark.createDataFrame([("a_x.png", "N")], "output string, choice string")
    plan = {(r["side"], r["output"]): r["action"] for r in combine(spark, classes, choices=choices, work=work, decodes=decodes).collect()}
    assert decodes.value == first and plan["N", "a_same.png"] == "drop_cross" and plan["P", "a_x.png"] == "keep"
    assert sorted(p.name for p in (classes / "N").iterdir()) == ["a_y.png"] and not list((classes / "work").iterdir())
    # other files are decoded anew
    put(classes / "in" / "bad" / "a", "z.png", scene(8))
    combine(spark, classes, choices=choices, work=work, decodes=decodes)
    assert decodes.value == 2 * first + 1


def test_outputs_are_squared_once(spark, tmp_path):
    out = tmp_path / "out"
    put(out, "square.png", scene(1))
    put(out, "wide.png", scene(2, 40, 50))
    put(tmp_path / "other", "tall.png", scene(3, 50, 40))
    (out / "link.png").symlink_to(tmp_path / "other" / "tall.png")
    (out / "broken.png").write_bytes(b"no picture")
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    assert workflows.normalize_output(spark, str(out)) == 1
    after = {p.name: p.read_bytes() for p in out.iterdir()}
    assert (out / "link.png").is_symlink() and {n for n in before if before[n] != after[n]} == {"wide.png"} and before.keys() == after.keys()
    (wide,) = [r for r in sinks.read_pictures(spark, str(out)).collect() if r["path"].endswith("wide.png")]
    assert bytes(wide["data"]) == scene(2, 40, 50)[:, 5:45].tobytes()
    assert workflows.normalize_output(spark, str(out)) == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["other", "out"]
    with pytest.raises(ValueError, match="not a folder"):
        workflows.normalize_output(spark, str(out / "link.png"))
