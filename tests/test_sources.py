"""The tree reader and the two-phase sink."""

from __future__ import annotations

import os
import signal

import numpy as np
import pyarrow as pa
import pytest

from sievework.sources import commit, sinks, tree


@pytest.fixture
def folders(tmp_path):
    root = tmp_path / "root"
    for grp, name in (("a", "1.jpg"), ("a", "2.PNG"), ("a", "notes.txt"), ("b", "3.jpg"), ("b", ".hidden")):
        (root / grp).mkdir(parents=True, exist_ok=True)
        (root / grp / name).write_bytes(name.encode())
    (root / "c").mkdir()
    (root / "a" / "deep").mkdir()
    (root / "a" / "deep" / "4.jpg").write_bytes(b"x")
    (root / "loose.jpg").write_bytes(b"x")
    return root


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("grp", "name"))).collect())


def test_listing(spark, folders):
    root = str(folders)
    assert found(tree.listing(spark, root)) == [("a", "1.jpg"), ("a", "2.PNG"), ("b", "3.jpg")]
    rows = {r["name"]: r for r in tree.listing(spark, root).collect()}
    assert rows["2.PNG"]["suffix"] == ".png" and rows["2.PNG"]["length"] == 5 and rows["2.PNG"]["path"] == f"{root}/a/2.PNG"
    assert abs(rows["1.jpg"]["modified"].timestamp() - os.path.getmtime(f"{root}/a/1.jpg")) < 1
    assert [r["grp"] for r in tree.listing(spark, root, empty=True).where("name IS NULL").collect()] == ["c"]
    assert ("a", "deep") in found(tree.listing(spark, root, every=True)) and ("b", ".hidden") in found(tree.listing(spark, root, every=True))
    assert found(tree.listing(spark, f"{root}/a", flat=True)) == [("a", "1.jpg"), ("a", "2.PNG")]
    assert found(tree.listing(spark, root, suffixes=(".png",))) == [("a", "2.PNG")]


def test_conditions_reach_the_reader(spark, folders):
    listed = tree.listing(spark, str(folders))
    some = listed.where("grp = 'a' AND suffix IN ('.png', '.gif') AND length > 1")
    assert found(some) == [("a", "2.PNG")]
    reader = tree.TreeReader({"path": str(folders)})
    left = list(reader.pushFilters([tree.EqualTo(("grp",), "a"), tree.In(("suffix",), (".png",)), tree.In(("grp",), ("a", "b")), tree.EqualTo(("length",), 5)]))
    assert [f.attribute for f in left] == [("length",)] and reader.wanted == {"grp": {"a"}, "suffix": {".png"}}
    assert [p.groups for p in reader.partitions()] == [[("a", f"{folders}/a")]]
    os.chmod(folders / "b", 0)  # a group that isn't wanted isn't listed
    try:
        assert found(listed.where("grp = 'a'")) == [("a", "1.jpg"), ("a", "2.PNG")]
    finally:
        os.chmod(folders / "b", 0o755)


def test_links(spark, folders, tmp_path):
    (folders / "a" / "5.jpg").symlink_to(folders / "b" / "3.jpg")
    (folders / "a" / "6.jpg").symlink_to(folders / "nowhere.jpg")
    assert found(tree.listing(spark, str(folders)).where("is_link")) == [("a", "5.jpg")]
    assert ("a", "6.jpg", False) in found(tree.listing(spark, str(folders), every=True), "grp", "name", "is_file")
    (folders / "d").symlink_to(folders / "b")
    assert ("d", "3.jpg") in found(tree.listing(spark, str(folders)))
    outside = tmp_path / "outside"
    outside.mkdir()
    (folders / "e").symlink_to(outside)
    with pytest.raises(Exception, match="leads out of"):
        tree.listing(spark, str(folders)).collect()
    (tmp_path / "link").symlink_to(folders)
    for bad in (tmp_path / "link", tmp_path / "missing"):
        with pytest.raises(Exception, match="not a folder"):
            tree.listing(spark, str(bad)).collect()


def test_each_file_is_decoded_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {f"{k}.png": rng.integers(0, 256, (5, 4 + k, 3)).astype(np.uint8) for k in range(6)}
    (tmp_path / "g").mkdir()
    for name, picture in pictures.items():
        (tmp_path / "g" / name).write_bytes(sinks.png(picture))
    (tmp_path / "g" / "broken.png").write_bytes(b"no picture")
    (tmp_path / "g" / "x.webp").write_bytes(b"RIFF\x04\0\0\0WEBP")
    reads, decodes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    chosen = tree.listing(spark, str(tmp_path)).where("name <> '0.png'")
    done = tree.decoded(chosen.unionByName(chosen), reads, decodes)
    for _ in range(2):
        got = {os.path.basename(r["path"]): r for r in done.collect()}
        assert got.keys() == pictures.keys() - {"0.png"}
        assert all(bytes(r["data"]) == pictures[n].tobytes() and (r["height"], r["width"], r["channels"]) == pictures[n].shape for n, r in got.items())
    assert (reads.value, decodes.value) == (7, 5)
    assert sorted(os.path.basename(r["path"]) for r in tree.unreadable(chosen, done).collect()) == ["broken.png", "x.webp"]


def content(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file()}


def files(spark, rows):
    return spark.createDataFrame([(g, n, None if c is None else bytearray(c)) for g, n, c in rows], "grp string, name string, content binary").repartition(3)


def test_folders_are_replaced(spark, tmp_path):
    out = tmp_path / "out"
    rows = [("a", f"{k:04}.jpg", b"%d" % k) for k in range(1, 30)] + [("b", "0001.jpg", b"x"), ("b", "0002.jpg", None), ("b", "../0003.jpg", b"y"), ("b", None, b"z")]
    actions, counts = commit.replace_folders(files(spark, rows), str(out), ["a", "b", "c"], numbered=True)
    assert counts == {"written": 30, "removed": 0, "failed": 0} and actions.where("action = 'write' AND done").count() == 30
    assert content(out) == {f"a/{k:04}.jpg": b"%d" % k for k in range(1, 30)} | {"b/0001.jpg": b"x"} and (out / "c").is_dir()
    (out / "other").mkdir()
    (out / "other" / "mine.txt").write_bytes(b"x")  # not of these groups
    actions, counts = commit.replace_folders(files(spark, [("a", "0001.jpg", b"new")]), str(out), ["a", "b"], numbered=True)
    assert counts == {"written": 1, "removed": 29, "failed": 0}
    assert content(out) == {"a/0001.jpg": b"new", "other/mine.txt": b"x"}
    assert sorted((r["grp"], r["count"]) for r in actions.where("action = 'delete' AND done").groupBy("grp").count().collect()) == [("a", 28), ("b", 1)]


@pytest.mark.parametrize("foreign", ["notes.txt", "12.png", "link", "folder"])
def test_foreign_content_stops_before_any_change(spark, tmp_path, foreign):
    out = tmp_path / "out"
    commit.replace_folders(files(spark, [("a", "0001.jpg", b"1"), ("b", "0001.jpg", b"1")]), str(out), ["a", "b"])
    if foreign == "link":
        (out / "b" / "0002.jpg").symlink_to(out / "a" / "0001.jpg")
    elif foreign == "folder":
        (out / "b" / "0002.jpg").mkdir()
    else:
        (out / "b" / foreign).write_bytes(b"x")
    before = content(out)
    with pytest.raises(ValueError, match="b holds"):
        commit.replace_folders(files(spark, [("a", "0001.jpg", b"2")]), str(out), ["a", "b"], numbered=True)
    assert content(out) == before
    (out / "b").rename(tmp_path / "away")
    (out / "b").symlink_to(tmp_path / "away")
    with pytest.raises(ValueError, match="not a folder"):
        commit.replace_folders(files(spark, [("a", "0001.jpg", b"2")]), str(out), ["a", "b"])


@pytest.mark.parametrize("kill", [True, False])
def test_a_task_that_dies_leaves_the_old_folder_whole(spark, tmp_path, kill):
    out = tmp_path / "out"
    commit.replace_folders(files(spark, [("a", f"{k:04}.jpg", b"old") for k in range(20)]), str(out), ["a"])
    before = content(out)

    def half_way(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1)
                if batch.column(1)[k].as_py() == "0033.jpg":
                    if kill:
                        os.kill(os.getpid(), signal.SIGKILL)
                    raise RuntimeError("half-way")

    fresh = files(spark, [("a", f"{k:04}.jpg", b"new") for k in range(40)]).mapInArrow(half_way, "grp string, name string, content binary")
    with pytest.raises(Exception):  # noqa: B017
        commit.replace_folders(fresh, str(out), ["a"])
    assert content(out) == before and [p.name for p in out.iterdir()] == ["a"]


def test_a_run_that_stops_after_its_commit_is_ended_by_the_next(spark, tmp_path):
    out = tmp_path / "out"
    commit.replace_folders(files(spark, [("a", "0001.jpg", b"old"), ("a", "0002.jpg", b"old")]), str(out), ["a"])
    folder = commit.stage(files(spark, [("a", "0001.jpg", b"new"), ("a", "0003.jpg", b"new")]), str(out))
    commit.remember(folder, ["a"])
    # stopped half-way through moving: one file is in its place already
    with open(f"{folder}/{commit.COMMITTED}") as told:
        lists = [f"{line.strip()}/{commit.LISTED}" for line in told]
    first = next(iter(spark.read.schema(commit.LISTING).json(lists).where("name = '0003.jpg'").collect()))
    os.replace(first["staged"], out / "a" / "0003.jpg")
    uncommitted = out / f"{commit.STAGING}x"
    uncommitted.mkdir()
    assert commit.recover(spark, str(out)) == [{"written": 2, "removed": 1, "failed": 0}]
    assert content(out) == {"a/0001.jpg": b"new", "a/0003.jpg": b"new"} and [p.name for p in out.iterdir()] == ["a"]
    assert commit.recover(spark, str(out)) == [] == commit.recover(spark, str(tmp_path / "none"))


def test_a_place_that_is_a_link_is_left_alone(tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "target").write_bytes(b"mine")
    (tmp_path / "g" / "1.jpg").symlink_to(tmp_path / "target")
    (tmp_path / "staged").write_bytes(b"new")
    batch = pa.RecordBatch.from_arrays([pa.array(["g"]), pa.array(["1.jpg"]), pa.array([str(tmp_path / "staged")])], names=["grp", "name", "staged"])
    (done,) = commit.moved(iter([batch]), str(tmp_path))
    (gone,) = commit.removed(iter([pa.RecordBatch.from_arrays([pa.array(["g"]), pa.array(["1.jpg"]), pa.array([str(tmp_path / "g" / "1.jpg")])], names=["grp", "name", "path"])]))
    assert done.column(3).to_pylist() == gone.column(3).to_pylist() == [False] and (tmp_path / "target").read_bytes() == b"mine"
