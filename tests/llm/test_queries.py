"""The registered queries and the pipeline over a small folder of tables, each output column against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import components, decontamination, language, lines, media, mixing, passages, quality, registry, secrets, simhash, tokens

TABLES = Path("/root/testdata/sf0.001")
WORDS = "the of and tion with that here some more words for every line we make up as long texts need".split()
ITEM = "what holds the old bridge over the river in winter when ice comes down from the hills"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with columns that clash with results and internal names, null, empty, repeated and long rows."""
    out, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    passage = prose(rng, 70)
    texts = [None, "", " \t\n", "AKIA" + "Z" * 20 + " token = abcdef123 " + "0123456789abcdef" * 3, f"before {ITEM} after", prose(rng, 5000)]
    texts += [prose(rng, 60) + " " + passage, passage + " " + prose(rng, 40), prose(rng, 200), "\n".join(["line one", "line two", "line three", "rest"]), "\n".join(["first", "line one", "line two", "line three"])]
    texts.append(texts[8])
    rows = [(k, t, ("en", "de")[k % 2] if t else None, "abc"[k % 3] if k else None, len(t or "")) for k, t in enumerate(texts)]
    if TABLES.exists():
        docs = pq.read_table(TABLES / "documents.parquet").to_pylist()
        rows += [(1000 + r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["places", "key", "id", "body", "node", "root", "score", "matches", "spans", "component_id", "held_out", "lang_pred", "fp", "size", "__row", "__d0", "range", "value"]
    docs.select("*", *[F.lit("x").alias(c) for c in clashing]).repartition(4).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    spark.createDataFrame([(r[0], int("!!" not in (r[1] or "") and "|" not in (r[1] or "")), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out), {r[0]: r for r in rows}


def run(spark, folder, name):
    found = registry.QUERIES[name](spark, folder[0]).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(folder[1])
    return {r["doc_id"]: r for r in found}


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def test_op1(spark, folder):
    got = run(spark, folder, "op1_secret_scan")
    for k, row in folder[1].items():
        spans = sorted((m.start(), n, m.end(), kind) for n, (kind, p, group, least) in enumerate(KINDS) for m in p.finditer(row[1] or "") if len(m[group]) >= least)
        for kind, *_ in KINDS:
            assert got[k][f"n_{kind}"] == sum(s[3] == kind for s in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans).encode()).hexdigest()
        every = [x.split(":") for x in got[k]["spans"].split(",") if x]
        assert {(int(s), int(e), kind) for kind, s, e in every} >= {(s, e, kind) for s, _, e, kind in spans}
        order = [k for k, *_ in secrets.BASE_KINDS + secrets.ENTROPY_KINDS]
        assert [(int(s), order.index(kind)) for kind, s, _ in every] == sorted((int(s), order.index(kind)) for kind, s, _ in every)


def test_op1_long_runs_of_every_kind(spark):
    texts = [unit * (1_000_000 // len(unit)) for unit in ("ab/", "path-to_", ".", "a.b/c_d-e=", "-", "Word+", "1234/")]
    found = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)).collect()
    assert len(found) == len(texts) and all(not r["base64_entropy"] and not r["hex_entropy"] for r in found)


def test_op2_splits_and_bounds(spark, folder):
    for k, r in run(spark, folder, "op2_quality_classifier").items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_op2_finds_planted_bad_lines(spark):
    rng = random.Random(4)
    good = lambda: prose(rng, 12).capitalize() + "."
    bad = lambda: " | ".join(prose(rng, 1) for _ in range(8)) if rng.random() < 0.5 else prose(rng, 8).upper().replace(" ", "!! ") + "!!"
    rows = [(k, "\n".join((good if k % 2 or i == 0 else bad)() for i in range(rng.randint(2, 6))), k % 2) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    planted = []
    for k in range(200):
        own = [good() for _ in range(rng.randint(3, 7))]
        at = rng.randint(0, len(own))
        planted.append((k, "\n".join(own[:at] + [bad()] + own[at:]), at))
    scored = quality.score_quality(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"), model, lines=True).collect()
    places = {p[0]: p[2] for p in planted}
    assert np.mean([places[r["doc_id"]] in r["bad_lines"] for r in scored]) > 0.9
    wrong = sum(len(set(r["bad_lines"]) - {places[r["doc_id"]]}) for r in scored)
    assert wrong / sum(p[1].count("\n") for p in planted) < 0.05


def test_op3(spark, folder):
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in registry.QUERIES["op3_decontamination"](spark, folder[0]).collect()}
    assert got == {(4, 1, 0)}


def test_op3_blocks_and_string_ids(spark):
    items = spark.createDataFrame([(f"i{k}", f"item number {k} " + prose(random.Random(k), 12)) for k in range(12)], "name string, body string")
    rows = [(k, "start " + r["body"] + " end") for k, r in enumerate(items.collect())] + [(99, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = {"item_col": "name", "item_text_col": "body", "block_chars": 200}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(docs, items, **named).collect()} == {(k, f"i{k}") for k in range(12)}
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, items, **named).collect()] == [99]


def test_op4(spark, folder):
    seen: set = set()
    got = run(spark, folder, "op4_line_dedup")
    for k in sorted(folder[1]):
        t = folder[1][k][1]
        own, gone = t.split("\n") if t is not None else [], set()
        for at in range(len(own) - 2):
            window = tuple(x.strip(" ") for x in own[at : at + 3])
            if any(window):
                gone |= {at, at + 1, at + 2} if window in seen else set()
                seen.add(window)
        kept = None if t is None else "\n".join(x for n, x in enumerate(own) if n not in gone)
        assert tuple(got[k][c] for c in ("n_lines", "n_removed", "removed", "kept_text")) == (len(own), len(gone), ",".join(map(str, sorted(gone))), kept)


def test_op5(spark, folder):
    got = run(spark, folder, "op5_telephony_audio")
    for k, row in folder[1].items():
        raw = (row[1] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        codec = media.CODECS[zlib.crc32(payload) % 3]
        file = media.pack(payload, codec)
        pcm = media.resample(media.decode_many([file])[0])
        wanted = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), media.feature(codec, pcm))
        assert tuple(got[k][c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == wanted


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op6_links_all_verbatim_passages(spark, folder):
    got = run(spark, folder, "op6_substring_dedup")
    first: dict = {}
    links = set()
    for k in sorted(folder[1]):
        words = (folder[1][k][1] or "").lower().split()
        for at in range(len(words) - 49):
            links.add((first.setdefault(tuple(words[at : at + 50]), k), k))
    for a, b in links:
        assert got[a]["component_id"] == got[b]["component_id"] and (a == b or got[b]["n_links"] > 0 < got[a]["n_links"])
    assert all((r["n_links"] > 0) == (sum(x["component_id"] == r["component_id"] for x in got.values()) > 1) for r in got.values())


def test_op7(spark, folder):
    got = run(spark, folder, "op7_simhash")
    prints = {k: simhash.fingerprint(row[1]) for k, row in folder[1].items()}
    wanted = components_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{p:016x}", wanted[k]) for k, p in prints.items()}


def test_op8(spark, folder):
    langs = {row[2] for row in folder[1].values()} - {None}
    for k, r in run(spark, folder, "op8_language_id").items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in langs if any(map(str.isalpha, folder[1][k][1] or "")) else r["lang_pred"] == language.UNKNOWN


def test_op9(spark, folder):
    model = tokens.load("piece_bpe_32k.model")
    for k, r in run(spark, folder, "op9_token_counts").items():
        t = folder[1][k][1] or ""
        n = len(model.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_op10(spark, folder):
    got = run(spark, folder, "op10_mix_sources")
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")) for k, row in folder[1].items()}
    assert all(got[k]["size"] == n and got[k]["taken"] <= 2 * n for k, n in sizes.items())
    for source in {row[3] for row in folder[1].values()}:
        own = [k for k, row in folder[1].items() if row[3] == source]
        assert {got[k]["source_size"] for k in own} == {sum(sizes[k] for k in own)}
        assert sum(got[k]["taken"] for k in own) == int(got[own[0]]["target"])
    assert {k: tuple(r) for k, r in run(spark, folder, "op10_mix_sources").items()} == {k: tuple(r) for k, r in got.items()}


def test_ranges_do_not_change_the_mix(spark, folder, monkeypatch):
    docs = spark.read.parquet(folder[0] + "/documents.parquet")
    one = {tuple(r) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert {tuple(r) for r in mixing.mix(docs).collect()} == one


def test_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).collect()
    docs = spark.read.parquet(folder[0] + "/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder[0])
        assert kept.columns == docs.columns and kept.select("places", "range").distinct().collect() == [("x", "x")]
        assert {r[0] for r in kept.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    ids = {r["doc_id"] for r in got}
    assert ids == {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & {0, 1, 2, 4} and not {8, 11} <= ids and {5, 6, 7, 9} <= ids


def jaccard(a, b):
    a, b = (set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for t in (a, b))
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("draws", [0, 3])
def test_similar_texts_equal_brute_force(spark, draws, monkeypatch):
    """A crowd of variants of one text, many of them alike to a few only: after the firsts and draws, rare tokens decide."""
    monkeypatch.setattr(components.link_groups, "__defaults__", (draws,))
    rng = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(70):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(0, 7)):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    texts += [prose(rng, 80) for _ in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == components_of(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(texts[a], texts[b]) >= 0.8])


def test_sketches_bound_differences():
    rng = np.random.default_rng(8)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 800))) for _ in range(2))
        bits = sum((int(x) ^ int(y)).bit_count() if x >= 0 and y >= 0 else ((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(simhash.sketch(a), simhash.sketch(b), strict=True))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("draws", [0, 3])
def test_near_passages_equal_brute_force(spark, draws, monkeypatch):
    """Variants of a 90-word passage, with some words changed, between other words."""
    monkeypatch.setattr(components.link_groups, "__defaults__", (draws,))
    rng = random.Random(9)
    base = [f"b{k}" for k in range(90)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(90), rng.randint(0, 9)):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join([f"l{k}w{i}" for i in range(rng.randint(5, 30))] + own + [f"r{k}w{i}" for i in range(rng.randint(5, 30))]))
    found = [passages.tokens(t) for t in texts]

    def linked(a, b):
        known = np.isin(found[a], found[b])
        return bool(passages.spans_of(known, passages.LENGTH, passages.SIMILARITY * 2 / (1 + passages.SIMILARITY)))

    got = {r["doc_id"]: r["component_id"] for r in passages.passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == components_of(range(60), [(a, b) for a in range(60) for b in range(a) if linked(a, b)])


def test_long_and_repetitive_texts_have_few_windows():
    assert len(passages.windows_of([b"same " * 20_000], 4, passages.LENGTH)[0]) < 4 * 200
    rng = random.Random(10)
    text = prose(rng, 3000)
    whole = passages.tokens(text)
    size, passages.PIECE_BYTES = passages.PIECE_BYTES, 2000
    try:
        parts = list(passages.pieces(passages.lowered(text), 2000))
        assert len(parts) > 5 and parts[-1][0] + len(parts[-1][1].split()) == 3000
        assert all(b.split() == text.split()[n : n + len(b.split())] for n, b in ((n, b.decode()) for n, b in parts))
    finally:
        passages.PIECE_BYTES = size
    assert len(whole) == 2996


def test_lines_with_an_extra_column_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x", "y"), (2, "a\nb\nc\nd", "x", "y")], "doc_id long, text string, places string, `__row` string")
    got = lines.drop_repeated_lines(docs)
    assert {r["doc_id"]: (r["text"], r["places"], r["__row"]) for r in got.collect()} == {1: ("a\nb\nc", "x", "y"), 2: ("d", "x", "y")}


@pytest.mark.parametrize("stage", ["language_id", "line_dedup"])
def test_stages_take_any_column_name(spark, folder, stage):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumn("a.b", F.lit("kept"))
    run_stage = dict(corpus_pipeline.STAGES)[stage]
    found, plain = run_stage(spark, docs, folder[0]), run_stage(spark, docs.select(*[f"`{c}`" for c in docs.columns if c != "a.b"]), folder[0])
    assert found.columns == docs.columns and {r["a.b"] for r in found.select("`a.b`").collect()} == {"kept"}
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)
    assert key(found) == key(plain)


def test_op6_counts_all_verbatim_links_and_spans(spark):
    """Pairs that other links hold together already count all the same, and have their spans."""
    word = lambda name, n: [f"{name}{k}" for k in range(n)]
    p, q, r = word("p", 60), word("q", 60), word("r", 60)
    rows = [p + q, word("a", 9) + q + word("b", 9) + r, word("c", 7) + r + word("d", 5) + p, p + word("e", 30) + r + word("f", 9) + q, word("z", 80)]
    rows += [word("i", 3) + word("s", 50) * 2, word("j", 70) + word("s", 50)]
    docs = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.passage_classes(docs).collect()}
    assert [(got[k]["component_id"], got[k]["n_links"]) for k in range(7)] == [(0, 3), (0, 3), (0, 3), (0, 3), (4, 0), (5, 1), (5, 1)]
    covered = {k: {i for s, e in r["spans"] for i in range(s, e)} for k, r in got.items()}
    assert covered[2] >= {*range(7, 67), *range(72, 132)} and covered[3] >= {*range(60), *range(90, 150), *range(159, 219)} and covered[6] >= set(range(70, 120))


@pytest.mark.parametrize("seed", [3, 4])
def test_partners_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    held = {(f"run{k}", node) for k in range(12) for node in rng.sample(range(30), rng.choice([2, 3, 8, 20]))}
    held |= {(f"in{k}", node) for k in range(4) for node in sorted(n for r, n in held if r == "run0")[:2]}
    sets = {r: frozenset(n for x, n in held if x == r) for r, _ in held}
    runs = spark.createDataFrame([(n, hash(sets[r]) >> 1, len(sets[r])) for r, n in held], "node long, clique long, n long")
    got = {r["node"]: r["partners"] for r in passages.partners(passages.cliques_of(runs)).collect()}
    assert got == {n: len(set().union(*[x for x in sets.values() if n in x])) - 1 for _, n in held}


def test_partners_of_large_families_make_no_pairs(spark, monkeypatch):
    """Counts equal brute force over many blocks, and nothing is compared clique list by clique list."""
    monkeypatch.setattr(passages.F, "array_intersect", None)
    rng = random.Random(5)
    sets = {k: frozenset(rng.sample(range(1400), rng.choice([2, 40, 700]))) for k in range(24)}
    runs = spark.createDataFrame([(n, k, len(s)) for k, s in sets.items() for n in s], "node long, clique long, n long")
    got = {r["node"]: r["partners"] for r in passages.partners(passages.cliques_of(runs)).collect()}
    held = set().union(*sets.values())
    assert got == {n: len(set().union(*[s for s in sets.values() if n in s])) - 1 for n in held} and len(got) > 1024


def test_partners_meet_no_more_for_more_tasks(spark, monkeypatch):
    """The bits that kinds of texts meet hang neither on the tasks that sort them nor on the square of a family."""
    made = []
    kept = passages.common.checkpointed
    monkeypatch.setattr(passages.common, "checkpointed", lambda df: made.append(kept(df)) or made[-1])
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, *by, f=type(spark.range(0)).repartitionByRange: f(self, 40, *by))
    family = range(700)
    sets = {k: frozenset(n for n in family if n % 20 != k) if k else frozenset(family) for k in range(20)}
    runs = spark.createDataFrame([(n, k, len(s)) for k, s in sets.items() for n in s], "node long, clique long, n long")
    cliques = passages.cliques_of(runs)
    del made[:]
    got = {r["node"]: r["partners"] for r in passages.partners(cliques).collect()}
    assert got == dict.fromkeys(family, 699)
    assert [df.count() for df in made if "block" in df.columns] and all(df.count() <= 2 * len(sets) for df in made if "block" in df.columns)


def test_window_bounds_are_found_for_all_at_once(monkeypatch):
    """A row of falling, rising or equal values takes few steps."""
    for values in (np.arange(1 << 12), np.arange(1 << 12)[::-1], np.ones(1 << 12)):
        found = passages.window_bounds(values.astype(np.uint64), passages.LENGTH)
        assert found.shape[1] == 3 and [tuple(x) for x in found.tolist()] == passages.compact_windows(values.astype(np.uint64), passages.LENGTH)
    assert passages.nearest_before(np.array([2, 2, 1, 3, 1], np.uint64), False).tolist() == [-1, 0, -1, 2, 2]
    assert passages.nearest_before(np.array([2, 2, 1, 3, 1], np.uint64), True).tolist() == [-1, -1, -1, 2, -1]


def test_repeated_places_are_those_after_the_first():
    row = np.array([7] * 12 + [1, 2, 3] + [7] * 4, np.uint64)
    seen, wanted = set(), []
    padded = [0, 0, *row.tolist(), 0, 0]
    for k in range(len(row)):
        key = tuple(padded[k : k + 5])
        wanted += [k] * (key in seen)
        seen.add(key)
    assert passages.repeated_places(row, 2).tolist() == wanted and len(wanted) == 7


def test_op6_makes_runs_once(spark):
    """Groups and join read the same dealt-out rows; a text's repeated run is marked as such, and found wherever the text holds it."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(4000)]
    passage = " ".join(rng.sample(words, 60))
    texts = {1: passage + " " + " ".join(rng.sample(words, 30)), 2: " ".join(rng.sample(words, 90)), 3: " ".join(rng.sample(words, 20)) + f" {passage} x {passage}"}
    windows = passages.shared_windows(spark.createDataFrame(list(texts.items()), "id long, body string"), passages.HASHES, passages.LENGTH)
    own = windows.groupBy("id").agg(F.collect_list(F.struct("value", "place")).alias("windows"))
    bodies = spark.createDataFrame(list(texts.items()), "id long, body string").join(own, "id").localCheckpoint()
    runs = passages.shared_runs(bodies, passages.LENGTH)
    got = sorted((r["node"], r["at"], r["first"], r["n"], r["low"]) for r in runs.collect())
    assert got == [(1, k, True, 2, 1) for k in range(11)] + [(3, 20 + k, True, 2, 1) for k in range(11)] + [(3, 81 + k, False, 2, 1) for k in range(11)]
    plan = runs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan
