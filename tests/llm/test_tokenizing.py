"""Alignment, the filter audit, and byte-level BPE against brute force and the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import alignment, audit, bpe, registry

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SIGNS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "s", "1", "22", "é", "日", "😀", "😃", "́", "ß", "_", "-", "‍", "<|endoftext|>", "<0x41>", "<s>", "▁", "\x1c", "\x85", "\xa0", "²", "Ⅷ", "ᲊ", "\U000105c0"]
AWKWARD = [None, "", " ", "\n", "  a  b ", "▁x", "a" * 3000, "ab" * 5000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "I'LL we'll it's 'tis", "日本語😀😃 x\x00y", " " * 200, "=" * 300 + "\n\n\n  z"]


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) if rng.random() < 0.9 else chr(rng.randrange(0x80, 0xD7FF)) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    made = AWKWARD + random_texts(1, 400)
    return [*made, *made[-3:], "the end of all these words is here " * 4000]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    """documents with repeated rows and clashing columns, and an empty table."""
    out = tmp_path_factory.mktemp("tokenizing")
    docs = spark.createDataFrame([(k, t, [None, "en", "de"][k % 3]) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = docs.select("*", *[F.lit("x").alias(f"`{c}`" if "." in c else c) for c in ("ids", "groups", "__row", "pair", "n", "a_ids", "part", "mask", "id", "a.b")])
    docs.repartition(3).write.parquet(str(out / "full" / "documents.parquet"))
    docs.where("false").write.parquet(str(out / "empty" / "documents.parquet"))
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(0, len(texts), 3)], "doc_id long, quality int, toxic int")
    for kind in ("full", "empty"):
        labels.write.parquet(str(out / kind / "labels.parquet"))
    return str(out)


def test_op13(spark, folder, texts):
    own = Tokenizer.from_file(public_tokenizers.path(A))
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_bpe"](spark, f"{folder}/full").collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        back = own.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got[k])[1:] == want, text


def test_bpe_cuts_every_character_as_the_library_does():
    own, words = Tokenizer.from_file(public_tokenizers.path(A)).pre_tokenizer, bpe.vocabulary(A)
    every = [chr(c) for c in itertools.chain(range(0x3400), range(0x3400, 0xD800, 9), range(0xE000, 0x20000), range(0x20000, sys.maxunicode + 1, 50))]
    known = [c for c in every if words.only_old(c)]
    assert len(known) > 0.9 * len(every)
    for k in range(0, len(known), 500):
        text = " ".join(f"a{c}1{c}! {c} {c}{c} '{c}'s" for c in known[k : k + 500])
        assert words.all_words([text])[0] == [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)], hex(ord(known[k]))


def test_bpe_options(spark):
    own = Tokenizer.from_file(public_tokenizers.path(A))
    own.encode_special_tokens = True
    rows = [(k, t) for k, t in enumerate(random_texts(2, 100))]
    encoded = bpe.encode_texts(spark.createDataFrame(rows, "doc_id int, text string"), specials=False).collect()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == own.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids for r in encoded)
    odd = [(1, None), (2, bytearray()), (3, bytearray(np.array([60000, 64], "<u4").tobytes())), (4, bytearray(np.array([160], "<u4").tobytes()))]
    back = dict(map(tuple, bpe.decode_ids(spark.createDataFrame(odd, "doc_id int, ids binary")).collect()))
    assert back == {1: None, 2: "", 3: "a", 4: "�"}


def test_long_words_take_the_same_parts():
    words, rng = bpe.vocabulary(A), random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice(["a", "in", "the", "ing", "ß", "=", "0"]) for _ in range(rng.randint(1, 9))).encode()[: bpe.WIDTHS[-1]]
        ids, sizes = words.encode_short([word, b"x"], bpe.WIDTHS[-1])
        assert ids[: sizes[0]].tolist() == words.encode_long(word).tolist()


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    own, encoder = Tokenizer.from_file(public_tokenizers.path(A)), bpe.Encoder(bpe.vocabulary(A))
    for text in random_texts(4, 60):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def aligned_by_hand(texts):
    """What op11 is to return, and the counts of pairs."""
    own = Tokenizer.from_file(public_tokenizers.path(A))
    own.encode_special_tokens = True
    model, a_bytes = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B)), bpe.vocabulary(A).bytes
    b_bytes = [bytes.fromhex(p[3:5]) if model.is_byte(k) else p.replace("▁", " ").encode() for k in range(model.get_piece_size()) for p in [model.id_to_piece(k)]]
    found = []
    for text in texts:
        a, b = (own.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        if not text or b"".join(a_bytes[i] for i in a) != f" {text}".encode() or b"".join(b_bytes[i] for i in b) != f" {text}".encode():
            found.append(([], [], []))
            continue
        a_ends, b_ends = (list(itertools.accumulate(len(table[i]) for i in ids)) for ids, table in ((a, a_bytes), (b, b_bytes)))
        groups, start = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if start < e <= end] for ids, ends in ((a, a_ends), (b, b_ends))))
            start = end
        found.append((a, b, groups))
    links = [[p for g in groups for p in itertools.product(*g)] for _, _, groups in found]
    counts = Counter(p for own_links in links for p in set(own_links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    rows = []
    for k, (a, b, groups) in enumerate(found):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((k, len(a), len(b), len(groups), len(links[k]), sum(counts[p] == best[p[0]] for p in links[k]), sum(counts[p] for p in links[k]), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return rows


def short(texts):
    """Without the texts whose brute force takes long."""
    return [t for t in texts if len(t or "") <= 10_000]


def test_op11(spark, folder, texts):
    got = sorted(map(tuple, registry.QUERIES["op11_alignment"](spark, f"{folder}/full").collect()))
    assert [r[0] for r in got] == list(range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(short(texts))), "doc_id long, text string").repartition(3)
    want = aligned_by_hand(short(texts))
    assert sorted(map(tuple, alignment.align(docs).collect())) == want
    # what doesn't hang on other documents is the same in the whole table
    places = [k for k, t in enumerate(texts) if len(t or "") <= 10_000]
    assert [(*got[k][1:5], got[k][7]) for k in places] == [(*r[1:5], r[7]) for r in want]


@pytest.mark.parametrize(("most", "wide", "few"), [(50, 1 << 20, 1), (50, 2, 32), (0, 0, 0)])
def test_op11_rare_pairs_wide_groups_and_long_segments(spark, monkeypatch, most, wide, few):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "SHORT", few)
    some = [*AWKWARD[:6], *random_texts(6, 60), "the end of the words " * 30]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(docs, most=most).collect())) == aligned_by_hand(some)


def test_segments_have_the_tokens_of_the_whole(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 50)
    own = Tokenizer.from_file(public_tokenizers.path(A))
    own.encode_special_tokens = True
    found = alignment.Segments(A, B)
    for text in [*random_texts(7, 150), "a   b     c " * 5, " " * 40, "x" * 60, "one\n  two\n three \n", "tail "]:
        parts = alignment.segments(text)
        assert "".join(parts) == f" {text}"
        tokens = [found.tokens([x])[0] for x in parts]
        whole = found.b.model.encode(text)
        if text and all(tokens):
            a, b = ([k for t in tokens for k in np.frombuffer(t[side], "<i4").reshape(-1, 2)[:, 0].tolist()] for side in (0, 1))
            assert (a, b) == (own.encode(f" {text}", add_special_tokens=False).ids, whole), text
        else:
            assert not text or b"".join(found.b.bytes[k] for k in whole) != f" {text}".encode(), text


def test_swaps_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == 1 + sum(1 for _ in audit.swaps(n))


def test_op12_against_its_sql(spark, folder):
    con = duckdb.connect()
    for kind in ("full", "empty"):
        for table in ("documents", "labels"):
            con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{kind}/{table}.parquet/*.parquet'")
        found = registry.QUERIES["op12_filter_audit"](spark, f"{folder}/{kind}")
        want = con.sql(registry.ORACLES["op12_filter_audit"])
        assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


def test_op12_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = spark.createDataFrame([(None, long), (None, long), (7, long), (7, long), (9, long), (None, None), (3, ""), (4, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(9, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: tuple(r)[2:] for r in audit.failure_cube(docs, labels).collect()}
    assert cells == {0: (4, 0, 0), 16: (1, 1, 1), 1: (2, 0, 0), 17: (1, 0, 0)}
    (row,) = [r for r in audit.audit(audit.failure_cube(docs, labels)).collect() if (r["filter_order"], r["step"]) == ("EABCD", 1)]
    assert (row["part"], row["kept"], row["removed"], row["unique_fails"], row["good_lost"], row["toxic_lost"]) == ("", 6, 2, 1, 1, 1)


@pytest.mark.parametrize("name", ["op11_alignment", "op13_bpe"])
def test_empty_tables(spark, folder, name):
    assert registry.QUERIES[name](spark, f"{folder}/empty").collect() == []


def test_op11_known_segments_are_cut_once_and_change_no_result(spark, monkeypatch):
    """Segments that a sample shows to be frequent aren't sent slice by slice; rare, awkward and differing ones still are."""
    monkeypatch.setattr(alignment, "SAMPLE", 1)
    some = [*AWKWARD[:6], *random_texts(8, 40), *["the end of the words, ever the same ones\n"] * 4, "the ▁ end of the words"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    known = alignment.known_segments(docs, A, B, "text")
    held = [x["segment"] for x in known.first()["known"]]
    assert " the" in held and " words," in held and held == sorted(held)
    slices = alignment.tokenised(docs.where("doc_id >= 46 AND doc_id < 50"), held, A, B, "doc_id", "text").collect()
    assert slices and not any(r["words"] for r in slices) and all(d["segments"] and d["known"] for r in slices for d in r["docs"])
    assert sorted(map(tuple, alignment.align(docs).collect())) == aligned_by_hand(some)
