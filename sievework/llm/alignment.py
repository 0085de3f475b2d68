"""Alignment of two tokenizers' tokens by the bytes that they cover.

Python tokenises: a slice of documents becomes a row with the tokens of its distinct segments, their ids and the bytes at
which they end, and with each document's segments by number. Segments are cut where both tokenizers begin anew whatever
follows, before a space after a sign. All else are higher-order functions: ends that both tokenizers have cut a segment into
groups, all tokens of a group are linked with one another, and a document's groups and links are those of its segments.
Segments that a sample shows to be frequent are cut into groups once, in a table of bounded size; the others slice by slice.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import bpe, common
from sievework.llm.tokens import MARK, model_path

#: Segments and words that are cached at once, characters of a cached one, and characters of a slice of documents.
CACHE_ENTRIES, WORD_ENTRIES, ENTRY_CHARS, SLICE_CHARS = 1 << 18, 1 << 16, 48, 1 << 19
#: Segments that are known beforehand, the most frequent ones of one document in SAMPLE: so many, seen so often at least.
KNOWN_SEGMENTS, KNOWN_SEEN, SAMPLE = 1 << 16, 3, 16
#: Pairs of ids whose counts are broadcast, the most frequent ones; all others are joined by a shuffle.
FREQUENT_PAIRS = 1 << 18
#: A pair of ids as one number: the first one's id times this, and the second one's.
PAIR = 1 << 32
#: A space after white space, and where segments are cut if there is one.
SPACED, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
#: Ends are sought one by one in so short a segment; groups of more links than this don't have them in an array.
SHORT, WIDE = 32, 1 << 20


def packed(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """Ids and sizes in bytes, side by side."""
    return np.stack([ids, sizes[ids]], axis=1).astype("<i4").tobytes()


class Pieces:
    """Texts to packed pieces of a sentencepiece model that puts a space before each."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path(name))
        count, byte = self.model.get_piece_size(), re.compile(r"<0x([0-9A-F]{2})>")
        pieces = [self.model.id_to_piece(k) for k in range(count)]
        self.bytes = [bytes.fromhex(byte.fullmatch(p)[1]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes])
        self.space = self.model.piece_to_id(MARK)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed pieces of each text, a lone space for none; empty where their bytes aren't those of a space and the text."""
        found = [ids or [self.space] for ids in self.model.encode(texts, num_threads=1)] if texts else []
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32)
        every, ends = packed(flat, self.sizes), list(itertools.accumulate(8 * len(ids) for ids in found))
        out = [every[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        got, told = b"".join(map(self.bytes.__getitem__, flat.tolist())), [b" " + t.encode() for t in texts]
        if got == b"".join(told) and not any(MARK in t for t in texts):
            return out
        same = [b"".join(map(self.bytes.__getitem__, ids)) == t for ids, t in zip(found, told, strict=True)]
        return [o if s else b"" for o, s in zip(out, same, strict=True)]


def segments(text: str) -> list[str]:
    """A space and the text, cut before each space that follows anything but white space."""
    text = f" {text}"
    return CUT.split(text) if SPACED.search(text) else [f" {part}" for part in text[1:].split(" ")]


class Segments:
    """Segments to their tokens of both kinds, packed, behind a bounded cache; None where the bytes differ."""

    def __init__(self, a_name: str, b_name: str):
        words = bpe.vocabulary(a_name)
        sizes = np.array([len(b) for b in words.bytes])
        self.a, self.b = bpe.Encoder(words, lambda ids: packed(ids, sizes), WORD_ENTRIES), Pieces(b_name)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}

    def tokens(self, distinct: list[str]) -> list[tuple[bytes, bytes] | None]:
        missing = [x for x in distinct if x not in self.cache]
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache, missing = {}, distinct
        pieces = self.b.encode([x[1:] for x in missing])
        self.cache.update((x, (a, b) if b else None) for x, a, b in zip(missing, self.a.encode(missing, specials=False), pieces, strict=True))
        found = [self.cache[x] for x in distinct]
        for x in [x for x in missing if len(x) > ENTRY_CHARS]:
            del self.cache[x]
        return found


def lists(packs: list[bytes]) -> list[pa.Array]:
    """Lists of ids and of ends, from packed ids and sizes."""
    flat = np.frombuffer(b"".join(packs), "<i4").reshape(-1, 2)
    offsets = np.concatenate([[0], np.cumsum([len(p) // 8 for p in packs], dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(flat[:, 1])])
    starts = np.repeat(ends[offsets[:-1]], np.diff(offsets))
    at = pa.array(offsets, pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (flat[:, 0], ends[1:] - starts)]


_held: dict[tuple[str, str], Segments] = {}


def held_segments(a_name: str, b_name: str) -> Segments:
    """Both tokenizers and their cache, made once in each worker."""
    if (a_name, b_name) not in _held:
        _held[a_name, b_name] = Segments(a_name, b_name)
    return _held[a_name, b_name]


def word_arrays(found: list[tuple[bytes, bytes]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([*lists([f[0] for f in found]), *lists([f[1] for f in found])], names=["a_ids", "a_ends", "b_ids", "b_ends"])


WORD = "struct<a_ids:array<int>,a_ends:array<int>,b_ids:array<int>,b_ends:array<int>>"


def known_segments(docs: DataFrame, a_name: str, b_name: str, text_col: str) -> DataFrame:
    """One row with `known`: segment, n_a, n_b, links and text of the frequent segments of a sample, in a fixed order.

    None of these has a wide group, and all have the same bytes on both sides. Which ones are known changes no result.
    """
    longest = min(ENTRY_CHARS, int(WIDE**0.5))

    def cut(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = [x for x in segments(text) if len(x) <= longest and len(x.encode()) <= longest] if text else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["segment"])

    def tokens(batches):
        for batch in batches:
            found = held_segments(a_name, b_name).tokens(batch.column(0).to_pylist())
            some = [k for k, f in enumerate(found) if f is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), word_arrays([found[k] for k in some])], names=["segment", "w"])

    sample = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(SAMPLE)) == 0)
    seen = sample.mapInArrow(cut, "segment string").groupBy("segment").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_SEEN)
    words = seen.orderBy(F.desc("n"), "segment").limit(KNOWN_SEGMENTS).select("segment").mapInArrow(tokens, f"segment string, w {WORD}")
    grouped = common.checkpointed(words.select("segment", F.size("w.a_ids").alias("n_a"), F.size("w.b_ids").alias("n_b"), groups_of(F.col("w")).alias("groups")))
    told = F.struct("segment", "n_a", "n_b", links_of(F.col("groups")).alias("links"), text_of(F.col("groups")).alias("text"))
    return common.checkpointed(grouped.agg(F.array_sort(F.collect_list(told)).alias("known")))


class Places(dict):
    """Segments to places: of known ones, and of others, in `new`, those behind them as they come."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self.new.append(segment)
        self[segment] = place = len(self)
        return place


def parted(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n owners, who stand in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))


def tokenised(docs: DataFrame, known: list[str], a_name: str, b_name: str, id_col: str, text_col: str) -> DataFrame:
    """words and docs: a row for a slice of documents. words: a_ids, a_ends, b_ids and b_ends of its distinct segments that
    aren't known; docs: id, n_a and n_b (of those), segments (places in known and, behind them, in words) of its documents,
    rest (places in words), known (each once) and times (how often)."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    told_known = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        at = {x: k for k, x in enumerate(told_known.value)}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in common.slices(texts, SLICE_CHARS):
                n, place = end - start, Places(at)
                cut = [segments(t) if t else [] for t in texts[start:end]]
                owner = np.repeat(np.arange(n), [len(c) for c in cut])
                flat = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(cut)), np.int64, len(owner))
                found = held_segments(a_name, b_name).tokens(place.new)
                differ = np.array([False] * len(at) + [f is None for f in found])
                if differ.any():
                    same = ~np.isin(owner, owner[differ[flat]])
                    owner, flat = owner[same], flat[same]
                found = [f or (b"", b"") for f in found]
                sizes = np.array([(len(a) // 8, len(b) // 8) for a, b in found], np.int64).reshape(-1, 2)
                new = flat >= len(at)
                rest, of_rest = flat[new] - len(at), owner[new]
                counts = [pa.array(np.bincount(of_rest, sizes[rest, k], n).astype(np.int64)) for k in range(2)]
                once, times = np.unique(owner[~new] * max(len(at), 1) + flat[~new], return_counts=True)
                of_once, once = np.divmod(once, max(len(at), 1))
                told = pa.StructArray.from_arrays(
                    [batch.column(0).slice(start, n), *counts, parted(owner, flat, n), parted(of_rest, rest, n), parted(of_once, once, n), parted(of_once, times, n)],
                    names=["id", "n_a", "n_b", "segments", "rest", "known", "times"],
                )
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (word_arrays(found), told)], names=["words", "docs"])

    lists_of = ",".join(f"{c}:array<int>" for c in ("segments", "rest", "known", "times"))
    return frame.mapInArrow(run, f"words array<{WORD}>, docs array<struct<id:{kind},n_a:bigint,n_b:bigint,{lists_of}>>")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cover(ends: Column) -> Column:
    """For each byte the place, from 0, of the token that covers it; null for a short segment."""
    every = F.flatten(F.transform(ends, lambda e, k: F.array_repeat(k, e - F.coalesce(F.get(ends, k - 1), F.lit(0)))))
    return F.when(F.size(ends) > SHORT, every)


def groups_of(w: Column) -> Column:
    """The groups of a segment: the ids of both sides (a, b) between two neighbouring bytes at which tokens of both end."""

    def tokens_up_to(cut: Column, ends: str, at: str) -> Callable[[Column], Column]:
        return lambda end: F.when(cut[at].isNull(), F.array_position(w[ends], end)).otherwise(F.get(cut[at], end - 1) + 1).cast("int")

    def places(cut: Column) -> Column:
        return F.transform(cut["ends"], lambda end: F.struct(tokens_up_to(cut, "a_ends", "a")(end).alias("a"), tokens_up_to(cut, "b_ends", "b")(end).alias("b")))

    def part(ids: Column, up_to: Column, side: str, k: Column) -> Column:
        start = F.coalesce(F.get(up_to, k - 1)[side], F.lit(0))
        return F.slice(ids, start + 1, F.get(up_to, k)[side] - start)

    def between(up_to: Column) -> Column:
        return F.transform(up_to, lambda p, k: F.struct(part(w["a_ids"], up_to, "a", k).alias("a"), part(w["b_ids"], up_to, "b", k).alias("b")))

    def cut_at(ends: Column) -> Column:
        cut = F.struct(ends.alias("ends"), cover(w["a_ends"]).alias("a"), cover(w["b_ends"]).alias("b"))
        alike = F.transform(ends, lambda _, k: F.struct(F.array(F.get(w["a_ids"], k)).alias("a"), F.array(F.get(w["b_ids"], k)).alias("b")))
        each_alone = (F.size(w["a_ids"]) == F.size(ends)) & (F.size(w["b_ids"]) == F.size(ends))
        return F.when(F.size(ends) == 1, whole).when(each_alone, alike).otherwise(named(named(cut, places), between))

    whole = F.array(F.struct(w["a_ids"].alias("a"), w["b_ids"].alias("b")))
    return F.when((F.size(w["a_ids"]) == 1) | (F.size(w["b_ids"]) == 1), whole).otherwise(named(F.array_intersect(w["a_ends"], w["b_ends"]), cut_at))


def n_pairs(g: Column) -> Column:
    return F.size(g["a"]).cast("long") * F.size(g["b"])


def links_of(groups: Column) -> Column:
    """All pairs of a token of a and one of b in a group, group by group, as numbers; without wide groups."""

    def pairs(g: Column) -> Column:
        first = lambda side: F.get(g[side], F.lit(0))
        one_a = F.transform(g["b"], lambda b: first("a").cast("long") * PAIR + b)
        one_b = F.transform(g["a"], lambda a: a.cast("long") * PAIR + first("b"))
        many = F.flatten(F.transform(g["a"], lambda a: F.transform(g["b"], lambda b: a.cast("long") * PAIR + b)))
        return F.when(n_pairs(g) > WIDE, F.array().cast("array<bigint>")).when(F.size(g["a"]) == 1, one_a).when(F.size(g["b"]) == 1, one_b).otherwise(many)

    return F.when(F.size(groups) == 1, pairs(F.get(groups, F.lit(0)))).otherwise(F.flatten(F.transform(groups, pairs)))


def text_of(groups: Column) -> Column:
    """Groups as `a1,a2|b1;a3|b2,b3`."""

    def listed(ids: Column) -> Column:
        return F.when(F.size(ids) == 1, F.get(ids, F.lit(0)).cast("string")).otherwise(F.array_join(ids.cast("array<string>"), ","))

    def text(g: Column) -> Column:
        return F.concat(listed(g["a"]), F.lit("|"), listed(g["b"]))

    return F.when(F.size(groups) == 1, text(F.get(groups, F.lit(0)))).otherwise(F.array_join(F.transform(groups, text), ";"))


def wide_of(groups: Column) -> Column:
    """The wide groups of each segment; null where no segment has any."""
    some = F.exists(groups, lambda own: F.exists(own, lambda g: n_pairs(g) > WIDE))
    return F.when(some, F.transform(groups, lambda own: F.filter(own, lambda g: n_pairs(g) > WIDE)))


def aligned(docs: DataFrame, known: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, groups (ids as `a1,a2|b1;a3|b2,b3`), pairs (of ids as numbers, each once), known and times of each text: places in
    known_segments() and how often the text has them; n_a, n_b, links (pairs) and wide of the rest.

    A takes a space and the text, B the text, before which it puts a space itself; strings of special tokens are plain
    text. A null or an empty text has no tokens, and so has one whose tokens' bytes differ between the two: nothing of it
    is linked. Groups of a great many links aren't in links or pairs but stand in wide, as they are. Repeated rows are
    aligned each; a table without rows gives none. Texts of any length are aligned whole, each by one task; other columns
    are ignored, whatever their names.
    """
    held = known.select(F.col("known.segment")).first()[0]  # KNOWN_SEGMENTS at most
    slices = tokenised(docs, held, a_name, b_name, id_col, text_col)
    grouped = slices.select("docs", F.explode(F.array(F.transform("words", groups_of))).alias("groups"))  # explode: worked out once, before it is used
    told = F.struct(F.transform("groups", links_of).alias("links"), F.transform("groups", text_of).alias("text"), wide_of(F.col("groups")).alias("wide"))
    by_word = grouped.select("docs", F.explode(F.array(told)).alias("w"))
    by_word = by_word.select("docs", F.col("w.links").alias("links"), F.col("w.text").alias("text"), F.col("w.wide").alias("wide"))
    # a row for each slice: each gets the known ones beside its own
    by_word = by_word.crossJoin(F.broadcast(known.select(F.col("known.links").alias("known_links"), F.col("known.text").alias("known_text"))))

    def of(places: Column, values: Column) -> Column:
        return F.transform(places, lambda k: F.get(values, k))

    def documents(links: Column, known_links: Column, text: Column) -> Column:
        def document(d: Column) -> Column:
            wide = F.when(F.col("wide").isNotNull(), F.flatten(of(d["rest"], F.col("wide")))).otherwise(F.array().cast("array<struct<a:array<int>,b:array<int>>>"))
            pairs = F.array_distinct(F.flatten(F.concat(of(d["known"], known_links), of(d["rest"], links))))
            return F.struct(d["id"].alias("id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), d["known"].alias("known"), d["times"].alias("times"), F.array_join(of(d["segments"], text), ";").alias("groups"), F.flatten(of(d["rest"], links)).alias("links"), pairs.alias("pairs"), wide.alias("wide"))

        return F.transform("docs", document)

    found = named(F.col("links"), lambda x: named(F.col("known_links"), lambda y: named(F.concat("known_text", "text"), lambda z: documents(x, y, z))))
    return by_word.select(F.explode(found).alias("d")).select(F.col("d.id").alias(id_col), *[f"d.{c}" for c in ("n_a", "n_b", "known", "times", "groups", "links", "pairs", "wide")])


#: Steps of the logarithm in which pairs are counted by their frequency.
STEPS = 8


def linked(rows: DataFrame, distinct: bool) -> DataFrame:
    """__row, pair and n of the aligned rows' links outside known segments; distinct: each pair of a document once, known ones too.

    Links of most documents are one array; wide groups' links are made token by token, so that no task holds them at once.
    """
    few, many, held = rows.where("NOT is_wide"), rows.where("is_wide"), "pairs" if distinct else "links"
    short = few.select("__row", F.explode(held).alias("pair"), F.lit(1).cast("long").alias("n"))
    wide = many.select("__row", F.explode("wide").alias("g")).select("__row", F.explode("g.a").alias("a"), F.col("g.b").alias("bs"))
    wide = wide.select("__row", (F.col("a").cast("long") * PAIR).alias("a"), F.explode("bs").alias("b")).select("__row", (F.col("a") + F.col("b")).alias("pair"))
    both = wide.unionByName(many.select("__row", F.explode(held).alias("pair")))
    return short.unionByName(both.groupBy("__row", "pair").agg(F.count("*").alias("n")))


def counted(rows: DataFrame) -> DataFrame:
    """pair, docs and best: how many aligned rows hold each pair, and whether that is the most of its first id.

    The most of each first id are a row for each entry of a vocabulary, which bounds what is broadcast.
    """
    counts, folder = common.stored(linked(rows, distinct=True).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    first = F.expr(f"pair div {PAIR}").alias("first")
    most = counts.groupBy(first).agg(F.max("docs").alias("most"))
    marked = counts.select("pair", "docs", first).join(F.broadcast(most), "first")
    out = common.checkpointed(marked.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    common.delete_folder(rows.sparkSession, folder)
    return out


def frequent(pairs: DataFrame, most: int = FREQUENT_PAIRS) -> DataFrame:
    """The pairs with the largest counts, down to a count at which there are no more than most of them."""
    level = F.floor(F.log2("docs") * STEPS).cast("int")
    sizes = pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # a row for each step of the logarithm
    least, held = 1 << 30, 0
    for r in sorted(sizes, reverse=True):
        held += r["n"]
        if held > most:
            break
        least = r["level"]
    return pairs.where(level >= least)


def align(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text; see aligned.

    A link is a pair of tokens in one group. The count of its pair of ids is the number of rows of docs that hold it
    linked; n_best counts links of which no other pair of the same first id has a larger count, and count_sum adds their
    counts. groups_sha256 is that of the groups' text. Texts without tokens have zeros and an empty digest. Repeated rows
    are documents of their own, ties all count as best.

    Frequent pairs meet most links, and so are looked up in a broadcast table of bounded size; only links of the others
    are dealt out by pair, after a sum over each document.
    """
    spark = docs.sparkSession
    none = F.col("groups") == ""
    known = known_segments(docs, a_name, b_name, text_col)
    told = aligned(docs, known, a_name, b_name, id_col, text_col).select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).alias("__id"),
        "n_a",
        "n_b",
        F.when(none, 0).otherwise(F.octet_length("groups") - F.octet_length(F.replace("groups", F.lit(";"), F.lit(""))) + 1).cast("long").alias("n_groups"),
        (F.size("links") + F.aggregate("wide", F.lit(0).cast("long"), lambda s, g: s + n_pairs(g))).cast("long").alias("n_links"),
        F.when(none, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"),
        (F.size("wide") > 0).alias("is_wide"),
        "known",
        "times",
        "links",
        "pairs",
        "wide",
    )
    folder = f"{common.shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    told.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)  # the result reads it
    pairs = counted(rows)
    top = F.broadcast(frequent(pairs, most))
    found = linked(rows, distinct=False).join(top, "pair", "left")
    rare = F.when(F.col("docs").isNull(), F.col("pair"))
    sums, folder = common.stored(found.groupBy("__row", rare.alias("rare")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best")), "link-sums")
    late = sums.where("rare IS NOT NULL").select("__row", "n", F.col("rare").alias("pair")).join(pairs, "pair")
    late = late.select("__row", (F.col("n") * F.col("docs")).alias("count_sum"), F.when(F.col("best"), F.col("n")).alias("n_best"))
    both = sums.where("rare IS NULL").select("__row", "count_sum", "n_best").unionByName(late).unionByName(of_known(rows, known, pairs), allowMissingColumns=True)
    names = ("n_a", "n_b", "n_links", "n_best", "count_sum")
    total = both.groupBy("__row").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"__{c}") for c in names])
    done = common.checkpointed(total)
    common.delete_folder(spark, folder)
    value = {c: F.coalesce(f"__{c}", F.lit(0).cast("long")) for c in names}
    return rows.join(done, "__row", "left").select(F.col("__id").alias(id_col), *[(F.col(c) + value[c]).alias(c) for c in ("n_a", "n_b")], "n_groups", (F.col("n_links") + value["n_links"]).alias("n_links"), *[value[c].alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def of_known(rows: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """__row, n_a, n_b, n_links, n_best and count_sum of what the aligned rows have of known segments, worked out once for each."""
    each = known.select(F.posexplode("known").alias("k", "x")).select("k", "x.n_a", "x.n_b", "x.links")
    links = each.select("k", F.explode("links").alias("pair"))
    sums = pairs.join(F.broadcast(links), "pair").groupBy("k").agg(F.sum("docs").alias("count_sum"), F.count_if("best").alias("n_best"))
    one = common.checkpointed(each.select("k", "n_a", "n_b", F.size("links").alias("n_links")).join(sums, "k", "left"))
    held = rows.select("__row", F.explode(F.arrays_zip("known", "times")).alias("x")).select("__row", F.col("x.known").alias("k"), F.col("x.times").alias("times"))
    return held.join(F.broadcast(one), "k").groupBy("__row").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")])


def op11_alignment(spark, sf_dir):
    return align(common.read(spark, sf_dir, "documents"))
