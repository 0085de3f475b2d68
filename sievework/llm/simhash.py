"""Near duplicates by SimHash, with pivot distance tables.

For each fingerprint the Hamming distances to many reference fingerprints (pivots) are tabled once. By the triangle
inequality, fingerprints that differ in at most r bits differ by at most r in every column of the table. Half of the
pivots are masks of two neighbouring bits: such a column, with that of the zero pivot, gives the number of ones among
the two bits. Two changed bits leave two of the four quarters of the mask columns as they are, so pairs need only be
sought among fingerprints that agree in two quarters; the largest difference over all columns then discards pairs, and
the survivors are verified.

similar_texts() is the wider form for texts of a given Jaccard similarity, whose fingerprints may differ in a third of
their bits: keys that are cut from fingerprints select nothing there. Candidates are texts that agree in a MinHash band;
a sketch that bounds the number of different shingles, the differences of the pivot tables' mask columns, added up, and
the exact distance of fingerprints then discard pairs, and what survives is verified on the shingles.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import common
from sievework.llm.components import by_rare_tokens, connected_components, link_groups, still_apart
from sievework.llm.passages import lowered, mix64, tokens

SEED, SHINGLE, RADIUS = 42, 3, 2
SHINGLES_AT_ONCE = 1 << 16
QUARTERS, MASKS_IN_QUARTER = 4, 8
#: Groups of more fingerprints than this aren't paired off, but searched through their neighbours at one bit.
LARGE_GROUP = 64

#: similar_texts(): least Jaccard similarity of five-word shingles, and the bits in which fingerprints of such texts may
#: differ. At 0.8 a bit differs with a probability of 0.151 (by the angle between the shingle sets): 27 of 64 or more do
#: with a probability of about 1e-7.
SIMILARITY, WIDE_RADIUS = 0.8, 26
#: A pair of similarity s agrees in no band with a probability of (1 - s ** ROWS) ** BANDS: 1.3e-7 at 0.8.
BANDS, ROWS = 40, 5
SALTS = mix64(np.arange(BANDS * ROWS, dtype=np.uint64), 7)
FACTORS = mix64(np.arange(BANDS * ROWS, dtype=np.uint64), 8) | np.uint64(1)
MINHASH_AT_ONCE = 1 << 12
#: Words of the parity sketch of a shingle set. Two sets differ in at least as many shingles as their sketches in bits.
SKETCH = 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spread(n: int) -> int:
    """SplitMix64's n-th output: a rule for arbitrary pivots."""
    z = (n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return z ^ z >> 31


MASKS = [3 << 2 * k for k in range(QUARTERS * MASKS_IN_QUARTER)]
PIVOTS = [0, *MASKS, *[spread(n) for n in range(31)]]


def fingerprint(text: str | None) -> int:
    """Unsigned; zero for a text without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(begins), SHINGLES_AT_ONCE):
        some = slice(k, k + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[some], ends[some], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and fp, the fingerprint as a signed 64-bit number."""
    return common.map_text(docs, id_col, text_col, lambda texts: [pa.array([signed(fingerprint(t)) for t in texts], pa.int64())], "fp long")


def pivot_table(fp: Column) -> Column:
    return F.transform(F.array(*[F.lit(signed(p)) for p in PIVOTS]), lambda p: F.bit_count(fp.bitwiseXOR(p)).cast("tinyint"))


def quarter(table: Column, q: int) -> Column:
    """The numbers of ones under a quarter's masks, from the table alone, packed in two bits each."""
    out = F.lit(0).cast("long")
    for k in range(MASKS_IN_QUARTER):
        ones = (table[0] + F.lit(2) - table[1 + q * MASKS_IN_QUARTER + k]) / 2
        out = out + F.shiftleft(ones.cast("long"), 2 * k)
    return out


def near_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (fp): within the radius, and connecting all that are within it."""
    tabled = fps.withColumn("d", pivot_table(F.col("fp"))).withColumns({f"q{q}": quarter(F.col("d"), q) for q in range(QUARTERS)})
    keys = [F.lit(k).cast("long") * (1 << 32) + F.col(f"q{p}") * (1 << 16) + F.col(f"q{q}") for k, (p, q) in enumerate(itertools.combinations(range(QUARTERS), 2))]
    keyed = tabled.select("fp", "d", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    grouped = keyed.join(sizes, "key")

    members = grouped.where(F.col("n") <= LARGE_GROUP).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "d"))).alias("m"))
    pairs = members.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: y["fp"] > F.col("x.fp"))).alias("y"))
    apart = F.array_max(F.zip_with("x.d", "y.d", lambda a, b: F.abs(a - b)))
    small = pairs.where(apart <= RADIUS).where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    # large groups: two fingerprints are within two bits if and only if some number is within one bit of both
    crowd = grouped.where(F.col("n") > LARGE_GROUP).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << k)) for k in range(64)])
    around = crowd.select("fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("z"))
    centres = around.groupBy("z").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("z", "least")
    large = around.join(centres, "z").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return small.unionByName(large).distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id: the least id of the documents reachable over links of at most two bits.

    Texts without words, empty and null ones have fingerprint zero and are linked as any other. Every row is kept,
    repeated ones too; null ids don't name a component that has another id.
    """
    prints = common.checkpointed(fingerprints(docs, id_col, text_col))
    firsts = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    links = connected_components(near_pairs(firsts.select("fp")))
    roots = firsts.join(links, firsts["fp"] == links["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of five-word shingles, sorted; of a text of fewer than five words all of it is one; none without words."""
    found = np.unique(tokens(text or ""))
    if len(found):
        return found
    words = lowered(text or "").split()
    return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)


def vote(found: np.ndarray) -> int:
    """The fingerprint of shingle hashes, signed: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), SHINGLES_AT_ONCE):
        ones += np.unpackbits(found[k : k + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each MinHash band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(0, len(found), MINHASH_AT_ONCE):
            mixed = (found[k : k + MINHASH_AT_ONCE] ^ SALTS[:, None]) * FACTORS[:, None]
            least = np.minimum(least, mixed.min(axis=1))
        keys = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ column, 9)
    return keys.view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH longs: bit k tells whether an odd number of the shingles falls on it."""
    odd = np.bincount((found & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct shingles; 1 for two texts without words."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def under_masks(fp: Column) -> Column:
    """The mask columns of the pivot table less the zero pivot's, that is, the ones under each mask, packed in unary: 00, 01 or 11."""
    low, shifted = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def least_apart(a: Column, b: Column) -> Column:
    """Bits in which fingerprints differ at least, by the mask columns: as masks don't overlap, their differences add up."""
    return F.bit_count(under_masks(a).bitwiseXOR(under_masks(b)))


def alike(pairs: DataFrame, bodies: DataFrame, least: float, radius: int) -> DataFrame:
    """The pairs (a, b) of ids, with fingerprint, number of shingles and sketch as a_place and b_place, whose texts are similar enough."""
    differ = sum((F.bit_count(F.col(f"a_place.b{k}").bitwiseXOR(F.col(f"b_place.b{k}"))) for k in range(SKETCH)), F.lit(0))
    both = F.col("a_place.n") + F.col("b_place.n")
    # of sets that differ in d of n shingles, counted on both sides, the similarity is (n - d) / (n + d)
    near = pairs.where(differ <= both * F.lit((1 - least) / (1 + least)) + F.lit(1e-6))
    # the pivot table's columns discard before the exact distance does; what they leave is verified by it
    one, other = F.col("a_place.fp"), F.col("b_place.fp")
    near = near.where(least_apart(one, other) <= radius).where(F.bit_count(one.bitwiseXOR(other)) <= radius).dropDuplicates(["a", "b"])

    def run(batches):
        for batch in batches:
            kept, held = [], (None, None)
            for k in range(batch.num_rows):
                b = batch.column(1)[k].as_py()
                if held[0] != b:
                    held = b, shingles(batch.column(3)[k].as_py())
                if jaccard(held[1], shingles(batch.column(2)[k].as_py())) >= least:
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in range(2)], names=["a", "b"])

    one, other = bodies.select(F.col("id").alias("a"), F.col("body").alias("a_body")), bodies.select(F.col("id").alias("b"), F.col("body").alias("b_body"))
    return near.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "a_body", "b_body").mapInArrow(run, "a long, b long")


def rare_groups(nodes: DataFrame, bodies: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """key, node, root and place of the rarest shingles of texts (node, root), of which similar texts share one."""

    def run(batches):
        for batch in batches:
            found = [shingles(x.as_py()).view(np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["node", "root", "tokens"])

    def prefix(ranks, _):
        return np.argsort(ranks)[: len(ranks) - int(np.ceil(least * len(ranks))) + 1]

    tokened = nodes.join(bodies.select(F.col("id").alias("node"), "body"), "node").select("node", "root", "body").mapInArrow(run, "node long, root long, tokens array<long>")
    return by_rare_tokens(common.checkpointed(tokened), prefix).join(places, "node").select("key", "node", "root", "place")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, radius: int = WIDE_RADIUS) -> DataFrame:
    """id and component_id: the least id of the documents reachable over pairs of texts of at least that similarity.

    Equal texts are linked whatever their length; texts without words, empty and null ones are one component. A row for
    each row of docs; rows with equal ids are one document; a row with a null id is alone, with a null component.
    Columns besides id and text are ignored.
    """
    named = docs.select(F.col(id_col).alias("__own"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    bits = [f"b{k}" for k in range(SKETCH)]
    schema = "fp long, n int, keys array<bigint>" + "".join(f", {b} long" for b in bits)

    def run(texts):
        found = [shingles(t) for t in texts]
        ends = np.arange(len(found) + 1, dtype=np.int32) * BANDS
        return [
            pa.array([vote(x) for x in found], pa.int64()),
            pa.array([len(x) for x in found], pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([bands(x) for x in found]))),
            *(pa.array(column) for column in np.stack([sketch(x) for x in found], axis=1)),
        ]

    folder = f"{common.shared_folder(docs.sparkSession)}/similar-{uuid.uuid4().hex}"
    hashed = named.select("__own", "id", "body", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("second"), "body").alias("h2"))
    common.map_text(hashed, "__own", "body", run, schema, ("id", "h1", "h2")).write.parquet(f"{folder}/signatures")
    signed_rows = docs.sparkSession.read.parquet(f"{folder}/signatures")
    wordless = F.col("n") == 0
    same = signed_rows.where(F.col("id").isNotNull()).groupBy(F.when(wordless, 0).otherwise(F.col("h1")).alias("g1"), F.when(wordless, 0).otherwise(F.col("h2")).alias("g2"), wordless.alias("g0")).agg(F.min(F.struct("id", "fp", "n", "keys", *bits)).alias("f"))
    same, _ = common.stored(same, "firsts")
    firsts = same.where("NOT g0").select("f.*")
    placed = firsts.select(F.col("id").alias("node"), F.explode("keys").alias("key"))
    places = firsts.select(F.col("id").alias("node"), F.struct("fp", "n", *bits).alias("place"))
    groups = placed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    members = common.checkpointed(placed.join(groups, "key").join(places, "node").select("key", "node", "place"))
    texts = named.where(F.col("id").isNotNull()).select("id", "body")
    nodes = members.select(F.col("node").alias("id")).distinct()
    common.only_ids(texts, "id", nodes).join(nodes, "id").dropDuplicates(["id"]).write.parquet(f"{folder}/bodies")
    bodies = docs.sparkSession.read.parquet(f"{folder}/bodies")
    links = link_groups(members, lambda roots: common.checkpointed(still_apart(members, roots)), lambda pairs: alike(pairs, bodies, least, radius), lambda nodes: rare_groups(nodes, bodies, places, least))
    roots = connected_components(links.select("a", "b"))
    common.delete_folder(docs.sparkSession, f"{folder}/bodies")
    classes = same.select("g1", "g2", "g0", F.col("f.id").alias("first")).join(roots, F.col("first") == F.col("node"), "left").select("g1", "g2", "g0", F.coalesce("root", "first").alias("root"))
    rows = signed_rows.select("__own", "id", F.when(wordless, 0).otherwise(F.col("h1")).alias("g1"), F.when(wordless, 0).otherwise(F.col("h2")).alias("g2"), wordless.alias("g0"))
    return rows.join(classes, ["g1", "g2", "g0"], "left").select(F.col("__own").alias(id_col), F.when(F.col("id").isNotNull(), F.col("root")).alias("component_id"))


def keep_first_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the documents that aren't the first of their component in classes (id, component_id); columns as before."""
    later = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__later")).distinct()
    return docs.join(later, docs[id_col] == later["__later"], "left_anti")


def op7_simhash(spark, sf_dir):
    found = cluster(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
