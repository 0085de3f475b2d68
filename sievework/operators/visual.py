"""Perceptual hashes, near-duplicate pairs, leader clusters, components between classes, and policies."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.iteration import BEFORE_ALL, SMALL_GRAPH, checkpointed, leaders_of, roots_of, stored_by

#: Raster side, block of low frequencies, most differing bits, largest mean difference of bytes.
SIDE, LOW = 32, 8
MAX_BITS = 6
MAX_MEAN = 18.0
BITS = LOW * LOW - 1
#: Stretches of pixels whose sums are compared before the pixels.
BLOCKS = 16
#: Hashes compared block by block: rows of a block, blocks of a table of a few thousand, pairs of an Arrow batch, and
#: comparisons in the time of one row of a join.
BLOCK_ROWS, LEAST_BLOCKS, PAIRS_OUT, PAIRS_A_ROW = 1 << 15, 8, 1 << 16, 32


def bits_over_median(coefficients: Column) -> Column:
    """A 63-bit number: a bit for each coefficient but the first, the first of them highest, set where it is over their median."""
    rest = F.slice(coefficients, 2, BITS)
    middle = F.element_at(F.sort_array(rest), BITS // 2 + 1)
    return F.aggregate(F.transform(rest, lambda x: (x > middle).cast("long")), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def dct_hash(rasters: DataFrame, pixels: str = "pixels") -> DataFrame:
    """rasters with phash, from `pixels`: SIDE * SIDE grey bytes, row by row (null: null). Arrow batches, two matrix products.

    Coefficients are listed column frequency first, rounded to six decimals so that noise in the last places of equal
    values doesn't make bits.
    """

    @F.pandas_udf("long")
    def phash(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), np.int64)
        known = values.notna().to_numpy()
        if known.any():
            frequency, place = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
            waves = np.cos(np.pi * (place + 0.5) * frequency / SIDE)
            grey = np.frombuffer(b"".join(values[known]), np.uint8).reshape(-1, SIDE, SIDE).astype(float)
            low = (waves @ grey @ waves.T).transpose(0, 2, 1).reshape(-1, LOW * LOW)[:, 1:].round(6)
            flags = low > np.median(low, axis=1, keepdims=True)
            out[known] = (flags * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=1)
        return pd.Series(pd.arrays.IntegerArray(out, ~known))

    return rasters.withColumn("phash", phash(F.col(pixels)))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands_for(n: int, most: int, size: int = BITS) -> int:
    """How many bands are joined on at once, so that key rows and pairs met by chance are the fewest for n hashes.

    Of most + j bands at least j agree. n hashes make n * C(most + j, j) key rows; pairs meet by chance in a key of b bits
    with a probability of 2 ** -b. So keys grow to about log2(n) bits, as far as more of them don't cost more.
    """

    def cost(j: int) -> float:
        keys = math.comb(most + j, j)
        return n * keys + n * n / 2 * keys / 2.0 ** (size * j // (most + j))

    return min(range(1, 6), key=cost)


def radius_bands(bands: int, most: int, size: int = BITS) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of bands, one of which at least differs in no more than its radius if `most` bits differ in all.

    Were each band over its radius, the radii and one more for each band would differ; that makes `most` and one.
    """
    edges = [size * k // bands for k in range(bands + 1)]
    share, rest = divmod(most + 1, bands)
    widths = sorted(range(bands), key=lambda k: edges[k] - edges[k + 1])  # wide bands bear a larger radius
    radius = {k: share - 1 + (place < rest) for place, k in enumerate(widths)}
    return [(edges[k], edges[k + 1] - edges[k], radius[k]) for k in range(bands)]


def near_values(bits: int, radius: int) -> int:
    return sum(math.comb(bits, i) for i in range(radius + 1))


def radius_cost(plan: list[tuple[int, int, int]], n: int, m: int, alone: bool) -> tuple[float, float]:
    """Rows that probing makes (each of the smaller side, n, for each value within the radius), and pairs that meet by chance."""
    probes = sum(n * near_values(bits, radius) + m for _, bits, radius in plan)
    return probes, n * m / (1 + alone) * sum(near_values(bits, radius) / 2.0**bits for _, bits, radius in plan)


def best_radius_plan(n: int, m: int, most: int, size: int = BITS, alone: bool = False) -> list[tuple[int, int, int]]:
    """The bands that cost the fewest rows for sides of n and m hashes; probes of a row are held to about a million."""
    plans = [radius_bands(k, most, size) for k in range(1, min(most + 1, size) + 1)]
    plans = [p for p in plans if sum(near_values(bits, radius) for _, bits, radius in p) <= 1 << 20]
    return min(plans, key=lambda p: sum(radius_cost(p, n, m, alone)))


def met_by_radius(left: DataFrame, right: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(l, lh, r, rh, k): pairs that meet in band k, in which they differ in no more than its radius; left's values are probed."""
    spark = left.sparkSession
    flips = [(k, sum(1 << first + b for b in chosen)) for k, (first, bits, radius) in enumerate(plan) for i in range(radius + 1) for chosen in itertools.combinations(range(bits), i)]
    masks = [((1 << bits) - 1) << first for first, bits, _ in plan]

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        keys = F.transform(F.array(*map(F.lit, masks)), lambda m, k: F.struct(k.alias("k"), F.col("h").bitwiseAND(m).alias("key")))
        return rows.select(F.col("id").alias(name), F.col("h").alias(f"{name}h"), F.explode(keys).alias("b")).select(name, f"{name}h", "b.*")

    around = F.broadcast(spark.createDataFrame(flips, "k int, flip long"))  # of a size that the plan bounds
    probes = keyed(left, "l").join(around, "k").withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")
    return probes.join(keyed(right, "r"), ["k", "key"]).select("l", "lh", "r", "rh", "k")


def met_in_blocks(left: DataFrame, right: DataFrame | None, most: int, n: int, m: int) -> DataFrame:
    """(l, r): every pair compared in Arrow batches, a block of one side with a block of the other in each group.

    A row goes to as many groups as the other side has blocks. A group holds two blocks, and its pairs leave as they are
    found, so memory doesn't grow with the tables.
    """
    parts = lambda k: max(-(-k // BLOCK_ROWS), min(LEAST_BLOCKS, -(-k // 1024)), 1)
    of_left, of_right = parts(n), parts(m)
    dealt = lambda rows, k: rows.where("id IS NOT NULL AND h IS NOT NULL").select("id", "h", F.pmod(F.xxhash64("id", "h"), F.lit(k)).cast("int").alias("own"))
    others = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other")
    if right is None:
        sides = dealt(left, of_left).select("id", "h", "own", others(of_left))
        sides = sides.select((F.least("own", "other") * of_left + F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "h")
        pairs = of_left * (of_left + 1) // 2
    else:
        one = dealt(left, of_left).select("id", "h", "own", others(of_right)).select((F.col("own") * of_right + F.col("other")).alias("pair"), F.lit(0).alias("side"), "id", "h")
        two = dealt(right, of_right).select("id", "h", "own", others(of_left)).select((F.col("other") * of_right + F.col("own")).alias("pair"), F.lit(1).alias("side"), "id", "h")
        sides, pairs = one.unionByName(two), of_left * of_right
    alone = right is None

    def compared(pair, held):
        side, ids, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        ids_0, h_0, ids_1, h_1 = ids[side == 0], hashes[side == 0], ids[side == 1], hashes[side == 1]
        within = alone and pair // of_left == pair % of_left
        out, size = [], 0
        for k in range(len(ids_0)):
            others, other_h = (ids_0[k + 1 :], h_0[k + 1 :]) if within else (ids_1, h_1)
            near = others[np.flatnonzero(np.bitwise_count(other_h ^ h_0[k]) <= most)]
            if alone:
                near = near[near != ids_0[k]]
            if len(near):
                own = np.full(len(near), ids_0[k])
                out.append((np.minimum(own, near), np.maximum(own, near)) if alone else (own, near))
                size += len(near)
            if out and (size >= PAIRS_OUT or k + 1 == len(ids_0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["l", "r"])
                out, size = [], 0

    def run(batches):
        pair, held = None, []
        for batch in batches:
            key, side, ids = (batch.column(c).to_numpy() for c in range(3))
            hashes = batch.column(3).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if held and key[a] != pair:
                    yield from compared(pair, held)
                    held = []
                pair = int(key[a])
                held.append((side[a:b], ids[a:b], hashes[a:b]))
        if held:
            yield from compared(pair, held)

    tasks = min(pairs, 8 * left.sparkSession.sparkContext.defaultParallelism)
    return sides.repartition(tasks, "pair").sortWithinPartitions("pair").mapInArrow(run, "l long, r long")


def hamming_join(left: DataFrame, right: DataFrame | None, most: int, size: int = BITS, joint: int | None = None) -> DataFrame:
    """(l, r) for the pairs of ids whose hashes (id, h) differ in at most `most` bits; without right, those of left with l < r.

    Three kinds of plans compete by the rows that they make. Ids and hashes that are longs may be compared all with all, block
    by block in Arrow batches, where PAIRS_A_ROW comparisons take as long as a row of a join. Else either the hash is cut into `most` bands and some more, so that
    a pair agrees in as many as there are more (joint): an equi-join on combinations of bands. Or it is cut into few bands
    of which a pair is near in one, each with a radius of its own: the smaller side's rows are joined under all values
    within it. Spark can shuffle both and, where skewed, split them. A pair counts where it first meets, so that none
    comes twice. The former suits few bits, the latter many: at 18 of 63 bits it compares under a third of all pairs.
    """
    counts = (left.count(), left.count() if right is None else right.count()) if joint is None else (0, 0)
    if joint is None:
        n, m = min(counts), max(counts)
        plan, exact = best_radius_plan(n, m, most, size, right is None), bands_for(m, most, size)
        keys = math.comb(most + exact, exact)
        equal = (n + m) / (1 + (right is None)) * keys + n * m / (1 + (right is None)) * keys / 2.0 ** (size * exact // (most + exact))
        blocks = n * m / (1 + (right is None)) / PAIRS_A_ROW
        whole = all(side.schema[c].dataType.simpleString() == "bigint" for side in (left, right) if side is not None for c in ("id", "h"))
        if whole and blocks < min(equal, sum(radius_cost(plan, n, m, right is None))):
            return met_in_blocks(left, right, most, *counts)
        if sum(radius_cost(plan, n, m, right is None)) < equal:
            turned = right is not None and counts[1] < counts[0]
            met = met_by_radius(*((right, left) if turned else (left, left if right is None else right)), plan)
            differ = F.col("lh").bitwiseXOR(F.col("rh"))
            near = met.where((F.bit_count(differ) <= most) if right is not None else (F.col("l") < F.col("r")) & (F.bit_count(differ) <= most))
            first = F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(F.lit(((1 << bits) - 1) << at))) <= radius, F.lit(k)) for k, (at, bits, radius) in enumerate(plan)])
            return near.where(F.col("k") == first).select(*([F.col("r").alias("l"), F.col("l").alias("r")] if turned else ["l", "r"]))
        joint = exact
    bands = most + joint
    edges = [size * k // bands for k in range(bands + 1)]
    cuts = [F.lit(((1 << b - a) - 1) << a) for a, b in zip(edges, edges[1:], strict=False)]
    combos = list(itertools.combinations(range(bands), joint))
    masks = [sum(((1 << edges[p + 1] - edges[p]) - 1) << edges[p] for p in combo) for combo in combos]

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        keys = F.transform(F.array(*map(F.lit, masks)), lambda m, k: F.struct(k.alias("k"), F.col("h").bitwiseAND(m).alias("key")))
        return rows.select(F.col("id").alias(name), F.col("h").alias(f"{name}h"), F.explode(keys).alias("b")).select(name, f"{name}h", "b.*")

    pairs = keyed(left, "l").join(keyed(left if right is None else right, "r"), ["k", "key"])
    differ = F.col("lh").bitwiseXOR(F.col("rh"))
    near = pairs.where((F.bit_count(differ) <= most) if right is not None else (F.col("l") < F.col("r")) & (F.bit_count(differ) <= most))
    # the first combination in which a pair agrees is that of its first agreeing bands
    agree = F.filter(F.transform(F.array(*cuts), lambda m, p: F.when(differ.bitwiseAND(m) == 0, p)), lambda p: p.isNotNull())
    first = F.slice(agree, 1, joint)
    combo = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in combos]), F.col("k") + 1)
    return near.where(combo == first).select("l", "r")


def total_difference(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays of numbers of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of numbers of equal length."""
    return total_difference(a, b) / F.size(a)


def digest(pixels: Column) -> Column:
    """What equal pixels agree in, in 32 bytes."""
    return F.unhex(F.sha2(pixels, 256))


def block_sums(pixels: Column, blocks: int = BLOCKS) -> Column:
    """Sums of so many equal stretches of pixels' bytes; the last ones of bytes that don't share out evenly are shorter."""

    @F.pandas_udf("array<int>")
    def sums(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            bytes_ = np.frombuffer(v, np.uint8)
            starts = np.arange(0, len(bytes_), max(1, -(-len(bytes_) // blocks)))
            out.append(np.add.reduceat(bytes_, starts, dtype=np.int32) if len(bytes_) else np.zeros(0, np.int32))
        return pd.Series(out)

    return sums(pixels)


def near_by_sums(pairs: DataFrame, rows: DataFrame, most: float = MAX_MEAN) -> DataFrame:
    """The pairs (l, r) that rows' block sums (id, length, sums) don't tell apart: pixels differ by no less than their sums do."""
    left = rows.select(F.col("id").alias("l"), F.col("length").alias("ln"), F.col("sums").alias("ls"))
    right = rows.select(F.col("id").alias("r"), F.col("length").alias("rn"), F.col("sums").alias("rs"))
    least = total_difference(F.col("ls"), F.col("rs"))
    return pairs.join(left, "l").join(right, "r").where((F.col("ln") == F.col("rn")) & (least <= F.lit(most) * F.col("ln"))).select("l", "r")


def verified_pairs(pairs: DataFrame, rows: DataFrame, most: float = MAX_MEAN, fetched=None) -> DataFrame:
    """The pairs (l, r) whose pixels (id, pixels: binary) differ by at most `most` on average: the dear test, after the cheap one.

    Sums of a few blocks bound the difference from below, so that pixels are fetched only for pairs that these leave; they
    are compared in Arrow batches. Pixels of different lengths differ. fetched: an accumulator that counts pairs compared.
    """

    @F.pandas_udf("double")
    def difference(a: pd.Series, b: pd.Series) -> pd.Series:
        if fetched is not None:
            fetched.add(len(a))
        return pd.Series([np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).mean() if len(x) else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)

    held = rows.where(F.col("pixels").isNotNull())
    sums = checkpointed(held.select("id", F.octet_length("pixels").alias("length"), block_sums(F.col("pixels")).alias("sums")))
    left = checkpointed(near_by_sums(pairs, sums, most))
    ids = left.select(F.explode(F.array("l", "r")).alias("id")).distinct()
    wanted = held.select("id", "pixels").join(ids, "id", "left_semi")
    both = left.join(wanted.toDF("l", "lp"), "l").join(wanted.toDF("r", "rp"), "r")
    return both.where(difference("lp", "rp") <= most).select("l", "r")


def swept(left: DataFrame, n: int, block: int) -> DataFrame:
    """id of the followers among the nodes of n edges (a, b), a < b: blocks of ids, one after another.

    A block's inner edges are solved in one task, which is told which of its nodes follow a leader of an earlier block; so
    rounds are as many as blocks, whatever the chains. Blocks end where edges, by their later node, are shared out evenly.
    """
    spark = left.sparkSession
    blocks = max(1, -(-n // block))
    ends = sorted(set(left.agg(F.percentile_approx("b", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0])) if blocks > 1 else []
    where = lambda c: sum(((F.col(c) > e).cast("int") for e in ends), F.lit(0))
    dealt = stored_by(left.select("a", "b", where("a").alias("from"), where("b").alias("block")), "block", "swept")
    followers = spark.createDataFrame([], "id long")
    for k in range(len(ends) + 1):
        own = dealt.where(F.col("block") == k)
        known = own.where(F.col("from") < k).join(followers.withColumnRenamed("id", "a"), "a", "left_anti").select(F.lit(BEFORE_ALL).alias("a"), "b").distinct()
        inner = own.where(F.col("from") == k).select("a", "b").unionByName(known)
        followers = checkpointed(followers.unionByName(inner.coalesce(1).mapInArrow(leaders_of, "id long, leader long").select("id")))
    return followers


def leaders(nodes: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH, block: int = SMALL_GRAPH) -> DataFrame:
    """(id, leader): greedy clusters in the order of id, where each row joins the first leader it matches or else leads.

    The leaders are the lexicographically first maximal independent set, found in rounds: with every earlier neighbour
    decided and none a leader, a node leads; with a leader before it, it follows. Rounds keep only what is undecided:
    edges from leaders and followers are used up. A round that uses up less than a quarter of the edges tells of long
    chains; what is left is then swept block by block. A graph of a checked, small size is solved in one task instead.
    edges has (a, b) with a < b.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    n = edges.count()
    if n <= small:
        found = checkpointed(edges.coalesce(1).mapInArrow(leaders_of, "id long, leader long"))
        return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
    left, followers = edges, nodes.sparkSession.createDataFrame([], "id long")
    while n:
        # of the nodes with open edges, those without an open edge from before lead
        leading = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        found = checkpointed(left.join(leading.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct())
        followers = followers.unionByName(found)
        gone = found.unionByName(leading)
        left = checkpointed(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
        before, n = n, left.count()
        if n > 0.75 * before:
            followers, n = followers.unionByName(swept(left, n, block)), 0
    first = edges.join(followers.withColumnRenamed("id", "a"), "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    first = first.join(followers, "id", "left_semi")
    return nodes.select("id").join(first, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def cross_components(pairs: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(side, id, component) of a bipartite graph (p, n): components are named by their least p.

    Labels spread along the edges and jump to the label of the label, a checkpoint a round. A graph of a checked, small
    size is solved in one task instead.
    """
    pairs = checkpointed(pairs.select("p", "n").distinct())
    if pairs.count() <= small:
        # both sides' ids in one row of numbers: p as 2p, n as 2n + 1
        doubled = pairs.select((F.col("p") * 2).alias("u"), (F.col("n") * 2 + 1).alias("v"))
        roots = checkpointed(doubled.coalesce(1).mapInArrow(roots_of, "node long, root long"))
        nodes = doubled.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        least = nodes.groupBy("root").agg(F.min(F.when(F.col("node") % 2 == 0, F.shiftright("node", 1))).alias("component"))
        side = F.when(F.col("node") % 2 == 0, "P").otherwise("N")
        return nodes.join(least, "root").select(side.alias("side"), F.shiftright("node", 1).alias("id"), "component")
    labels = checkpointed(pairs.select(F.col("p").alias("id"), F.col("p").alias("label")).distinct())
    while True:
        of_n = pairs.join(labels, pairs["p"] == labels["id"]).groupBy("n").agg(F.min("label").alias("label"))
        of_p = pairs.join(of_n, "n").groupBy(F.col("p").alias("id")).agg(F.min("label").alias("label"))
        jumped = of_p.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.id")).select("x.id", F.least("x.label", "y.label").alias("label"))
        fresh = checkpointed(jumped)
        if fresh.join(labels, ["id", "label"], "left_anti").isEmpty():
            break
        labels = fresh
    of_n = pairs.join(labels, pairs["p"] == labels["id"]).groupBy("n").agg(F.min("label").alias("label"))
    return labels.select(F.lit("P").alias("side"), "id", F.col("label").alias("component")).unionByName(of_n.select(F.lit("N").alias("side"), F.col("n").alias("id"), F.col("label").alias("component")))


def resolve(members: DataFrame, choices: DataFrame, default: str | None = None) -> DataFrame:
    """members (side, id, component) with choice and action, by choices (component, choice): P, N or A name the sides to delete.

    Without a choice and a default the action is `unresolved`.
    """
    joined = members.join(choices, "component", "left").withColumn("choice", F.coalesce("choice", F.lit(default)))
    action = F.when(F.col("choice").isNull(), "unresolved").when((F.col("choice") == "A") | (F.col("choice") == F.col("side")), "delete").otherwise("keep")
    return joined.select("side", "id", "component", "choice", action.alias("action"))
