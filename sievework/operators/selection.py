"""Sampling, quotas, numbering and assignment."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import names
from sievework.operators.iteration import checkpointed

#: Seed, number of transformed samples, share of plain backgrounds and most uses of one.
SEED = 20260924
TRANSFORM_COUNT = 140
PLAIN_SHARE = 0.15
MAX_USES = 12


#: Groups are dealt to so many tasks before the first cut of a top-k.
SALTS = 64
ROW_BITS = 33


def number_within(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with `name`: 1, 2, ... in each group of `by` (none: over all rows) in the given order, of which ties are broken anyhow.

    A range sort by group and order, and each partition's offset: a group of any size spreads over many tasks, where a
    window would take it to one. The sorted rows are checkpointed, so that numbers and offsets are of the same sort.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    named = [f"__k{k}" for k in range(len(keys))]
    keyed = rows.select("*", *[k.alias(n) for k, n in zip(keys, named, strict=True)])
    dealt = keyed.repartitionByRange(*named).sortWithinPartitions(*named).drop(*named)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    held = checkpointed(dealt.withColumns({"__part": F.spark_partition_id(), "__at": at}))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))  # a row for each partition
    placed = held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset") + 1).drop("__at", "__offset")
    if not by:
        return placed.drop("__part")
    # a group's first number comes to its rows by partition and group, so that a large group's rows don't meet in one task
    own = [f"__g{k}" for k in range(len(by))]
    parts = placed.groupBy("__part", *[F.col(c).alias(g) for c, g in zip(by, own, strict=True)]).agg(F.min(name).alias("__least"))
    same = lambda left, right: reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in zip(own, [f"{g}r" for g in own], strict=True)])
    firsts = parts.groupBy(*[F.col(g).alias(f"{g}r") for g in own]).agg(F.min("__least").alias("__first"))
    told = parts.join(firsts, same(parts, firsts)).select(F.col("__part").alias("__of"), *own, "__first")
    here = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, own, strict=True)], F.col("__part") == F.col("__of"))
    return placed.join(told, here).withColumn(name, F.col(name) - F.col("__first") + 1).select(*rows.columns, name)


def top_by_hash(rows: DataFrame, quota: Column, by: list[str], key: Column, tie: list[str]) -> DataFrame:
    """In each group the rows with the smallest keys, as many as the quota says.

    A first rank in each group's salted parts cuts them down to the quota; what is left is numbered over the group.
    """
    salted = rows.withColumns({"__key": key, "__salt": F.pmod(F.xxhash64(key, *tie), F.lit(SALTS))})
    part = W.partitionBy(*by, "__salt").orderBy("__key", *tie)
    cut = salted.withColumn("__rank", F.row_number().over(part)).where(F.col("__rank") <= quota).drop("__rank", "__salt")
    ranked = number_within(cut, by, ["__key", *tie], "__rank")
    return ranked.where(F.col("__rank") <= quota).select(*rows.columns)


def largest_remainder(groups: DataFrame, total: int, name: str = "grp", size: str = "n") -> DataFrame:
    """groups with quota: shares of min(total, all) in proportion to size, leftovers by remainder, then folded name.

    The windows run over a row for each group.
    """
    every = W.partitionBy(F.lit(1))
    order = every.orderBy(F.desc("__rest"), F.lower(name), name)
    whole = F.sum(size).over(every)
    return (
        groups.withColumn("__all", whole)
        .withColumn("__take", F.least(F.lit(total).cast("long"), F.col("__all")))
        .withColumn("__base", F.expr(f"__take * {size} div __all"))
        .withColumn("__rest", F.expr(f"(__take * {size}) % __all"))
        .withColumn("__left", F.col("__take") - F.sum("__base").over(every))
        .withColumn("quota", F.col("__base") + (F.row_number().over(order) <= F.col("__left")).cast("long"))
        .drop("__all", "__take", "__base", "__rest", "__left")
    )


def stratified_sample(rows: DataFrame, total: int, seed: int = SEED, grp: str = "grp", path: str = "relpath", name: str = "name") -> DataFrame:
    """A sample of total rows with quotas by largest remainder, drawn in each group by seeded hashes of the paths."""
    quotas = largest_remainder(rows.groupBy(grp).agg(F.count("*").alias("n")), total, grp)
    joined = rows.join(quotas.select(F.col(grp).alias("__grp"), "quota"), F.col(grp) == F.col("__grp")).drop("__grp")
    return top_by_hash(joined, F.col("quota"), [grp], names.seeded_key(seed, F.col(path)), [name]).drop("quota")


def numbered(rows: DataFrame, excluded: DataFrame, grp: str = "grp", name: str = "name", path: str = "relpath") -> DataFrame:
    """rows not excluded, with their number in the group (from 1) and output file; excluded rows leave gaps."""
    out = number_within(rows, [grp], [F.lower(name), name], "number")
    return out.join(excluded.select(F.col("path").alias(path)), path, "left_anti").withColumn("output", F.format_string("%04d.jpg", "number"))


def plain_split(count: Column, plain: Column, textured: Column, share: float = PLAIN_SHARE, uses: int = MAX_USES) -> Column:
    """How many of count get plain backgrounds: the share (half to even), within what either kind can bear; null where both together can't."""
    wanted = F.bround(count * F.lit(share).cast("decimal(10,4)"), 0).cast("long")
    chosen = F.greatest(F.least(wanted, plain * uses), count - textured * uses)
    return F.when((chosen <= plain * uses) & (count - chosen <= textured * uses), chosen)


def round_robin(slots: DataFrame, backgrounds: DataFrame, seed: int = SEED, share: float = PLAIN_SHARE, uses: int = MAX_USES) -> DataFrame:
    """slots (slot: 1, 2, ...) joined to backgrounds (path, kind 'plain' or 'textured') in balanced, shuffled cycles.

    The slots with the smallest hashes get plain ones. In each kind, need number i takes the place i mod m of cycle
    i div m; each cycle has its own order by hash. So uses of two backgrounds of a kind differ by one at most. If the
    capacity doesn't suffice no slot gets a background: check plain_split() first.
    """
    sizes = backgrounds.groupBy().agg(F.count_if(F.col("kind") == "plain").alias("np"), F.count_if(F.col("kind") == "textured").alias("nt"))
    total = slots.groupBy().agg(F.count("*").alias("count"))
    plan = total.crossJoin(sizes).withColumn("plain", plain_split(F.col("count"), F.col("np"), F.col("nt"), share, uses))  # one row each
    key = names.seeded_key(seed, F.lit("slot"), F.col("slot").cast("string"))
    ranked = number_within(slots, [], [key, "slot"], "__rank").join(F.broadcast(plan), F.lit(True))
    kinds = ranked.withColumn("kind", F.when(F.col("__rank") <= F.col("plain"), "plain").when(F.col("plain").isNotNull(), "textured"))
    m = F.when(F.col("kind") == "plain", F.col("np")).otherwise(F.col("nt"))
    needs = number_within(kinds, ["kind"], ["slot"], "__need").withColumn("__i", F.col("__need") - 1)
    placed = needs.withColumn("cycle", F.floor(F.col("__i") / m).cast("long")).withColumn("place", F.pmod(F.col("__i"), m))
    cycles = placed.groupBy("kind").agg(F.max("cycle").alias("last")).where(F.col("kind").isNotNull())
    turns = cycles.select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("cycle"))
    drawn = names.seeded_key(seed, F.col("cycle").cast("string"), F.col("path"))
    dealt = number_within(backgrounds.join(F.broadcast(turns), "kind"), ["kind", "cycle"], [drawn, "path"], "__turn").withColumn("place", F.col("__turn") - 1)  # turns: a row for each use of a background
    return placed.join(dealt.select("kind", "cycle", "place", F.col("path").alias("background")), ["kind", "cycle", "place"]).select("slot", "kind", "cycle", "background")


def renumbered(files: DataFrame, grp: str = "grp", name: str = "name") -> DataFrame:
    """grp, name, target: names of the form grp_NNN stay; others take the smallest unused numbers of their group in name order.

    A used number has as many free ones before it as it is larger than its rank among the used. Files that wait, by their
    turn, and used numbers, by the free ones before them, are sorted into one row: a file's place there is its number.
    """
    matched = F.regexp_extract(names.stem(F.col(name)), r"_(\d{3,})$", 1)
    fits = (matched != "") & (names.stem(F.col(name)) == F.concat(F.col(grp), F.lit("_"), matched))
    rows = files.select(grp, name).withColumn("used", F.when(fits, matched.cast("long")))
    waiting = number_within(rows.where(F.col("used").isNull()), [grp], [F.lower(name), name], "turn")
    taken = number_within(rows.where(F.col("used") > 0).select(grp, "used").distinct(), [grp], ["used"], "rank")
    both = waiting.select(grp, name, "turn", F.lit(0).alias("kind")).unionByName(taken.select(grp, F.lit(None).cast("string").alias(name), (F.col("used") - F.col("rank")).alias("turn"), F.lit(1).alias("kind")))
    placed = number_within(both, [grp], ["turn", "kind"], "number").where("kind = 0")
    target = F.concat(F.col(grp), F.lit("_"), F.lpad(F.col("number").cast("string"), F.greatest(F.length(F.col("number").cast("string")), F.lit(3)), F.lit("0")), F.lower(names.suffix(F.col(name))))
    return rows.where(F.col("used").isNotNull()).select(grp, name, F.col(name).alias("target")).unionByName(placed.select(grp, name, target.alias("target")))


def contests(own: pd.DataFrame) -> pd.DataFrame:
    """For each contested name of a family whether its parent takes it, from k, n_before, parent and name; shorter parents first.

    A name `parent_k` that is also asked for itself goes to whom it first comes up for. The parent's requests, but for one
    that gets the parent's own name, take the numbers from 2 on in turn; so it takes k if as many of them as there are
    numbers up to k, without those it had to skip, come before the name's own first request.
    """
    taken: dict = {}
    order = own.assign(depth=own["parent"].str.count("_")).sort_values(["depth", "parent", "k"], kind="stable")
    for parent, part in order.groupby("parent", sort=False):
        skipped, first = 0, 0 if taken.get(parent, False) else 1
        for name, k, before in zip(part["name"], part["k"], part["n_before"], strict=True):
            taken[name] = before - first >= k - 1 - skipped
            skipped += not taken[name]
    return own[["scope", "parent", "k", "name"]].assign(taken=own["name"].map(taken))


def unique_names(rows: DataFrame, scope: str, rank: str, name: str) -> DataFrame:
    """rows with unique: names made unique, by full case folding, in the order of rank (unique in its scope) within the scope.

    A collision takes the first free of _2, _3, ... before the suffix. Requests for a name are numbered by a sort, so that
    one that everybody asks for spreads over tasks. Two names meet only where one is asked for that another's number makes
    (`a_2` beside `a`); these few are decided for each family, from how many requests come before, and the numbers that a
    name had to skip are sorted among its requests, as in renumbered.
    """
    same, ending = names.folded(F.col(name)), names.suffix(F.col("__b"))
    asked = rows.withColumn("__b", same).withColumns({"__scope": F.col(scope), "__rank": F.col(rank)})
    asked = number_within(asked, ["__scope", "__b"], ["__rank"], "__j")
    bases = checkpointed(asked.where("__j = 1").select(F.col("__scope").alias("scope"), F.col("__b").alias("name"), F.col("__rank").alias("first"), names.stem(F.col("__b")).alias("stem"), ending.alias("ending")))
    made = F.regexp_extract("stem", r"^(.*)_([1-9]\d{0,17})$", 2).try_cast("long")
    child = bases.withColumns({"k": made, "parent": F.concat(F.regexp_extract("stem", r"^(.*)_([1-9]\d{0,17})$", 1), F.col("ending"))}).where("k >= 2")
    known = bases.select(F.col("scope"), F.col("name").alias("parent"))
    contested = checkpointed(child.join(known, ["scope", "parent"]).select("scope", "parent", "k", "name", "first", "stem", "ending"))
    columns = [*rows.columns, "unique"]
    wanted = lambda n: F.when(n == 1, F.col(name)).otherwise(F.concat(names.stem(F.col(name)), F.lit("_"), n.cast("string"), names.suffix(F.col(name))))
    if contested.isEmpty():
        return asked.withColumn("unique", wanted(F.col("__j"))).select(*columns)

    parents = contested.select(F.col("scope").alias("__scope"), F.col("parent").alias("__b")).distinct()
    requests = asked.join(parents, ["__scope", "__b"], "left_semi").select(F.col("__scope").alias("scope"), F.col("__b").alias("parent"), F.lit(None).cast("string").alias("name"), F.col("__rank").alias("at"))
    marks = contested.select("scope", "parent", "name", F.col("first").alias("at"))
    place = number_within(requests.unionByName(marks), ["scope", "parent"], ["at", F.col("name").isNotNull()], "place").where("name IS NOT NULL")
    turns = number_within(place, ["scope", "parent"], ["place"], "turn").select("scope", "name", (F.col("place") - F.col("turn")).alias("n_before"))
    family = F.concat(F.regexp_replace("stem", r"(_\d+)+$", ""), F.lit("/"), F.col("ending"))
    open_ones = contested.withColumn("family", family).join(turns, ["scope", "name"]).select("scope", "family", "parent", "k", "name", "n_before")
    kinds = dict(contested.dtypes)
    judged = checkpointed(open_ones.groupBy("scope", "family").applyInPandas(contests, f"scope {kinds['scope']}, parent string, k long, name string, taken boolean"))

    # a name that its parent takes has a number for its first request too
    lost = judged.where("taken").select(F.col("scope").alias("__scope"), F.col("name").alias("__b"), F.lit(1).alias("__lost"))
    skipped = judged.where("NOT taken").select("scope", "parent", "k")
    late = asked.join(lost, ["__scope", "__b"], "left").withColumn("__i", F.col("__j") + F.coalesce("__lost", F.lit(0)) - 1).drop("__lost")
    hard = skipped.select(F.col("scope").alias("__scope"), F.col("parent").alias("__b")).distinct()
    easy = late.join(hard, ["__scope", "__b"], "left_anti").withColumn("unique", wanted(F.col("__i") + 1)).select(*columns)
    ranked = number_within(skipped, ["scope", "parent"], ["k"], "q").select(F.col("scope").alias("__scope"), F.col("parent").alias("__b"), (F.col("k") - F.col("q") - 1).alias("__i"), F.lit(1).alias("__kind"))
    crowd = late.join(hard, ["__scope", "__b"], "left_semi")
    own = crowd.where("__i = 0").withColumn("unique", F.col(name)).select(*columns)
    merged = crowd.where("__i > 0").withColumn("__kind", F.lit(0)).unionByName(ranked, allowMissingColumns=True)
    numbered_ones = number_within(merged, ["__scope", "__b"], ["__i", "__kind"], "__n").where("__kind = 0")
    return easy.unionByName(own).unionByName(numbered_ones.withColumn("unique", wanted(F.col("__n") + 1)).select(*columns))
