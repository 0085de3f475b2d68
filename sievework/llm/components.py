"""Graphs of 64-bit nodes: connected components, and links inside groups of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common
from sievework.operators.iteration import SMALL_GRAPH, roots_of

#: Rounds in which groups are compared with a member drawn by hash, before what is left is grouped anew.
DRAWS = 3
#: Rows of an Arrow batch while pairs are verified: each may hold a whole text, the same one for all pairs with a hub.
ROWS_OF_TEXTS = 256


def connected_components(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, root) for each node of the edges (a, b) that isn't the least of its component, root being that least node.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the graph's size; each is
    checkpointed. A graph of a checked, small size is solved in one task instead. Self-loops and repeated edges don't
    matter; no edges give no rows.
    """
    e = common.checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= small:
        return common.checkpointed(e.coalesce(1).mapInArrow(roots_of, "node long, root long"))
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = common.checkpointed(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())


def still_apart(members: DataFrame, roots: DataFrame, least: int = 2) -> DataFrame:
    """The members (key, node, place) of groups of so many at least that hold several components, with their roots."""
    named = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    rooted = members.select("key", "node", "place").join(named, F.col("node") == F.col("__n"), "left").select("key", "node", "place", F.coalesce("__r", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where(F.col("n") >= least).where("low <> high").select("key")
    return rooted.join(mixed, "key", "left_semi")


def by_rare_tokens(tokened: DataFrame, prefix: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key, node, root and at: where (at) a node holds a token (key) that a partner in another component must share with it.

    tokened: node, root and tokens (array of longs). Tokens are ordered by the number of nodes that hold them, those that
    no two components share first; prefix takes a node's ranks in this order, place by place, and returns the places of
    which a partner shares one: if so many of a stretch may differ, one more of its rarest tokens can't all do.
    """
    each = tokened.select("node", "root", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
    common_ones = each.groupBy("token").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "held")
    listed = each.join(common_ones, "token").groupBy("node", "root", "n").agg(F.collect_list(F.struct("at", "token", "held")).alias("found"))

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                node, root, n = (batch.column(c)[k].as_py() for c in range(3))
                at, token, held = (batch.column(3)[k].values.field(f).to_numpy() for f in range(3))
                tokens, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
                tokens[at], counts[at] = token, held
                ranks = np.empty(n, np.int64)
                ranks[np.lexsort((np.arange(n), tokens, counts))] = np.arange(n)
                chosen = prefix(ranks, tokens)
                chosen = chosen[counts[chosen] > 0]
                out.append((tokens[chosen], np.full(len(chosen), node), np.full(len(chosen), root), chosen.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "node", "root", "at"])

    return listed.mapInArrow(run, "key long, node long, root long, at int")


def pairs_apart(fine: DataFrame) -> DataFrame:
    """node, place, node_2 and place_2 of all pairs of members (key, node, place, root) of a group with different roots.

    Most members of a large group tend to have one root: only those with another root meet the whole group, so that the
    pairs within the largest root, a square of it, aren't even made.
    """
    sizes = fine.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("m.root").alias("most"))
    held = fine.join(largest, "key")
    other = held.select("key", F.col("node").alias("node_2"), F.col("place").alias("place_2"), F.col("root").alias("root_2"))
    pairs = held.where("root <> most").join(other, "key").where("root <> root_2 AND (root_2 = most OR root < root_2)")
    return pairs.select("node", "place", "node_2", "place_2")


def link_groups(early: DataFrame, later: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame], draws: int = DRAWS) -> DataFrame:
    """What verify keeps of pairs of a group's members that is enough to give the components of all pairs it would keep.

    early: key, node, place (anything that verify wants to know of a node in a group); verify takes (a, b, a_place,
    b_place), where pairs repeat, and returns rows with a and b. Groups may be of any size: each member is compared with
    the first of its group. Then later takes what is known, (node, root), and returns the members (key, node, place, root; checkpointed)
    of all groups that hold several components; these are compared with members drawn by hash, a few times over. For what
    is left, refine takes (node, root) and returns members with their roots in groups that are fine enough to compare all
    pairs of different components, and that lose none. So a group of copies, or of texts that a few of them tie together,
    costs its rows, and members that match nothing don't meet the whole group.
    """
    with common.batches_of(early.sparkSession, ROWS_OF_TEXTS):
        return linked(early, later, verify, refine, draws)


def linked(early: DataFrame, later, verify, refine, draws: int) -> DataFrame:
    hubs = early.groupBy("key").agg(F.min(F.struct("node", "place")).alias("hub"), F.max("node").alias("most")).where("hub.node <> most").drop("most")
    pairs = early.join(hubs, "key").where("node <> hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("place").alias("a_place"), F.col("hub.place").alias("b_place"))
    found = common.checkpointed(verify(pairs))
    roots = connected_components(found.select("a", "b"))
    k, members = 0, None
    while k <= draws:
        # in groups of two, all pairs were compared by the first draw
        members = later(roots) if members is None else common.checkpointed(still_apart(members, roots, 3 if k else 2))
        if members.isEmpty():
            break
        if k < draws:
            hubs = members.groupBy("key").agg(F.min_by(F.struct("node", "place", "root"), F.xxhash64("node", F.lit(k))).alias("hub"))
            pairs = members.join(hubs, "key").where("root <> hub.root").select("node", "place", F.col("hub.node").alias("node_2"), F.col("hub.place").alias("place_2"))
        else:
            pairs = pairs_apart(common.checkpointed(refine(members.select("node", "root").distinct())))
        later = F.col("node") > F.col("node_2")
        new = common.checkpointed(
            verify(
                pairs.select(
                    F.greatest("node", "node_2").alias("a"),
                    F.least("node", "node_2").alias("b"),
                    F.when(later, F.col("place")).otherwise(F.col("place_2")).alias("a_place"),
                    F.when(later, F.col("place_2")).otherwise(F.col("place")).alias("b_place"),
                )
            )
        )
        k += 1
        if new.isEmpty():
            k = max(k, draws)  # no more draws where one finds nothing
        else:
            found = found.unionByName(new)
            roots = connected_components(found.select("a", "b"))
    return found
