"""Queries of the near-duplicate engine: hashes, pairs, leaders, components and policies, and the whole curation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import visual
from sievework.plans.assets import images, read
from sievework.sources.manifest import IMAGES_SQL

#: Hashes of embeddings lie far apart; this many bits make some pairs.
VECTOR_BITS = 18
PIXELS = visual.SIDE * visual.SIDE


def folded(text: str) -> bytes:
    """A whole text as a raster: byte i is the sum of the code points at places i, i + PIXELS, ... modulo 256."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    whole = np.zeros(max(-(-len(points) // PIXELS), 1) * PIXELS, np.uint32)
    whole[: len(points)] = points
    return (whole.reshape(-1, PIXELS).sum(axis=0, dtype=np.uint64) & np.uint64(255)).astype(np.uint8).tobytes()


def rasters(spark, sf_dir) -> DataFrame:
    """Documents as grey rasters, which whole texts are folded into; null for null."""

    @F.pandas_udf("binary")
    def grey(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else folded(t))

    return read(spark, sf_dir, "documents").select("doc_id", grey.asNondeterministic()("text").alias("pixels"))  # or plans would copy it


def dct_hash(spark, sf_dir):
    return visual.dct_hash(rasters(spark, sf_dir)).select("doc_id", "phash")


def vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as blocks of coefficients: id, label, h."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "label", visual.bits_over_median(F.col("embedding")).alias("h"))


def median_hash(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.col("h").alias("phash"))


def edges_among(rows: DataFrame, most: int) -> DataFrame:
    return visual.hamming_join(rows, None, most).select(F.col("l").alias("a"), F.col("r").alias("b"))


def edges_within(rows: DataFrame, most: int) -> DataFrame:
    """Edges among the rows (id, h, side) of each class: an edge, of which there may be far more than rows, needn't learn its ends' classes."""
    own = [edges_among(rows.where(F.col("side") == side), most) for side in "PN"]
    return own[0].unionByName(own[1])


def led_by_hash(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """rows (id, h) with the leader of each, among rows that agree in `by`; rows of equal hashes have the leader of their first."""
    rows = visual.checkpointed(rows)
    firsts = visual.checkpointed(rows.groupBy(*by, "h").agg(F.min("id").alias("id")))
    edges = edges_among(firsts, most)
    for side in "ab" if by else "":
        edges = edges.join(firsts.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in by]), side)
    for c in by:
        edges = edges.where(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
    found = visual.leaders(firsts, edges).join(firsts, "id")
    return rows.join(found.drop("id"), [*by, "h"])


def hamming_pairs(spark, sf_dir):
    return edges_among(vectors(spark, sf_dir), VECTOR_BITS)


def verified_pairs(spark, sf_dir):
    """Pairs of rasters that pass both tests. Equal rasters are paired with the first of them only."""
    hashed = visual.checkpointed(visual.dct_hash(rasters(spark, sf_dir)).where("phash IS NOT NULL"))  # texts are folded once
    firsts = visual.checkpointed(hashed.groupBy("phash", visual.digest(F.col("pixels")).alias("digest")).agg(F.min("doc_id").alias("id")))
    distinct = firsts.select("id", F.col("phash").alias("h"))
    pairs = edges_among(distinct.select("id", "h"), visual.MAX_BITS).select(F.col("a").alias("l"), F.col("b").alias("r"))
    return visual.verified_pairs(pairs, hashed.select(F.col("doc_id").alias("id"), "pixels").join(firsts.select("id"), "id", "left_semi"))


def led(spark, sf_dir) -> DataFrame:
    """Leaders in each class (labels below 5: P): side, id, leader, h."""
    rows = vectors(spark, sf_dir).withColumn("side", F.when(F.col("label") < 5, "P").otherwise("N"))
    return led_by_hash(rows.select("id", "side", "h"), ["side"], VECTOR_BITS).select("id", "side", "h", "leader")


def leader_clusters(spark, sf_dir):
    return led_by_hash(vectors(spark, sf_dir).select("id", "h"), [], VECTOR_BITS).select(F.col("id").alias("vec_id"), "leader")


def internal_survivors(spark, sf_dir):
    return led(spark, sf_dir).where("id = leader").select("side", F.col("id").alias("vec_id"))


def cross_matches(rows: DataFrame) -> DataFrame:
    """(p, n) among the leaders of the two classes."""
    kept = rows.where("id = leader")
    return visual.hamming_join(kept.where("side = 'P'"), kept.where("side = 'N'"), VECTOR_BITS).select(F.col("l").alias("p"), F.col("r").alias("n"))


def cross_pairs(spark, sf_dir):
    return cross_matches(led(spark, sf_dir))


def cross_components(spark, sf_dir):
    return visual.cross_components(cross_matches(led(spark, sf_dir))).select("side", F.col("id").alias("vec_id"), "component")


def resolved(choice: str):
    def query(spark, sf_dir):
        members = visual.cross_components(cross_matches(led(spark, sf_dir)))
        choices = members.where("side = 'P' AND id = component").select("component", F.lit(choice).alias("choice"))
        return visual.resolve(members, choices).select("side", F.col("id").alias("vec_id"), "component", "action")

    return query


def removal_summary(spark, sf_dir):
    """Removals by reason and side, if components with an even name lose their P side, others both, and every fifth stays open."""
    rows = led(spark, sf_dir)
    internal = rows.where("id <> leader").select(F.lit("internal").alias("reason"), "side", F.lit("delete").alias("action"))
    members = visual.cross_components(cross_matches(rows))
    choice = F.when(F.col("component") % 2 == 0, "P").otherwise("A")
    choices = members.where("component % 5 <> 0").select("component", choice.alias("choice")).distinct()
    cross = visual.resolve(members, choices).select(F.lit("cross").alias("reason"), "side", "action")
    return internal.unionByName(cross).groupBy("reason", "side", "action").agg(F.count("*").alias("n"))


def curation_pipeline(spark, sf_dir):
    """All steps over documents: scan, hash, leaders in each class, conflicts between classes (N goes), actions.

    Class by label (unlabelled: P); rank by id. Pairs match by hash and by pixels; equal rasters of a class are one.
    """
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    scanned = images(spark, sf_dir).join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "grp", F.when(F.col("quality") == 0, "N").otherwise("P").alias("side"))
    hashed = visual.dct_hash(rasters(spark, sf_dir)).where("phash IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("phash").alias("h"), "pixels", visual.digest(F.col("pixels")).alias("digest"))
    rows = visual.checkpointed(scanned.join(hashed, "id"))
    distinct = visual.checkpointed(rows.groupBy("side", "h", "digest").agg(F.min("id").alias("id")))  # equal rasters: one cluster, led by the first
    pixels = rows.select("id", "pixels")
    within = edges_within(distinct, visual.MAX_BITS)
    same = visual.verified_pairs(within.select(F.col("a").alias("l"), F.col("b").alias("r")), pixels).select(F.col("l").alias("a"), F.col("r").alias("b"))
    groups = visual.checkpointed(distinct.join(visual.leaders(distinct, same), "id"))
    kept = groups.where("id = leader")
    near = visual.hamming_join(kept.where("side = 'P'"), kept.where("side = 'N'"), visual.MAX_BITS)
    pairs = visual.checkpointed(visual.verified_pairs(near, pixels).select(F.col("l").alias("p"), F.col("r").alias("n")))
    members = visual.resolve(visual.cross_components(pairs), pairs.select(F.col("p").alias("component")).where("false").withColumn("choice", F.lit("N")), "N")
    lost = members.where("action = 'delete'").select(F.col("id").alias("leader"), F.lit("cross").alias("why"))
    named = rows.join(groups.select("side", "h", "digest", "leader"), ["side", "h", "digest"]).join(lost, "leader", "left")
    action = F.when(F.col("id") != F.col("leader"), "drop_internal").when(F.col("why").isNotNull(), "drop_cross").otherwise("keep")
    return named.select(F.col("id").alias("doc_id"), "grp", "side", "leader", action.alias("action"))


QUERIES = {
    f.__name__: f for f in (dct_hash, median_hash, hamming_pairs, verified_pairs, leader_clusters, internal_survivors, cross_pairs, cross_components, removal_summary, curation_pipeline)
} | {"resolve_p": resolved("P"), "resolve_n": resolved("N"), "resolve_a": resolved("A")}

VECTORS_SQL = f"""vectors AS (SELECT vec_id AS id, label, CASE WHEN label < 5 THEN 'P' ELSE 'N' END AS side,
  list_reduce(list_prepend(0::BIGINT, [CASE WHEN x > list_sort(embedding[2:64])[32] THEN 1 ELSE 0 END::BIGINT FOR x IN embedding[2:64]]), lambda a, b: a * 2 + b) AS h FROM embeddings),
edges AS (SELECT x.id AS a, y.id AS b, x.side AS sa, y.side AS sb FROM vectors x JOIN vectors y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= {VECTOR_BITS})"""


def leaders_sql(name: str, nodes: str, edges: str) -> str:
    """Greedy clusters in the order of id, by recursion over ranks; the state is the list of leaders so far."""
    return f"""{name}_r AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM {nodes}),
{name}_e AS (SELECT r.id, r.rn, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS near FROM {name}_r r LEFT JOIN {edges} e ON e.b = r.id GROUP BY r.id, r.rn),
{name}_g AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::BIGINT[] AS leads
  UNION ALL SELECT e.rn, e.id, coalesce(list_min(list_intersect(g.leads, e.near)), e.id), CASE WHEN len(list_intersect(g.leads, e.near)) = 0 THEN list_append(g.leads, e.id) ELSE g.leads END
  FROM {name}_g g JOIN {name}_e e ON e.rn = g.rn + 1),
{name} AS (SELECT id, leader FROM {name}_g WHERE rn > 0)"""


LED_SQL = f"WITH RECURSIVE {VECTORS_SQL}, inner_edges AS (SELECT a, b FROM edges WHERE sa = sb), {leaders_sql('led', 'vectors', 'inner_edges')}, kept AS (SELECT v.* FROM vectors v JOIN led USING (id) WHERE id = leader)"


def components_sql(pairs: str) -> str:
    return f"""pairs AS ({pairs}),
links AS (SELECT p AS a, p2 AS b FROM (SELECT x.p, y.p AS p2 FROM pairs x JOIN pairs y ON x.n = y.n)),
reach AS (SELECT DISTINCT p AS a, p AS b FROM pairs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
members AS (SELECT 'P' AS side, id, component FROM comp UNION ALL SELECT 'N', n, min(component) FROM pairs JOIN comp ON p = id GROUP BY n)"""


CROSS_SQL = "SELECT x.id AS p, y.id AS n FROM kept x JOIN kept y ON x.side = 'P' AND y.side = 'N' AND bit_count(xor(x.h, y.h)) <= 18"
MEMBERS_SQL = f"{LED_SQL}, {components_sql(CROSS_SQL)}"
#: Grey bytes by place: whole texts, folded.
RASTER_SQL = """chars AS (SELECT doc_id, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL),
sums AS (SELECT doc_id, i % 1024 AS i, sum(unicode(c)) % 256 AS g FROM chars WHERE c IS NOT NULL GROUP BY doc_id, i % 1024),
px AS (SELECT r.doc_id, r.i // 32 AS y, r.i % 32 AS x, coalesce(g, 0)::INT AS g
       FROM (SELECT doc_id, unnest(range(1024)) AS i FROM documents WHERE text IS NOT NULL) r LEFT JOIN sums s ON s.doc_id = r.doc_id AND s.i = r.i)"""
#: Those, the separable cosine transform as two grouped sums, rounded as the engine does.
DCT_SQL = f"""{RASTER_SQL},
cs AS (SELECT f, s, cos(pi() * (s + 0.5) * f / 32) AS c FROM range(8) a(f), range(32) b(s)),
rowc AS (SELECT doc_id, y, f AS fx, sum(g * c) AS v FROM px JOIN cs ON s = x GROUP BY doc_id, y, f),
coef AS (SELECT doc_id, fx, f AS fy, round(sum(v * c), 6) AS v FROM rowc JOIN cs ON s = y GROUP BY doc_id, fx, f),
ac AS (SELECT doc_id, list(v ORDER BY fx * 8 + fy) AS vs FROM coef WHERE fx * 8 + fy > 0 GROUP BY doc_id),
hashes AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [CASE WHEN x > list_sort(vs)[32] THEN 1 ELSE 0 END::BIGINT FOR x IN vs]), lambda a, b: a * 2 + b) AS phash FROM ac)"""


def action_sql(choice: str) -> str:
    return f"{MEMBERS_SQL} SELECT side, id AS vec_id, component, CASE WHEN '{choice}' = 'A' OR side = '{choice}' THEN 'delete' ELSE 'keep' END AS action FROM members"


ORACLES = {
    "dct_hash": f"WITH {DCT_SQL} SELECT doc_id, phash FROM hashes",
    "median_hash": f"WITH {VECTORS_SQL} SELECT id AS vec_id, h AS phash FROM vectors",
    "hamming_pairs": f"WITH {VECTORS_SQL} SELECT a, b FROM edges",
    "verified_pairs": f"""WITH {DCT_SQL},
pixels AS (SELECT doc_id, list(g ORDER BY y * 32 + x) AS p FROM px GROUP BY doc_id),
firsts AS (SELECT min(doc_id) AS id, phash, p FROM hashes JOIN pixels USING (doc_id) GROUP BY phash, p)
SELECT l.id AS l, r.id AS r FROM firsts l JOIN firsts r ON l.id < r.id AND bit_count(xor(l.phash, r.phash)) <= 6
WHERE list_sum(list_transform(list_zip(l.p, r.p), lambda z: abs(z[1] - z[2]))) / 1024.0 <= 18""",
    "leader_clusters": f"WITH RECURSIVE {VECTORS_SQL}, all_edges AS (SELECT a, b FROM edges), {leaders_sql('led', 'vectors', 'all_edges')} SELECT id AS vec_id, leader FROM led",
    "internal_survivors": f"{LED_SQL} SELECT side, id AS vec_id FROM kept",
    "cross_pairs": f"{LED_SQL} {CROSS_SQL}",
    "cross_components": f"{MEMBERS_SQL} SELECT side, id AS vec_id, component FROM members",
    "resolve_p": action_sql("P"),
    "resolve_n": action_sql("N"),
    "resolve_a": action_sql("A"),
    "removal_summary": f"""{MEMBERS_SQL},
acts AS (SELECT 'internal' AS reason, side, 'delete' AS action FROM vectors JOIN led USING (id) WHERE id <> leader
  UNION ALL SELECT 'cross', side, CASE WHEN component % 5 = 0 THEN 'unresolved' WHEN component % 2 = 1 OR side = 'P' THEN 'delete' ELSE 'keep' END FROM members)
SELECT reason, side, action, count(*) AS n FROM acts GROUP BY reason, side, action""",
    "curation_pipeline": f"""WITH RECURSIVE {IMAGES_SQL}, {DCT_SQL},
pixels AS (SELECT doc_id, list(g ORDER BY y * 32 + x) AS p FROM px GROUP BY doc_id),
rows AS (SELECT i.doc_id AS id, grp, CASE WHEN quality = 0 THEN 'N' ELSE 'P' END AS side, phash AS h, p FROM images i JOIN hashes USING (doc_id) JOIN pixels USING (doc_id) LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
firsts AS (SELECT side, h, p, min(id) AS id FROM rows GROUP BY side, h, p),
alike AS (SELECT x.id AS a, y.id AS b, x.side AS sa, y.side AS sb FROM firsts x JOIN firsts y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 6
  WHERE list_sum(list_transform(list_zip(x.p, y.p), lambda z: abs(z[1] - z[2]))) / 1024.0 <= 18),
near AS (SELECT a, b FROM alike WHERE sa = sb),
{leaders_sql('led', 'firsts', 'near')},
grps AS (SELECT f.*, leader FROM firsts f JOIN led USING (id)), kept AS (SELECT * FROM grps WHERE id = leader),
lost AS (SELECT DISTINCT CASE WHEN sa = 'N' THEN a ELSE b END AS id FROM alike WHERE sa <> sb AND a IN (SELECT id FROM kept) AND b IN (SELECT id FROM kept))
SELECT r.id AS doc_id, grp, r.side, leader, CASE WHEN r.id <> leader THEN 'drop_internal' WHEN leader IN (SELECT id FROM lost) THEN 'drop_cross' ELSE 'keep' END AS action
FROM rows r JOIN grps g ON r.side = g.side AND r.h = g.h AND r.p = g.p""",
}
