"""Queries about assets: scans, manifests, samples, names, crops, numbering, assignment and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import geometry, names
from sievework.operators import mask_cache, selection
from sievework.sources import manifest
from sievework.sources.manifest import ASSETS_SQL, IMAGES_SQL

SEED = selection.SEED
MANIFEST = ((1, "src0", 25), (2, "src3", 10), (3, "src7", 5))
#: Entries of a manifest with one error of each kind.
ENTRIES = (
    '{"path": "src0", "count": 3}',
    '{"path": "  ", "count": 3}',
    '{"path": "src1", "count": true}',
    '{"path": "src1", "count": 5.0}',
    '{"path": "/src1", "count": 1}',
    '{"path": "../src1", "count": 1}',
    '{"path": "nowhere", "count": 1}',
    '{"path": "./src0", "count": 2}',
    '{"path": "src2", "count": 100000000}',
    "7",
    '{"path": "src4", "count": 1, "note": "extra keys are ignored"}',
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def assets(spark, sf_dir) -> DataFrame:
    return manifest.asset_view(read(spark, sf_dir, "documents"))


def images(spark, sf_dir) -> DataFrame:
    return assets(spark, sf_dir).where(names.is_image(F.col("name")))


def asset_scan_filter(spark, sf_dir):
    return images(spark, sf_dir).select("doc_id", "grp", "name", F.lower(names.suffix(F.col("name"))).alias("suffix"))


def group_inventory(spark, sf_dir):
    """Every group of the tree with its images; groups without any are kept."""
    every = assets(spark, sf_dir).select("grp").distinct()
    found = images(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"))
    return every.join(found, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).cast("long").alias("n_images"))


def manifest_violations(spark, sf_dir):
    entries = spark.createDataFrame([(k + 1, e) for k, e in enumerate(ENTRIES)], "idx long, entry string")
    folders = images(spark, sf_dir).groupBy(F.col("grp").alias("path")).agg(F.count("*").alias("available"))
    return manifest.manifest_errors(manifest.parse_entries(entries), folders)


def sampled(spark, sf_dir) -> DataFrame:
    wanted = spark.createDataFrame(MANIFEST, "idx long, grp string, count long")
    rows = images(spark, sf_dir).join(F.broadcast(wanted), "grp")  # a row for each entry of a manifest
    return selection.top_by_hash(rows, F.col("count"), ["grp"], names.seeded_key(SEED, F.col("relpath")), ["name"])


def manifest_seeded_sample(spark, sf_dir):
    return sampled(spark, sf_dir).select("grp", "name", "doc_id")


def category_rows(spark, sf_dir) -> DataFrame:
    """What goes to each class: good documents' images as positives, bad ones' as negatives, and the manifest's sample on top of the positives."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "P").otherwise("N").alias("side"))
    copied = images(spark, sf_dir).join(labels, "doc_id").select("side", F.lit(0).cast("long").alias("phase"), "grp", "name", "doc_id")
    chosen = sampled(spark, sf_dir).select(F.lit("P").alias("side"), F.lit(1).cast("long").alias("phase"), "grp", "name", "doc_id")
    return copied.unionByName(chosen)


def category_union(spark, sf_dir):
    return category_rows(spark, sf_dir).groupBy("side", "phase").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def output_naming(spark, sf_dir):
    """Names in their class: prefixed by the group, then made unique in order of phase, group and name."""
    rows = category_rows(spark, sf_dir).withColumn("wanted", names.prefixed(F.col("grp"), F.col("name")))
    rank = F.concat_ws("/", F.col("phase").cast("string"), F.lower("grp"), F.lower("name"), "name")
    out = selection.unique_names(rows.select("side", "phase", "doc_id", "wanted", rank.alias("rank")), "side", "rank", "wanted")
    return out.select("side", "phase", "doc_id", F.col("unique").alias("output"))


def center_crop_box(spark, sf_dir):
    return images(spark, sf_dir).select("doc_id", *geometry.crop_box(F.col("w"), F.col("h")))


def non_square_count(spark, sf_dir):
    return images(spark, sf_dir).groupBy("grp").agg(F.count_if(F.col("w") != F.col("h")).alias("to_crop"), F.count("*").alias("n"))


def largest_remainder_quota(spark, sf_dir):
    sizes = images(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"))
    return selection.largest_remainder(sizes, selection.TRANSFORM_COUNT)


def stratified_sample(spark, sf_dir):
    return selection.stratified_sample(images(spark, sf_dir), selection.TRANSFORM_COUNT).select("grp", "name", "doc_id")


def exclusions(spark, sf_dir) -> DataFrame:
    """An exclusion list made of some of the images, with comments, blank lines and backslashes, and two unknown paths."""
    some = images(spark, sf_dir).where(F.col("doc_id") % 17 == 3).select(F.concat(F.lit("  "), F.translate("relpath", "/", "\\"), F.lit(" ")).alias("line"))
    more = spark.createDataFrame([("# comment",), ("",), ("  # indented",), ("nowhere/a.jpg",), ("nowhere\\b.jpg",)], "line string")
    return manifest.parse_exclusions(some.unionByName(more))


def exclusion_numbered(spark, sf_dir):
    return selection.numbered(images(spark, sf_dir), exclusions(spark, sf_dir)).select("grp", "name", "number", "output")


def unknown_exclusions(spark, sf_dir):
    """Excluded paths that are neither in the transform sample nor among the composites (the groups with an odd number)."""
    odd = images(spark, sf_dir).where(F.regexp_extract("grp", r"(\d+)$", 1).cast("int") % 2 == 1).select("relpath")
    even = images(spark, sf_dir).where(F.regexp_extract("grp", r"(\d+)$", 1).cast("int") % 2 == 0)
    picked = selection.stratified_sample(even, selection.TRANSFORM_COUNT).select("relpath")
    available = odd.union(picked).withColumnRenamed("relpath", "path")
    return exclusions(spark, sf_dir).join(available, "path", "left_anti").select("path")


def background_files(spark, sf_dir) -> DataFrame:
    """Parts as background files: some already numbered, with gaps and a number of another width."""
    part = read(spark, sf_dir, "part")
    grp = F.concat(F.lit("bg"), F.col("p_size").cast("string"))
    numbered = F.concat(grp, F.format_string("_%03d", (F.col("p_partkey") % 40).cast("int")))
    name = F.when(F.col("p_partkey") % 3 == 0, numbered).when(F.col("p_partkey") % 3 == 1, F.concat(grp, F.lit("_"), (F.col("p_partkey") % 10).cast("string"), F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("Photo"), F.col("p_partkey").cast("string")))
    ending = F.when(F.col("p_partkey") % 2 == 0, ".JPG").otherwise(".png")
    return part.groupBy(grp.alias("grp"), F.concat(name, ending).alias("name")).agg(F.min("p_partkey").alias("key"))


def background_renumber(spark, sf_dir):
    return selection.renumbered(background_files(spark, sf_dir))


def backgrounds(spark, sf_dir) -> DataFrame:
    """Every part as a background; the small ones are plain."""
    return read(spark, sf_dir, "part").select(F.concat(F.lit("bg/"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_size") <= 5, "plain").otherwise("textured").alias("kind"))


def plain_split(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("plain"))
    count = F.col("n") * 10
    textured = F.floor(F.col("n") * 3 / 4).cast("long")
    return rows.select("o_custkey", count.alias("count"), F.col("plain").cast("long").alias("plain"), textured.alias("textured"), selection.plain_split(count, F.col("plain"), textured).alias("plain_uses"))


def composite_slots(spark, sf_dir) -> DataFrame:
    """Images numbered over all groups."""
    return selection.number_within(images(spark, sf_dir), [], [F.lower("grp"), F.lower("name"), "name"], "slot")


def balanced_assignment(spark, sf_dir):
    return selection.round_robin(composite_slots(spark, sf_dir).select("slot"), backgrounds(spark, sf_dir))


def assignment_histogram(spark, sf_dir):
    return balanced_assignment(spark, sf_dir).groupBy("kind", "background").agg(F.count("*").alias("uses"))


def stale_outputs(spark, sf_dir):
    """What a sync deletes: outputs of the whole numbering that the numbering with exclusions no longer expects."""
    rows = images(spark, sf_dir)
    before = selection.numbered(rows, exclusions(spark, sf_dir).where("false")).select("grp", "output")
    now = selection.numbered(rows, exclusions(spark, sf_dir)).select("grp", "output")
    return before.join(now, ["grp", "output"], "left_anti")


def cache_lookup(spark, sf_dir):
    """Hits and misses of a mask cache: an entry counts if it is a grey mask of its size, and signature and size agree."""
    rows = assets(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("kind", F.lit("composite"))
    now = rows.select("doc_id", mask_cache.key().alias("key"), F.concat(F.lit("v1/"), F.col("n_chars").cast("string")).alias("signature"), "w", "h")
    cells = F.col("w").cast("long") * F.col("h")
    cache = now.where("doc_id % 3 <> 0").select(
        "key",
        F.when(F.expr("doc_id % 5 = 0"), F.lit("v0/0")).otherwise(F.col("signature")).alias("signature"),
        F.when(F.expr("doc_id % 11 = 0"), F.col("w") + 1).otherwise(F.col("w")).alias("w"),
        "h",
        F.when(F.expr("doc_id % 7 = 0"), 3 * cells).otherwise(F.when(F.expr("doc_id % 11 = 0"), cells + F.col("h")).otherwise(cells)).alias("cells"),
    )
    found = mask_cache.hits(now.select("key", "signature", "w", "h"), cache.where(mask_cache.sound(F.col("cells")))).select("key").distinct().withColumn("hit", F.lit("hit"))
    return now.join(found, "key", "left").select("doc_id", "key", F.coalesce("hit", F.lit("miss")).alias("state"))


def placement_clamp(spark, sf_dir):
    key = F.col("relpath")
    return images(spark, sf_dir).select(
        "doc_id",
        geometry.placed(F.col("w") % 320, geometry.jitter(SEED, key, "x", 36)).alias("x"),
        geometry.placed(F.col("h") % 320, geometry.jitter(SEED, key, "y", 45)).alias("y"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        asset_scan_filter, group_inventory, manifest_violations, manifest_seeded_sample, category_union, output_naming, center_crop_box, non_square_count,
        largest_remainder_quota, stratified_sample, exclusion_numbered, unknown_exclusions, background_renumber, plain_split, balanced_assignment, assignment_histogram,
        stale_outputs, cache_lookup, placement_clamp,
    )
}

SAMPLE_SQL = f"""wanted(grp, cnt) AS (VALUES ('src0', 25), ('src3', 10), ('src7', 5)),
sampled AS (SELECT grp, name, doc_id FROM (SELECT i.*, cnt, row_number() OVER (PARTITION BY i.grp ORDER BY sha256('{SEED}:' || relpath), name) AS rn FROM images i JOIN wanted w ON i.grp = w.grp) WHERE rn <= cnt)"""
CATEGORY_SQL = f"""WITH {IMAGES_SQL}, {SAMPLE_SQL},
category AS (SELECT CASE WHEN quality = 1 THEN 'P' ELSE 'N' END AS side, 0::BIGINT AS phase, grp, name, i.doc_id FROM images i JOIN labels l ON i.doc_id = l.doc_id
             UNION ALL SELECT 'P', 1, grp, name, doc_id FROM sampled)"""


def quota_sql(source: str, total: int = 140) -> str:
    return f"""sizes AS (SELECT grp, count(*) AS n FROM {source} GROUP BY grp),
base AS (SELECT *, least({total}, sum(n) OVER ())::BIGINT AS take, (sum(n) OVER ())::BIGINT AS total FROM sizes),
share AS (SELECT *, take * n // total AS q, take * n % total AS rest FROM base),
quotas AS (SELECT grp, n, (q + CASE WHEN row_number() OVER (ORDER BY rest DESC, lower(grp), grp) <= take - sum(q) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM share),
picked AS (SELECT * FROM (SELECT i.*, quota, row_number() OVER (PARTITION BY i.grp ORDER BY sha256('{SEED}:' || relpath), name) AS rn FROM {source} i JOIN quotas USING (grp)) WHERE rn <= quota)"""


EXCLUDED_SQL = """excluded AS (SELECT relpath AS path FROM images WHERE doc_id % 17 = 3 UNION SELECT 'nowhere/a.jpg' UNION SELECT 'nowhere/b.jpg')"""
NUMBERED_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY lower(name), name) AS number FROM images)"""
BACKGROUND_SQL = f"""slots AS (SELECT row_number() OVER (ORDER BY lower(grp), lower(name), name) AS slot FROM images),
bg AS (SELECT 'bg/' || p_partkey AS path, CASE WHEN p_size <= 5 THEN 'plain' ELSE 'textured' END AS kind FROM part),
plan AS (SELECT count(*) AS n, (SELECT count(*) FROM bg WHERE kind = 'plain') AS np, (SELECT count(*) FROM bg WHERE kind = 'textured') AS nt FROM slots),
split AS (SELECT *, greatest(least(round_even(n * 0.15, 0)::BIGINT, np * 12), n - nt * 12) AS plain FROM plan),
kinds AS (SELECT slot, np, nt, CASE WHEN row_number() OVER (ORDER BY sha256('{SEED}:slot/' || slot), slot) <= plain THEN 'plain' ELSE 'textured' END AS kind FROM slots, split WHERE plain <= np * 12 AND n - plain <= nt * 12),
placed AS (SELECT slot, kind, (i // m)::BIGINT AS cycle, i % m AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY slot) - 1 AS i, CASE WHEN kind = 'plain' THEN np ELSE nt END AS m FROM kinds)),
dealt AS (SELECT path, kind, cycle, row_number() OVER (PARTITION BY kind, cycle ORDER BY sha256('{SEED}:' || cycle || '/' || path), path) - 1 AS place FROM bg JOIN (SELECT DISTINCT kind, cycle FROM placed) USING (kind)),
assigned AS (SELECT slot, kind, cycle, path AS background FROM placed JOIN dealt USING (kind, cycle, place))"""


def jitter_sql(axis: str, most: int) -> str:
    return f"(('0x' || substr(sha256('{SEED}:' || relpath || '/{axis}'), 1, 8))::BIGINT % {2 * most + 1} - {most})"


ORACLES = {
    "asset_scan_filter": f"WITH {IMAGES_SQL} SELECT doc_id, grp, name, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS suffix FROM images",
    "group_inventory": f"WITH {IMAGES_SQL} SELECT a.grp, count(i.doc_id) AS n_images FROM (SELECT DISTINCT grp FROM assets) a LEFT JOIN images i ON a.grp = i.grp GROUP BY a.grp",
    "manifest_violations": f"""WITH {IMAGES_SQL},
e(idx, path, kind, cnt) AS (VALUES (1, 'src0', 'BIGINT', 3), (2, '  ', 'BIGINT', 3), (3, 'src1', 'BOOLEAN', NULL), (4, 'src1', 'DOUBLE', NULL), (5, '/src1', 'BIGINT', 1), (6, '../src1', 'BIGINT', 1),
  (7, 'nowhere', 'BIGINT', 1), (8, './src0', 'BIGINT', 2), (9, 'src2', 'BIGINT', 100000000), (10, NULL, 'NONE', NULL), (11, 'src4', 'BIGINT', 1)),
c AS (SELECT *, array_to_string(list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.')), '/') AS clean FROM e),
k AS (SELECT c.*, f.n AS available, row_number() OVER (PARTITION BY lower(clean) ORDER BY idx) AS turn FROM c LEFT JOIN (SELECT grp, count(*) AS n FROM images GROUP BY grp) f ON c.clean = f.grp),
v AS (SELECT idx::BIGINT AS idx, path, CASE WHEN kind = 'NONE' THEN 'not_object' WHEN path IS NULL OR trim(path) = '' THEN 'bad_path' WHEN cnt IS NULL OR cnt < 1 THEN 'bad_count' WHEN path LIKE '/%' THEN 'absolute'
  WHEN list_contains(string_split(clean, '/'), '..') THEN 'outside' WHEN available IS NULL THEN 'no_folder' WHEN turn > 1 THEN 'repeated' WHEN cnt > available THEN 'too_few' END AS error FROM k)
SELECT idx, path, error FROM v WHERE error IS NOT NULL""",
    "manifest_seeded_sample": f"WITH {IMAGES_SQL}, {SAMPLE_SQL} SELECT grp, name, doc_id FROM sampled",
    "category_union": f"{CATEGORY_SQL} SELECT side, phase, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM category GROUP BY side, phase",
    "output_naming": f"""{CATEGORY_SQL},
named AS (SELECT *, CASE WHEN starts_with(lower(name), lower(grp || '_')) THEN name ELSE grp || '_' || name END AS wanted FROM category),
turns AS (SELECT *, row_number() OVER (PARTITION BY side, lower(wanted) ORDER BY phase, lower(grp), lower(name), name) AS turn FROM named)
SELECT side, phase, doc_id, CASE WHEN turn = 1 THEN wanted ELSE regexp_extract(wanted, '^(.+)[.][^.]+$', 1) || '_' || turn || regexp_extract(wanted, '^.+([.][^.]+)$', 1) END AS output FROM turns""",
    "center_crop_box": f"WITH {IMAGES_SQL} SELECT doc_id, (w - least(w, h)) // 2 AS x0, (h - least(w, h)) // 2 AS y0, (w - least(w, h)) // 2 + least(w, h) AS x1, (h - least(w, h)) // 2 + least(w, h) AS y1 FROM images",
    "non_square_count": f"WITH {IMAGES_SQL} SELECT grp, count(*) FILTER (w <> h) AS to_crop, count(*) AS n FROM images GROUP BY grp",
    "largest_remainder_quota": f"WITH {IMAGES_SQL}, {quota_sql('images')} SELECT grp, n, quota FROM quotas",
    "stratified_sample": f"WITH {IMAGES_SQL}, {quota_sql('images')} SELECT grp, name, doc_id FROM picked",
    "exclusion_numbered": f"WITH {IMAGES_SQL}, {EXCLUDED_SQL}, {NUMBERED_SQL} SELECT grp, name, number, printf('%04d.jpg', number) AS output FROM ranked WHERE relpath NOT IN (SELECT path FROM excluded)",
    "unknown_exclusions": f"""WITH {IMAGES_SQL}, {EXCLUDED_SQL}, even AS (SELECT * FROM images WHERE regexp_extract(grp, '([0-9]+)$', 1)::INT % 2 = 0), {quota_sql('even')}
SELECT path FROM excluded WHERE path NOT IN (SELECT relpath FROM picked UNION ALL SELECT relpath FROM images WHERE regexp_extract(grp, '([0-9]+)$', 1)::INT % 2 = 1)""",
    "background_renumber": """WITH f AS (SELECT DISTINCT 'bg' || p_size AS grp, CASE WHEN p_partkey % 3 = 0 THEN 'bg' || p_size || printf('_%03d', p_partkey % 40) WHEN p_partkey % 3 = 1 THEN 'bg' || p_size || '_' || (p_partkey % 10) || 'x' || p_partkey ELSE 'Photo' || p_partkey END
    || CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '.png' END AS name FROM part),
u AS (SELECT *, regexp_extract(name, '^' || grp || '_([0-9]{3,})[.][^.]+$', 1) AS digits FROM f),
w AS (SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY lower(name), name) AS turn FROM u WHERE digits = ''),
s AS (SELECT grp, unnest(range(1, count(*) + 1)) AS number FROM u GROUP BY grp),
free AS (SELECT grp, number, row_number() OVER (PARTITION BY grp ORDER BY number) AS turn FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.grp = s.grp AND digits <> '' AND digits::BIGINT = number))
SELECT grp, name, name AS target FROM u WHERE digits <> ''
UNION ALL SELECT w.grp, name, w.grp || '_' || printf('%03d', number) || lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) FROM w JOIN free ON w.grp = free.grp AND w.turn = free.turn""",
    "plain_split": """WITH r AS (SELECT o_custkey, count(*) * 10 AS count, count(DISTINCT o_orderpriority) AS plain, floor(count(*) * 3 / 4)::BIGINT AS textured FROM orders GROUP BY o_custkey),
c AS (SELECT *, greatest(least(round_even(count * 0.15, 0)::BIGINT, plain * 12), count - textured * 12) AS chosen FROM r)
SELECT o_custkey, count, plain, textured, CASE WHEN chosen <= plain * 12 AND count - chosen <= textured * 12 THEN chosen END AS plain_uses FROM c""",
    "balanced_assignment": f"WITH {IMAGES_SQL}, {BACKGROUND_SQL} SELECT slot, kind, cycle, background FROM assigned",
    "assignment_histogram": f"WITH {IMAGES_SQL}, {BACKGROUND_SQL} SELECT kind, background, count(*) AS uses FROM assigned GROUP BY kind, background",
    "stale_outputs": f"WITH {IMAGES_SQL}, {EXCLUDED_SQL}, {NUMBERED_SQL} SELECT grp, printf('%04d.jpg', number) AS output FROM ranked WHERE relpath IN (SELECT path FROM excluded)",
    "cache_lookup": f"""WITH {ASSETS_SQL}
SELECT a.doc_id, sha256('composite/' || relpath) AS key, CASE WHEN a.doc_id % 3 <> 0 AND a.doc_id % 5 <> 0 AND a.doc_id % 7 <> 0 AND a.doc_id % 11 <> 0 THEN 'hit' ELSE 'miss' END AS state FROM assets a""",
    "placement_clamp": f"""WITH {IMAGES_SQL}
SELECT doc_id, greatest(0, least(320 - w % 320, (320 - w % 320) // 2 + {jitter_sql('x', 36)})) AS x, greatest(0, least(320 - h % 320, (320 - h % 320) // 2 + {jitter_sql('y', 45)})) AS y FROM images""",
}
