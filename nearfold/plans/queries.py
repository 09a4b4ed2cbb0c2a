"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.similarity import hash_hex, max_distance, percent
from nearfold.operators import edges, groups, keep, listing, matches
from nearfold.plans import dedup
from nearfold.sources.tables import FOLDERS, ROTATION, listed_files, mapped_benchmark, mapped_documents
from nearfold.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BAR = dedup.DEFAULT_BAR
ROOT, TO = "/lib", "/copy"


def grayscale_rule(coloured: Column, resolution: Column) -> Column:
    """Gray if fewer samples are coloured than whole 1,024s of pixels."""
    return coloured < F.shiftright(resolution, 10)


def images_of(spark: SparkSession, d: str) -> DataFrame:
    """The documents as images, hashed once for all steps of a query."""
    return stored(mapped_documents(spark, d), "images")


def hash_of_id(images: DataFrame, id_: int) -> int | None:
    row = images.where(F.col("id") == id_).select("hash").first()
    return None if row is None else row["hash"]


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


# --- SQL parts ----------------------------------------------------------------------------

_BITS = ", ".join(f"CASE WHEN sum(CASE WHEN (h >> {63 - i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN '1' ELSE '0' END" for i in range(64))
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def sig_sql(table: str, key: str) -> str:
    return f"""tok AS (SELECT {key}, unnest(string_split(lower(text), ' ')) AS t FROM {table}),
hsh AS (SELECT {key}, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM tok),
sig AS (SELECT {key}, CAST(CAST(concat({_BITS}) AS BIT) AS BIGINT) AS hash FROM hsh GROUP BY {key})"""


IMAGES_SQL = f"""{sig_sql("documents", "doc_id")},
m AS (
  SELECT d.doc_id AS id, '/lib/' || source || '/' || d.doc_id || '.' || {_LIST(ROTATION)}[d.doc_id % {len(ROTATION)} + 1] AS physical_path,
    hash, n_chars AS size, CAST(trunc(o_totalprice) AS BIGINT) AS resolution, ts AS last_write_time,
    coalesce(quality = 0, false) AS is_grayscale, CASE WHEN d.doc_id % 2 = 0 THEN 'source' ELSE 'destination' END AS side
  FROM documents d JOIN sig USING (doc_id) JOIN orders ON o_orderkey = d.doc_id JOIN events ON event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def groups_sql(k: int, images: str = "m", where: str = "true") -> str:
    """g: the images with component_id and group_size."""
    return f"""mm AS (SELECT * FROM {images} WHERE {where}),
rep AS (SELECT hash, min(id) AS rep FROM mm GROUP BY hash),
e AS (SELECT a.rep AS a, b.rep AS b FROM rep a JOIN rep b ON a.rep <> b.rep AND bit_count(xor(a.hash, b.hash)) <= {k}),
reach(a, b) AS (SELECT rep, rep FROM rep UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
g AS (SELECT mm.*, component_id, count(*) OVER (PARTITION BY component_id) AS group_size FROM mm JOIN rep USING (hash) JOIN c ON c.a = rep.rep)"""


ORDER_SQL = {
    "Newest": "last_write_time DESC",
    "Oldest": "last_write_time",
    "Largest": "size DESC",
    "Smallest": "size",
    "HighestResolution": "resolution DESC",
    "LowestResolution": "resolution",
    "GrayScale": "is_grayscale DESC",
    "Colorful": "is_grayscale",
}


def best_sql(names, name: str = "best") -> str:
    order = ", ".join([*(ORDER_SQL[n] for n in names), "physical_path", "id"])
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY {order}) AS rn FROM g) WHERE rn = 1)"


SIMILARITY_SQL = "(64 - bit_count(xor({a}, {b}))) / 64.0"
DEFAULT_NAMES = [k.value for k in keep.DEFAULT_KEEP]
K = max_distance(BAR)


# --- Similarity joins ---------------------------------------------------------------------


def edges_query(bar: int) -> Query:
    return lambda spark, d: edges.similarity_edges(images_of(spark, d), max_distance(bar))


for _bar in (90, 96, 99, 100, 101):
    _k = max_distance(_bar)
    add(
        f"near_dup_edges_bar{_bar}",
        edges_query(_bar),
        f"""WITH {IMAGES_SQL},
rep AS (SELECT hash, min(id) AS rep FROM m GROUP BY hash)
SELECT rep AS src_id, id AS dst_id, 0 AS dist FROM m JOIN rep USING (hash) WHERE id <> rep AND {_k} >= 0
UNION ALL
SELECT a.rep, b.rep, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) FROM rep a JOIN rep b ON a.rep < b.rep WHERE bit_count(xor(a.hash, b.hash)) <= {_k}""",
    )

add(
    "similarity_histogram",
    lambda spark, d: edges.distance_histogram(images_of(spark, d), max_distance(90)),
    f"""WITH {IMAGES_SQL}
SELECT CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS dist, count(*) AS pairs FROM m a JOIN m b ON a.id < b.id
WHERE bit_count(xor(a.hash, b.hash)) <= {max_distance(90)} GROUP BY 1""",
)


# --- Groups and keepers -------------------------------------------------------------------


def grouped(spark: SparkSession, d: str, singletons: bool = False) -> DataFrame:
    return groups.group_images(images_of(spark, d), BAR, singletons)


add(
    "near_dup_groups",
    lambda spark, d: grouped(spark, d).select("id", "component_id", "group_size"),
    f"WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)} SELECT id, component_id, group_size FROM g WHERE group_size > 1",
)
add(
    "near_dup_groups_with_singletons",
    lambda spark, d: grouped(spark, d, True).select("id", "component_id", "group_size"),
    f"WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)} SELECT id, component_id, group_size FROM g",
)
add(
    "near_dup_groups_bar90",
    lambda spark, d: groups.group_images(images_of(spark, d), 90).select("id", "component_id", "group_size"),
    f"WITH RECURSIVE {IMAGES_SQL}, {groups_sql(max_distance(90))} SELECT id, component_id, group_size FROM g WHERE group_size > 1",
)
add(
    "group_size_histogram",
    lambda spark, d: grouped(spark, d, True).groupBy("component_id").agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups")),
    f"WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)} SELECT group_size, count(DISTINCT component_id) AS n_groups FROM g GROUP BY group_size",
)


def keep_query(names) -> Query:
    return lambda spark, d: keep.best_of_groups(grouped(spark, d), names).select("component_id", "id", "physical_path")


for _name, _keep in {"default": DEFAULT_NAMES, "newest": ["Newest"], "oldest": ["Oldest"], "largest": ["Largest"], "smallest": ["Smallest"], "highest_res": ["HighestResolution"], "lowest_res": ["LowestResolution"], "grayscale": ["GrayScale"], "colorful": ["Colorful"]}.items():
    add(
        f"keep_best_{_name}",
        keep_query(_keep),
        f"WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)}, {best_sql(_keep)} SELECT component_id, id, physical_path FROM best WHERE group_size > 1",
    )


# --- Plans --------------------------------------------------------------------------------


def plan_sql(action: str, moves: bool) -> str:
    target = f"'{ROOT}/.trash/' || regexp_extract(g.physical_path, '([^/]*)$', 1)" if moves else "CAST(NULL AS VARCHAR)"
    return f"""WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)}, {best_sql(DEFAULT_NAMES)}
SELECT g.component_id, g.id, g.physical_path, best.id AS keeper_id, best.physical_path AS keeper_path,
  {SIMILARITY_SQL.format(a="g.hash", b="best.hash")} AS similarity, '{action}' AS action, {target} AS target_path
FROM g JOIN best USING (component_id) WHERE g.id <> best.id"""


def plan_query(action: dedup.Action) -> Query:
    return lambda spark, d: dedup.dedup_plan(images_of(spark, d), BAR, action=action, root=ROOT)


for _action in dedup.Action:
    _moves = _action in (dedup.Action.MOVE_TO_TRASH, dedup.Action.MOVE_TO_TRASH_AND_CREATE_LINK)
    _suffix = "" if _action is dedup.Action.MOVE_TO_TRASH else "_" + "".join(f"_{c.lower()}" if c.isupper() else c for c in _action.value).lstrip("_")
    add(f"dedup_plan{_suffix}", plan_query(_action), plan_sql(_action.value, _moves))

add(
    "dedup_summary",
    lambda spark, d: dedup.dedup_summary(images_of(spark, d), BAR),
    f"""WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)}
SELECT count(*) AS images, count(DISTINCT component_id) FILTER (group_size > 1) AS groups, count(*) FILTER (group_size > 1) AS grouped_images,
  count(*) FILTER (group_size > 1) - count(DISTINCT component_id) FILTER (group_size > 1) AS duplicates FROM g""",
)

SOURCE, DESTINATION = "side = 'source'", "side = 'destination'"

COPY_SQL = f"""WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K, where=SOURCE)}, {best_sql(DEFAULT_NAMES)},
hit AS (
  SELECT b.id AS bid, x.id AS match_id, x.physical_path AS match_path, CAST(bit_count(xor(b.hash, x.hash)) AS INTEGER) AS match_distance,
    row_number() OVER (PARTITION BY b.id ORDER BY bit_count(xor(b.hash, x.hash)), x.physical_path, x.id) AS rn2
  FROM best b JOIN m x ON x.{DESTINATION} AND bit_count(xor(b.hash, x.hash)) <= {K}
), plan AS (
  SELECT component_id, id, physical_path, CASE WHEN match_id IS NULL THEN 'copy' ELSE 'skip' END AS decision, match_id, match_path, match_distance,
    CASE WHEN match_id IS NULL THEN '{TO}/' || substr(physical_path, {len(ROOT) + 2}) END AS target_path
  FROM best LEFT JOIN hit ON bid = id AND rn2 = 1
)"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    images = images_of(spark, d)
    return images.where(SOURCE).drop("side"), images.where(DESTINATION).drop("side")


def copy(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copy_plan(*sides(spark, d), BAR, source_root=ROOT, destination_root=TO)


def copied(spark: SparkSession, d: str) -> DataFrame:
    source, destination = sides(spark, d)
    return dedup.copy_summary(dedup.copy_plan(source, destination, BAR, source_root=ROOT, destination_root=TO), source)


add("dedup_copy_decision", copy, f"{COPY_SQL} SELECT * FROM plan")
add(
    "dedup_copy_summary",
    copied,
    f"""{COPY_SQL} SELECT (SELECT count(*) FROM m WHERE {SOURCE}) AS images, count(*) AS groups,
  count(*) FILTER (decision = 'copy') AS copied, count(*) FILTER (decision = 'skip') AS skipped FROM plan""",
)
for _name, _op, _not in (("semi_join_similar", matches.with_match, ""), ("anti_join_similar", matches.without_match, "NOT ")):
    add(
        _name,
        (lambda op: lambda spark, d: op(*sides(spark, d), BAR).select("id", "physical_path"))(_op),
        f"""WITH {IMAGES_SQL} SELECT id, physical_path FROM m s WHERE {SOURCE}
AND {_not}EXISTS (SELECT 1 FROM m x WHERE x.{DESTINATION} AND bit_count(xor(s.hash, x.hash)) <= {K})""",
    )
add(
    "dedup_patch_plan",
    lambda spark, d: dedup.patch_plan(*sides(spark, d), BAR),
    f"""WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)}, {best_sql(DEFAULT_NAMES)}
SELECT g.component_id, g.id, g.physical_path, best.id AS keeper_id, best.physical_path AS keeper_path, {SIMILARITY_SQL.format(a="g.hash", b="best.hash")} AS similarity
FROM g JOIN best USING (component_id) WHERE best.{SOURCE} AND g.{DESTINATION}""",
)
add(
    "compare_pairs",
    lambda spark, d: dedup.compare(mapped_benchmark(spark, d)).withColumn("shown", percent(F.col("similarity"))),
    f"""WITH {sig_sql("benchmark", "item_id")}
SELECT a.item_id AS id_a, b.item_id AS id_b, '/list/' || a.item_id AS path_a, '/list/' || b.item_id AS path_b,
  {SIMILARITY_SQL.format(a="a.hash", b="b.hash")} AS similarity, printf('%.2f%%', 100.0 * {SIMILARITY_SQL.format(a="a.hash", b="b.hash")}) AS shown
FROM sig a JOIN sig b ON a.item_id < b.item_id""",
)


def top(spark: SparkSession, d: str) -> DataFrame:
    images = images_of(spark, d)
    query = hash_of_id(images, 0)
    return dedup.top_similar(images if query is not None else images.limit(0), query or 0)


def near(spark: SparkSession, d: str) -> DataFrame:
    images = images_of(spark, d)
    query = hash_of_id(images, 0)
    return matches.range_search(images if query is not None else images.limit(0), query or 0, max_distance(75)).select("id", "physical_path", "distance")


def patched(spark: SparkSession, d: str) -> DataFrame:
    source, destination = sides(spark, d)
    grouped = dedup.patch_groups(source, destination, BAR)
    return dedup.patch_summary(source, destination, grouped, dedup.patch_plan(source, destination, BAR, grouped=grouped))


add(
    "dup_top15",
    top,
    f"""WITH {IMAGES_SQL} SELECT physical_path, {SIMILARITY_SQL.format(a="hash", b="(SELECT hash FROM m WHERE id = 0)")} AS similarity
FROM m ORDER BY similarity DESC, physical_path LIMIT 15""",
)
add(
    "range_search",
    near,
    f"""WITH {IMAGES_SQL}, d AS (SELECT id, physical_path, CAST(bit_count(xor(hash, (SELECT hash FROM m WHERE id = 0))) AS INTEGER) AS distance FROM m)
SELECT id, physical_path, distance FROM d WHERE distance <= {max_distance(75)}""",
)
add(
    "dedup_patch_summary",
    patched,
    f"""WITH RECURSIVE {IMAGES_SQL}, {groups_sql(K)}, {best_sql(DEFAULT_NAMES)}
SELECT (SELECT count(*) FROM m) AS images, (SELECT count(DISTINCT component_id) FROM g WHERE group_size > 1) AS groups,
  (SELECT count(*) FROM g WHERE group_size > 1) AS grouped_images,
  (SELECT count(*) FROM g JOIN best USING (component_id) WHERE best.{SOURCE} AND g.{DESTINATION}) AS patched""",
)
add("hash_hex", lambda spark, d: images_of(spark, d).select("id", hash_hex(F.col("hash")).alias("hash_hex")), f"WITH {IMAGES_SQL} SELECT id, to_hex(hash) AS hash_hex FROM m")


# --- Listings and pixels ------------------------------------------------------------------

FILES_SQL = f"""WITH f AS (
  SELECT doc_id AS id, '/lib/' || source || {_LIST(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || '/' || doc_id || '.' || {_LIST(ROTATION)}[doc_id % {len(ROTATION)} + 1] AS physical_path,
    n_chars % 7 = 0 AS is_symlink
  FROM documents
)"""
_EXT = f"lower(regexp_extract(physical_path, '\\.([^./]*)$', 1)) IN ({', '.join(repr(x) for x in dedup.DEFAULT_EXTENSIONS)})"
_TRASH = "NOT ends_with(regexp_extract(physical_path, '([^/]+)/[^/]+$', 1), '.trash')"

add("file_filter_extension", lambda spark, d: listing.with_extensions(listed_files(spark, d), dedup.DEFAULT_EXTENSIONS).select("id", "physical_path"), f"{FILES_SQL} SELECT id, physical_path FROM f WHERE {_EXT}")
add("file_filter_trash", lambda spark, d: listing.without_trash(listed_files(spark, d)).select("id", "physical_path"), f"{FILES_SQL} SELECT id, physical_path FROM f WHERE {_TRASH}")
add("file_filter_symlink", lambda spark, d: listing.without_links(listed_files(spark, d)).select("id", "physical_path"), f"{FILES_SQL} SELECT id, physical_path FROM f WHERE NOT is_symlink")
add(
    "file_filter_all",
    lambda spark, d: listing.with_extensions(listing.without_links(listing.without_trash(listed_files(spark, d))), dedup.DEFAULT_EXTENSIONS).select("id", "physical_path"),
    f"{FILES_SQL} SELECT id, physical_path FROM f WHERE {_EXT} AND {_TRASH} AND NOT is_symlink",
)
add(
    "grayscale_rule",
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", grayscale_rule(F.col("o_custkey") % 300, F.col("o_totalprice").cast("long")).alias("is_grayscale")),
    "SELECT o_orderkey, o_custkey % 300 < (CAST(trunc(o_totalprice) AS BIGINT) >> 10) AS is_grayscale FROM orders",
)
