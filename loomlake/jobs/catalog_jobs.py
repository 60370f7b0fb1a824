"""Queries over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.staging import by_sessions
from loomlake.operators import catalog as C
from loomlake.sources.bridges import catalog, labels

#: Searches and titles that the queries look for.
SEARCHES = ("the er", "THE S1", "le de", "ß", "En CH", "zzzz")
TITLES = ("the", "ß", "zzzz zzzz")
LIMIT, OFFSET = 100, 50
#: Titles are chosen for so many slices of sessions in turn, each of which shuffles its share of the labels' texts.
TITLE_SLICES = 2


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """Some given titles, and those of every twentieth session."""
    titles = by_sessions(labels(spark, d), C.display_titles, TITLE_SLICES, "catalog_id")
    given = spark.createDataFrame([(t,) for t in TITLES], "query string")
    return C.resolved(titles, given.unionByName(titles.where(F.col("catalog_id") % 20 == 0).select(F.col("title").alias("query"))))


#: The earlier snapshot lacks some files, the current one others and those of a root that failed; no row is in neither.
BEFORE, NOW = "catalog_id % 10 <> 3 OR root_id = 'src3'", "root_id <> 'src3' AND (catalog_id % 8 <> 5 OR catalog_id % 10 = 3)"


def _previous(spark: SparkSession, d: str) -> DataFrame:
    """An earlier snapshot: some files not there yet, some of another size, one root's files gone since."""
    old = catalog(spark, d).where(BEFORE)
    return old.withColumn("size", F.when(F.col("catalog_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where(NOW)


def _failed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src3",)], "root_id string")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("parent_id IS NOT NULL").select(F.col("catalog_id").alias("child"), F.col("parent_id").alias("parent"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d).select("format", F.col("root_id").alias("path"), F.when(F.col("catalog_id") % 2 == 0, "default").otherwise("added").alias("source"), "catalog_id")
    return C.merged_roots(rows.where("catalog_id % 3 = 0"), rows.where("catalog_id % 3 <> 0"))


def _native(spark: SparkSession, d: str) -> DataFrame:
    """Every path has a label, and every native id one, that of its first session."""
    s = catalog(spark, d)
    by_path = s.select("relative_path", F.concat(F.lit("p"), F.col("catalog_id").cast("string")).alias("value"))
    by_id = s.where("native_id IS NOT NULL").groupBy("native_id").agg(F.concat(F.lit("i"), F.min("catalog_id").cast("string")).alias("value"))
    return C.native_labels(s, by_path, by_id)


QUERIES = {
    "a4_status_counts": lambda s, d: catalog(s, d).groupBy("format", "status").agg(F.count("*").alias("n"), F.sum("size").alias("size")),
    "a7_duplicate_ids": lambda s, d: C.duplicates(catalog(s, d)),
    "c1_refreshed": lambda s, d: C.refreshed(_previous(s, d), _current(s, d), _current(s, d), _failed(s)).select("catalog_id", "root_id", "relative_path", "size", "status"),
    "c4_search": lambda s, d: C.search(catalog(s, d), labels(s, d), list(SEARCHES)),
    "c5_resolved_titles": _resolved,
    "c6_located": lambda s, d: C.located(catalog(s, d), catalog(s, d).where("native_id IS NOT NULL").select("native_id").distinct()),
    "c7_transferable": lambda s, d: C.transferable(catalog(s, d)).select("catalog_id", "status"),
    "f5_filtered": lambda s, d: C.filtered(catalog(s, d), formats=["en", "de"], kinds=["main"], since_ms=1704067200000 + 20_000_000, until_ms=1704067200000 + 70_000_000).select("catalog_id", "format", "modified_ms"),
    "g3_lineage_roots": lambda s, d: C.lineage_roots(_edges(s, d)),
    "j5_native_labels": _native,
    "j6_lineage": lambda s, d: C.lineage(catalog(s, d)),
    "j7_refresh_diff": lambda s, d: C.refresh_diff(_previous(s, d), _current(s, d), _failed(s)),
    "j8_copies": lambda s, d: C.with_duplicates(catalog(s, d)),
    "t1_display_titles": lambda s, d: C.display_titles(labels(s, d)),
    "t2_catalog_page": lambda s, d: C.page(catalog(s, d), LIMIT, OFFSET).select("catalog_id", "modified_ms"),
    "u2_first_labels": lambda s, d: C.first_labels(labels(s, d)),
    "u3_merged_roots": _roots,
}

def _sql() -> dict[str, str]:
    from loomlake.sources.bridges import CATALOG_SQL, LABELS_SQL

    cat = f"cat AS ({CATALOG_SQL.format('documents')})"
    lab = f"lab AS ({LABELS_SQL.format('documents')})"
    first = f"{lab}, fl AS (SELECT catalog_id, kind, value, arg_min(ordinal, ins) AS ordinal, arg_min(priority, ins) AS priority, min(ins) AS ins FROM lab GROUP BY catalog_id, kind, value)"
    titles = f"{first}, ti AS (SELECT catalog_id, kind, value AS title FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY priority DESC, ordinal DESC, ins DESC) AS r FROM fl) WHERE r = 1)"
    prev = f"{cat}, prev AS (SELECT * REPLACE (CASE WHEN catalog_id % 13 = 0 THEN size + 1 ELSE size END AS size) FROM cat WHERE {BEFORE}), cur AS (SELECT * FROM cat WHERE {NOW})"
    fold = "replace(lower({0}), 'ß', 'ss')"
    terms = ", ".join("('" + q + "')" for q in SEARCHES)
    given = ", ".join("('" + q + "')" for q in TITLES)
    diff = f"""{prev}, diff AS (
      SELECT root_id, relative_path, CASE WHEN p.catalog_id IS NULL THEN 'new' WHEN c.catalog_id IS NULL AND root_id = 'src3' THEN 'unchanged' WHEN c.catalog_id IS NULL THEN 'missing'
      WHEN p.size = c.size AND p.modified_ms = c.modified_ms THEN 'unchanged' ELSE 'changed' END AS state FROM prev p FULL JOIN cur c USING (root_id, relative_path))"""
    present = "dup AS (SELECT format, coalesce(native_id, filename_id) AS sid, count(*) AS n FROM cat WHERE status <> 'missing' AND coalesce(native_id, filename_id) IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"
    return {
        "a4_status_counts": f"WITH {cat} SELECT format, status, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM cat GROUP BY ALL",
        "a7_duplicate_ids": f"WITH {cat}, {present} SELECT * FROM dup",
        "c1_refreshed": f"WITH {diff} SELECT c.catalog_id, root_id, relative_path, c.size, c.status FROM cur c JOIN diff USING (root_id, relative_path) WHERE state IN ('new', 'changed') UNION ALL SELECT p.catalog_id, root_id, relative_path, p.size, CASE WHEN state = 'missing' THEN 'missing' ELSE p.status END FROM prev p JOIN diff USING (root_id, relative_path) WHERE state IN ('unchanged', 'missing')",
        "c4_search": f"""WITH {cat}, {lab}, q AS (SELECT * FROM (VALUES {terms}) AS t(query)), x AS (SELECT query, unnest(string_split({fold.format('query')}, ' ')) AS term FROM q),
          f AS (SELECT catalog_id, {fold.format('value')} AS v FROM lab),
          hit AS (SELECT DISTINCT x.query, x.term, cat.catalog_id FROM x JOIN cat ON contains(lower(coalesce(native_id, '')), term) OR contains(lower(coalesce(filename_id, '')), term)
                  UNION SELECT x.query, x.term, f.catalog_id FROM x JOIN f ON contains(v, term))
          SELECT query, catalog_id FROM hit GROUP BY query, catalog_id HAVING count(DISTINCT term) = (SELECT count(DISTINCT term) FROM x WHERE x.query = hit.query)""",
        "c5_resolved_titles": f"""WITH {titles}, q AS (SELECT DISTINCT title AS query FROM ti WHERE catalog_id % 20 = 0 UNION SELECT * FROM (VALUES {given}) AS g(query)),
          m AS (SELECT query, catalog_id, {fold.format('title')} = {fold.format('query')} AS exact FROM q JOIN ti ON contains({fold.format('title')}, {fold.format('query')})),
          n AS (SELECT query, count(*) FILTER (exact) AS e, count(*) AS p, min(catalog_id) FILTER (exact) AS ce, min(catalog_id) AS cp FROM m GROUP BY query)
          SELECT q.query, CASE WHEN e = 1 THEN ce WHEN e = 0 AND p = 1 THEN cp END AS catalog_id, CASE WHEN n.query IS NULL THEN 'no_match' WHEN e > 1 OR (e = 0 AND p > 1) THEN 'ambiguous' END AS error FROM q LEFT JOIN n ON n.query = q.query""",
        "c6_located": f"WITH {cat} SELECT native_id, CASE WHEN count(*) = 1 THEN min(catalog_id) END AS catalog_id, CASE WHEN count(*) > 1 THEN 'ambiguous' END AS error FROM cat WHERE native_id IS NOT NULL GROUP BY native_id",
        "c7_transferable": f"WITH {cat} SELECT catalog_id, status FROM cat WHERE status IN ('candidate', 'validated')",
        "f5_filtered": f"WITH {cat} SELECT catalog_id, format, modified_ms FROM cat WHERE format IN ('en', 'de') AND kind = 'main' AND modified_ms >= 1704067200000 + 20000000 AND modified_ms < 1704067200000 + 70000000",
        "g3_lineage_roots": f"WITH RECURSIVE {cat}, e AS (SELECT catalog_id AS child, parent_id AS parent FROM cat WHERE parent_id IS NOT NULL), w AS (SELECT child, parent, CAST(1 AS BIGINT) AS depth FROM e UNION ALL SELECT w.child, e.parent, w.depth + 1 FROM w JOIN e ON w.parent = e.child) SELECT child AS catalog_id, parent AS root_id, depth FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.child = w.parent)",
        "j5_native_labels": f"WITH {cat} SELECT catalog_id, concat('p', catalog_id) AS value FROM cat UNION ALL SELECT catalog_id, concat('i', min(catalog_id) OVER (PARTITION BY native_id)) FROM cat WHERE native_id IS NOT NULL",
        "j6_lineage": f"WITH {cat} SELECT c.catalog_id, c.kind, c.parent_id, p.format AS parent_format FROM cat c LEFT JOIN cat p ON c.parent_id = p.catalog_id",
        "j7_refresh_diff": f"WITH {diff} SELECT * FROM diff",
        "j8_copies": f"WITH {cat}, {present} SELECT catalog_id, coalesce(n, 1) AS copies FROM cat LEFT JOIN dup ON cat.format = dup.format AND coalesce(native_id, filename_id) = sid",
        "t1_display_titles": f"WITH {titles} SELECT * FROM ti",
        "t2_catalog_page": f"WITH {cat} SELECT catalog_id, modified_ms FROM cat ORDER BY modified_ms DESC, catalog_id LIMIT {LIMIT} OFFSET {OFFSET}",
        "u2_first_labels": f"WITH {first} SELECT * FROM fl",
        "u3_merged_roots": f"WITH {cat}, r AS (SELECT format, root_id AS path, CASE WHEN catalog_id % 2 = 0 THEN 'default' ELSE 'added' END AS source, CASE WHEN catalog_id % 3 = 0 THEN 0 ELSE 1 END AS rank FROM cat) SELECT format, path, arg_min(source, concat(rank, source)) AS source FROM r GROUP BY format, path",
    }


ORACLE = _sql()
