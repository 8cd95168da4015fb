"""Queries of the general data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.common import table
from rasterloom.operators import compaction, drift, proximity, shredding


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.nearby(table(spark, d, "rois")).select("case_kind", "roi_id_1", "roi_id_2")


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    pairs = proximity.nearby(table(spark, d, "rois"))
    return pairs.groupBy("case_kind").agg(F.count("*").alias("n"), F.round(F.max("distance_m"), 3).alias("farthest_m"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.manifest_children(table(spark, d, "export_manifests"))


def _manifest(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shredding.manifest_tables(table(spark, d, "export_manifests"))[name]

    return query


def p3_meta(spark: SparkSession, d: str) -> DataFrame:
    return shredding.meta_nodes(table(spark, d, "model_results"))


def _meta(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shredding.meta_tables(table(spark, d, "model_results"))[name]

    return query


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files, _ = compaction.consolidate(table(spark, d, "export_files"))
    return compaction.record_keys(files)


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidate(table(spark, d, "export_files"))[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidate(table(spark, d, "export_files"))[1]


def p5_exports(spark: SparkSession, d: str) -> DataFrame:
    """What the consolidated files of each export hold together."""
    files, _ = compaction.consolidate(table(spark, d, "export_files"))
    return files.groupBy("export_id", "layout").agg(F.sum("n_records").alias("n_records"))


def p3_meta_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where the values of results' metas stand, and of which kind they are."""
    return shredding.meta_nodes(table(spark, d, "model_results")).select("result_id", "path", "kind", "label")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.file_texts(table(spark, d, "model_results")))


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.versions(drift.file_fields(drift.file_texts(table(spark, d, "model_results"))))


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(drift.file_records(table(spark, d, "model_results")))


def p6_lost(spark: SparkSession, d: str) -> DataFrame:
    return drift.lost_values(drift.unify(drift.file_records(table(spark, d, "model_results"))))


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_summary": p2_summary,
        "p3_found": p3_found,
        **{f"p3_{n}": _manifest(n) for n in ("exports", "spatials", "models", "points", "tiles", "frames", "issues")},
        "p3_meta": p3_meta,
        "p3_meta_paths": p3_meta_paths,
        **{f"p3_meta_{n}": _meta(n) for n in ("result", *(e.name for e in shredding.META))},
        "p5_found": p5_found,
        "p5_files": p5_files,
        "p5_report": p5_report,
        "p5_exports": p5_exports,
        "p6_found": p6_found,
        "p6_versions": p6_versions,
        "p6_unified": p6_unified,
        "p6_lost": p6_lost,
    }


_USABLE = """
pts AS (SELECT DISTINCT roi_id, lon, lat, buffer_m FROM rois WHERE kind = 'point_buffer' AND crs = 'EPSG:4326'
  AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND buffer_m > 0 AND NOT isnan(buffer_m)),
boxes AS (SELECT DISTINCT roi_id, minlon, minlat, maxlon, maxlat FROM rois WHERE kind = 'bbox' AND crs = 'EPSG:4326'
  AND minlon BETWEEN -180 AND 180 AND maxlon BETWEEN -180 AND 180 AND minlat BETWEEN -90 AND 90 AND maxlat BETWEEN -90 AND 90
  AND minlon < maxlon AND minlat < maxlat),
pairs AS (SELECT 'near' AS case_kind, a.roi_id AS i, b.roi_id AS j, 2 * 6371008.8 * asin(least(1.0, sqrt(
    pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS m,
    greatest(a.buffer_m, b.buffer_m) AS within
  FROM pts a JOIN pts b ON a.roi_id < b.roi_id AND abs(a.lat - b.lat) <= greatest(a.buffer_m, b.buffer_m) / 110000.0
  UNION ALL SELECT 'inside', p.roi_id, b.roi_id, NULL, NULL FROM pts p JOIN boxes b
  ON p.lon BETWEEN b.minlon AND b.maxlon AND p.lat BETWEEN b.minlat AND b.maxlat)"""


# What a manifest holds, level by level: a part given as text is opened, an entity's list may be an object or lone.
def _opened(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND left(ltrim({v}->>'$'), 1) IN ('{{', '[') AND json_valid({v}->>'$') THEN CAST({v}->>'$' AS JSON) ELSE {v} END"


_KEYED = "CASE WHEN k = 'models' THEN len(json_keys(c)) > 0 AND len(list_intersect(json_keys(c), ['model', 'metas', 'sensor'])) = 0 ELSE len(json_keys(c)) > 0 AND len(list_filter(json_keys(c), lambda x: NOT regexp_matches(x, '^[0-9]+$'))) = 0 END"
_CHILDREN = f"""
WITH RECURSIVE d AS (SELECT export_id, CAST(manifest AS JSON) AS v FROM (SELECT export_id, manifest, row_number() OVER (PARTITION BY export_id ORDER BY ingested_at) AS n FROM export_manifests WHERE export_id IS NOT NULL AND json_valid(manifest)) WHERE n = 1),
n AS (SELECT export_id, {_opened('v')} AS v, FALSE AS within, NULL::VARCHAR AS model, NULL::BIGINT AS point, NULL::VARCHAR AS kind, NULL::BIGINT AS pos FROM d
  UNION ALL SELECT export_id, v2, within2, model2, CASE WHEN ent = 'point' AND within THEN pos2 ELSE point END, ent, pos2 FROM (
    SELECT *, within OR ent = 'model' AS within2, CASE WHEN ent = 'model' THEN coalesce(CASE WHEN json_type(v2, '$.model') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN v2->>'$.model' END, key2) ELSE model END AS model2 FROM (
      SELECT *, {_opened('u.e')} AS v2, u.i AS pos2, u.key AS key2, CASE WHEN json_type({_opened('u.e')}) = 'OBJECT' AND listed THEN CASE k WHEN 'models' THEN 'model' WHEN 'metas' THEN 'point' WHEN 'tiles' THEN 'tile' WHEN 'frames' THEN 'frame' WHEN 'issues' THEN 'issue' ELSE 'other' END END AS ent FROM (
        SELECT *, unnest(CASE WHEN NOT listed THEN [{{'i': NULL::BIGINT, 'key': NULL::VARCHAR, 'e': c}}] WHEN json_type(c) = 'ARRAY' THEN list_transform(range(json_array_length(c)::BIGINT), lambda i: {{'i': i, 'key': NULL::VARCHAR, 'e': json_extract(c, '$[' || i || ']')}})
            WHEN {_KEYED} THEN list_transform(range(len(json_keys(c))), lambda i: {{'i': coalesce(TRY_CAST(json_keys(c)[i + 1] AS BIGINT), i), 'key': json_keys(c)[i + 1], 'e': json_extract(c, '$."' || json_keys(c)[i + 1] || '"')}})
            ELSE [{{'i': 0::BIGINT, 'key': NULL::VARCHAR, 'e': c}}] END) AS u FROM (
          SELECT export_id, within, model, point, t.k AS k, {_opened('t.c')} AS c, coalesce(t.k IN ('models', 'metas', 'tiles', 'frames', 'issues', 'spatials'), FALSE) AND json_type({_opened('t.c')}) IN ('ARRAY', 'OBJECT') AS listed FROM (
            SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda x: {{'k': x, 'c': json_extract(v, '$."' || x || '"')}}) ELSE list_transform(range(json_array_length(v)::BIGINT), lambda i: {{'k': NULL::VARCHAR, 'c': json_extract(v, '$[' || i || ']')}}) END) AS t FROM n WHERE json_type(v) IN ('OBJECT', 'ARRAY'))))) WHERE json_type(v2) IN ('OBJECT', 'ARRAY'))) """
# Fields of the files of a feed, and what has changed from one to the next.
_FIELDS = r"""
w AS (SELECT feed, file_no, '' AS path, CAST(meta AS JSON) AS v FROM model_results WHERE result_id IS NOT NULL AND feed IS NOT NULL AND file_no IS NOT NULL AND json_valid(meta) AND json_type(meta) = 'OBJECT'
  UNION ALL SELECT feed, file_no, CASE WHEN path = '' THEN k ELSE path || '.' || k END, c FROM (SELECT *, json_extract(v, '$."' || k || '"') AS c FROM (SELECT *, unnest(json_keys(v)) AS k FROM w WHERE json_type(v) = 'OBJECT')) WHERE json_type(c) <> 'NULL'),
kinds AS (SELECT DISTINCT feed, file_no, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM w WHERE path <> ''),
f AS (SELECT feed, file_no, path, string_agg(kind, '|' ORDER BY kind) AS types, regexp_extract(path, '^(.*)\.[^.]*$', 1) AS parent FROM kinds GROUP BY 1, 2, 3),
files AS (SELECT DISTINCT feed, file_no FROM model_results WHERE result_id IS NOT NULL AND feed IS NOT NULL AND file_no IS NOT NULL)"""
_CHANGES = f"""WITH RECURSIVE {_FIELDS}, pairs AS (SELECT a.feed, a.file_no FROM files a JOIN files b ON a.feed = b.feed AND b.file_no = a.file_no - 1),
x AS (SELECT p.feed, p.file_no, coalesce(n.path, o.path) AS path, n.types AS now, o.types AS was, coalesce(n.parent, o.parent) AS parent FROM pairs p
  JOIN (SELECT feed, file_no, path FROM f UNION SELECT feed, file_no + 1, path FROM f) a ON a.feed = p.feed AND a.file_no = p.file_no
  LEFT JOIN f n ON n.feed = p.feed AND n.file_no = p.file_no AND n.path = a.path LEFT JOIN f o ON o.feed = p.feed AND o.file_no = p.file_no - 1 AND o.path = a.path WHERE n.types IS DISTINCT FROM o.types),
y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x up WHERE up.feed = x.feed AND up.file_no = x.file_no AND starts_with(x.path, up.path || '.'))),
vals AS (SELECT DISTINCT feed, file_no, path, CASE json_type(v) WHEN 'VARCHAR' THEN 's' || (v->>'$') WHEN 'OBJECT' THEN CAST(v AS VARCHAR) WHEN 'ARRAY' THEN CAST(v AS VARCHAR) WHEN 'BOOLEAN' THEN CAST(v AS VARCHAR) ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END AS value FROM w),
ren AS (SELECT DISTINCT g.feed, g.file_no, g.path AS field, n.path AS new_field FROM y g JOIN y n ON g.feed = n.feed AND g.file_no = n.file_no AND g.parent = n.parent AND g.was = n.now AND g.now IS NULL AND n.was IS NULL
  JOIN vals a ON a.feed = g.feed AND a.file_no = g.file_no - 1 AND a.path = g.path JOIN vals b ON b.feed = n.feed AND b.file_no = n.file_no AND b.path = n.path AND a.value = b.value)
SELECT feed, file_no, 'renamed' AS change_kind, field, new_field FROM ren UNION ALL
SELECT feed, file_no, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'retyped' END, path, '' FROM y
WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = y.feed AND r.file_no = y.file_no AND (r.field = y.path AND now IS NULL OR r.new_field = y.path AND was IS NULL))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _CHILDREN + "SELECT DISTINCT export_id, model, CAST(point AS INTEGER) AS point_index, kind AS child_kind, CAST(pos AS INTEGER) AS child_pos FROM n WHERE kind IN ('tile', 'frame', 'issue') AND point IS NOT NULL",
        "p6_found": _CHANGES,
        "p3_meta_paths": f"""WITH RECURSIVE r AS (SELECT result_id, CAST(meta AS JSON) AS v FROM (SELECT result_id, meta, row_number() OVER (PARTITION BY result_id ORDER BY json_valid(meta) DESC, ingested_at) AS n FROM model_results WHERE result_id IS NOT NULL) WHERE n = 1 AND json_valid(meta) AND meta <> ''),
n AS (SELECT result_id, '' AS path, NULL::VARCHAR AS label, {_opened('v')} AS v FROM r WHERE json_type({_opened('v')}) IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT result_id, CASE WHEN t.k IS NULL THEN path || '[' || t.i || ']' WHEN path = '' THEN t.k ELSE path || '.' || t.k END, coalesce(t.k, label), {_opened('t.c')} FROM (
    SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda x: {{'k': x, 'i': NULL::BIGINT, 'c': json_extract(v, '$."' || x || '"')}}) ELSE list_transform(range(json_array_length(v)::BIGINT), lambda i: {{'k': NULL::VARCHAR, 'i': i, 'c': json_extract(v, '$[' || i || ']')}}) END) AS t FROM n WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
SELECT result_id, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, label FROM n""",
        "p5_exports": r"""
WITH f AS (SELECT layout, payload FROM export_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY written_at) = 1),
r AS (SELECT nullif(regexp_replace(lower(trim(layout)), '[\s-]+', '_', 'g'), '') AS layout, unnest(regexp_extract_all(payload, '\{[^{}]*\}')) AS t FROM f),
k AS (SELECT CAST(t->>'export_id' AS BIGINT) AS export_id, CAST(t->>'point_index' AS INTEGER) AS point_index, t->>'model' AS model, max(layout) AS layout FROM r
  WHERE json_valid(t) AND json_type(t, '$.export_id') IS NOT NULL AND json_type(t, '$.point_index') IS NOT NULL AND json_type(t, '$.model') = 'VARCHAR' GROUP BY 1, 2, 3),
m AS (SELECT export_id, layout FROM (SELECT export_id, layout, row_number() OVER (PARTITION BY export_id ORDER BY count(*) DESC, layout) AS n FROM k WHERE layout IS NOT NULL GROUP BY 1, 2) WHERE n = 1)
SELECT k.export_id, m.layout, count(*) AS n_records FROM k LEFT JOIN m USING (export_id) GROUP BY 1, 2""",
        "p6_versions": f"""WITH RECURSIVE {_FIELDS}, p AS (SELECT i.feed, i.file_no, md5(coalesce(chr(10) || string_agg(path || ':' || types, chr(10) ORDER BY path || ':' || types), '')) AS fingerprint FROM files i LEFT JOIN f USING (feed, file_no) GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN lag(fingerprint) OVER q = fingerprint THEN 0 ELSE 1 END AS step FROM p WINDOW q AS (PARTITION BY feed ORDER BY file_no)) SELECT feed, file_no, fingerprint, CAST(sum(step) OVER (PARTITION BY feed ORDER BY file_no) AS INTEGER) AS version FROM s""",
        "p2_found": f"WITH {_USABLE} SELECT case_kind, least(i, j) AS roi_id_1, greatest(i, j) AS roi_id_2 FROM pairs WHERE case_kind = 'inside' OR m <= within",
        "p2_summary": f"WITH {_USABLE} SELECT case_kind, count(*) AS n, round(max(m), 3) AS farthest_m FROM pairs WHERE case_kind = 'inside' OR m <= within GROUP BY 1",
        "p5_found": r"""
WITH r AS (SELECT unnest(regexp_extract_all(payload, '\{[^{}]*\}')) AS t FROM export_files)
SELECT DISTINCT CAST(t->>'export_id' AS BIGINT) AS export_id, CAST(t->>'point_index' AS INTEGER) AS point_index, t->>'model' AS model
FROM r WHERE json_valid(t) AND json_type(t, '$.export_id') IS NOT NULL AND json_type(t, '$.point_index') IS NOT NULL AND json_type(t, '$.model') = 'VARCHAR'""",
    }
