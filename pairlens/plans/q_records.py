"""Queries of the general training-data operators (p1 and p3), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import drift, envelopes
from pairlens.sources.tables import table


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "result_envelopes")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.nodes_found(_envelopes(spark, sf_dir))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.records(_envelopes(spark, sf_dir)).withColumn("elapsed_ms", F.col("elapsed_ms").cast("double"))


def p1_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.of_entity(_envelopes(spark, sf_dir), "answer", "answer", F.col("value").cast("double").alias("prob"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.of_entity(_envelopes(spark, sf_dir), "cluster", "cluster_index")


def p1_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.of_entity(_envelopes(spark, sf_dir), "member", "cluster_index", "member_index", F.col("value").cast("int").alias("member"))


def p1_cluster_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.of_entity(_envelopes(spark, sf_dir), "cluster_prob", "cluster_index", F.col("value").cast("double").alias("prob"))


def _drift(spark: SparkSession, sf_dir: str) -> drift.Drift:
    return drift.Drift(table(spark, sf_dir, "raw_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(_drift(spark, sf_dir)).select("file_name", "field_path", "change_kind")


def p3_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.lifespans(_drift(spark, sf_dir)).select("series_id", "path", "type", "first_n", "last_n", "files", "series_files")


def p3_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.aliases(drift.changes(_drift(spark, sf_dir)))


def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The producer of a series is its name without its number."""
    return drift.consistent(_drift(spark, sf_dir), F.regexp_replace("series_id", "_s[0-9]+$", ""))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_records, p1_answers, p1_clusters, p1_cluster_members, p1_cluster_probs,
    p3_found, p3_lifespans, p3_aliases, p3_consistent,
)}

_P1_RECORDS = """
WITH e AS (SELECT DISTINCT envelope_id, payload FROM result_envelopes WHERE json_valid(payload)),
j AS (SELECT envelope_id, CAST(payload AS JSON) AS p FROM e),
l AS (
  SELECT envelope_id, n AS list, json_extract(p, '$.' || n) AS v
  FROM j, (VALUES ('detailed_results'), ('prediction_differences')) AS names(n)
),
r AS (
  SELECT envelope_id, list, i, json_extract(v, '$[' || i || ']') AS rec
  FROM (SELECT envelope_id, list, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM l WHERE json_type(v) = 'ARRAY')
  UNION ALL
  SELECT envelope_id, list, 0, v FROM l WHERE json_type(v) = 'OBJECT'
),
records AS (SELECT envelope_id, list || '/' || i AS path, list, rec FROM r WHERE json_type(rec) = 'OBJECT'),
answers AS (
  SELECT envelope_id, path, k AS answer
  FROM (SELECT envelope_id, path, unnest(json_keys(json_extract(rec, '$.answer_probs'))) AS k FROM records WHERE json_type(json_extract(rec, '$.answer_probs')) = 'OBJECT')
  UNION
  SELECT envelope_id, path, x ->> 'answer'
  FROM (SELECT envelope_id, path, unnest(CAST(json_extract(rec, '$.answer_probs') AS JSON[])) AS x FROM records WHERE json_type(json_extract(rec, '$.answer_probs')) = 'ARRAY')
  WHERE x ->> 'answer' IS NOT NULL
),
clusters AS (
  SELECT envelope_id, path, i, json_extract(v, '$[' || i || ']') AS c
  FROM (SELECT envelope_id, path, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i
        FROM (SELECT envelope_id, path, json_extract(rec, '$.cluster_info.clusters') AS v FROM records) WHERE json_type(v) = 'ARRAY')
),
members AS (
  SELECT envelope_id, path, i, m, json_extract(c, '$[' || m || ']') AS x
  FROM (SELECT *, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS m FROM clusters WHERE json_type(c) = 'ARRAY')
),
probs AS (
  SELECT envelope_id, path, i, json_extract(v, '$[' || i || ']') AS x
  FROM (SELECT envelope_id, path, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i
        FROM (SELECT envelope_id, path, json_extract(rec, '$.cluster_info.cluster_probs') AS v FROM records) WHERE json_type(v) = 'ARRAY')
)
"""

_P3_CATALOGUE = """
WITH RECURSIVE raw AS (SELECT DISTINCT series_id, file_name, written_at, record_key, payload FROM raw_results WHERE series_id IS NOT NULL AND file_name IS NOT NULL),
files AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY w, file_name) AS n, count(*) OVER (PARTITION BY series_id) AS last FROM (SELECT series_id, file_name, min(written_at) AS w FROM raw GROUP BY 1, 2)),
ok AS (SELECT f.series_id, f.n, f.last, r.file_name, r.record_key, r.payload AS p FROM raw AS r JOIN files AS f USING (series_id, file_name) WHERE json_valid(r.payload) AND json_type(r.payload) = 'OBJECT'),
tree AS (
  SELECT o.series_id, o.n, o.last, o.file_name, o.record_key, substr(t.fullkey, 3) AS field_path, substr(t.path, 3) AS parent, t.type AS kind, t.value AS v
  FROM ok AS o, json_tree(o.p) AS t WHERE t.fullkey <> '$' AND t.type <> 'NULL' AND NOT regexp_matches(regexp_replace(t.fullkey, '"[^"]*"', '', 'g'), '\\[')
),
maps AS (
  SELECT DISTINCT series_id, field_path FROM tree
  WHERE kind = 'OBJECT' AND len(list_filter(json_keys(v), lambda k: NOT regexp_full_match(k, '[A-Za-z_][A-Za-z0-9_]*'))) > 0
    AND len(list_filter(json_keys(v), lambda k: json_type(v, '$."' || k || '"') NOT IN ('NULL', 'DOUBLE', 'UBIGINT', 'BIGINT'))) = 0
),
shaped AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN json_structure(v)::VARCHAR END AS shape FROM tree WHERE (series_id, parent) NOT IN (SELECT (series_id, field_path) FROM maps)),
cored AS (SELECT *, length(shape) - length(ltrim(shape, '[')) AS deep, ltrim(shape, '[') AS core FROM shaped),
fld AS (
  SELECT series_id, n, last, file_name, record_key, field_path, parent, v,
    CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
      WHEN 'ARRAY' THEN repeat('array<', deep) || CASE WHEN core LIKE '{%' THEN 'object' WHEN core LIKE '"VARCHAR"%' THEN 'string' WHEN core LIKE '"BOOLEAN"%' THEN 'boolean' WHEN core LIKE '"NULL"%' THEN 'void' WHEN core LIKE '"JSON"%' THEN 'mixed' ELSE 'number' END || repeat('>', deep)
      ELSE 'number' END AS type,
    CASE WHEN kind IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE v::VARCHAR END AS val
  FROM cored
),
cat AS (
  SELECT series_id, n, last, file_name, field_path AS path, parent, coalesce(string_agg(DISTINCT type, '|' ORDER BY type) FILTER (type NOT LIKE '%void%'), string_agg(DISTINCT type, '|' ORDER BY type)) AS type
  FROM fld GROUP BY 1, 2, 3, 4, 5, 6
)
"""

_P3_CHANGES = _P3_CATALOGUE + """,
step AS (SELECT *, lag(n) OVER w AS before, lag(type) OVER w AS old_type, lead(n) OVER w AS after FROM cat WINDOW w AS (PARTITION BY series_id, path ORDER BY n)),
starts AS (SELECT series_id, n, path, parent, type FROM step WHERE n > 1 AND coalesce(before, 0) <> n - 1),
ends AS (SELECT series_id, n + 1 AS n, path, parent, type FROM step WHERE n < last AND coalesce(after, 0) <> n + 1),
typed AS (SELECT series_id, n, path FROM step WHERE before = n - 1 AND type <> old_type AND NOT (type LIKE 'array%' AND old_type LIKE 'array%' AND (type LIKE '%void%' OR old_type LIKE '%void%'))),
pairs AS (
  SELECT s.series_id, s.n, s.path, e.path AS old_path FROM starts AS s JOIN ends AS e USING (series_id, n, parent)
  WHERE s.type = e.type OR (s.type LIKE 'array%' AND e.type LIKE 'array%' AND (s.type LIKE '%void%' OR e.type LIKE '%void%'))
),
recs AS (SELECT DISTINCT series_id, n, record_key FROM fld WHERE record_key IS NOT NULL),
common AS (SELECT a.series_id, a.n, a.record_key FROM recs AS a JOIN recs AS b ON b.series_id = a.series_id AND b.n = a.n - 1 AND b.record_key = a.record_key),
vals AS (SELECT DISTINCT series_id, n, record_key, field_path, val FROM fld WHERE record_key IS NOT NULL),
met AS (
  SELECT p.series_id, p.n, p.path, p.old_path, c.record_key, x.val AS new_val, y.val AS old_val
  FROM pairs AS p JOIN common AS c USING (series_id, n)
  LEFT JOIN vals AS x ON x.series_id = p.series_id AND x.n = p.n AND x.record_key = c.record_key AND x.field_path = p.path
  LEFT JOIN vals AS y ON y.series_id = p.series_id AND y.n = p.n - 1 AND y.record_key = c.record_key AND y.field_path = p.old_path
  WHERE x.val IS NOT NULL OR y.val IS NOT NULL
),
agree AS (SELECT series_id, n, path, old_path FROM met GROUP BY 1, 2, 3, 4 HAVING bool_and(coalesce(new_val = old_val, false))),
every AS (
  SELECT series_id, n, path, 'type_changed' AS change_kind FROM typed
  UNION ALL SELECT series_id, n, path, CASE WHEN (series_id, n, path) IN (SELECT (series_id, n, path) FROM agree) THEN 'renamed' ELSE 'added' END FROM starts
  UNION ALL SELECT series_id, n, path, CASE WHEN (series_id, n, path) IN (SELECT (series_id, n, old_path) FROM agree) THEN 'from' ELSE 'removed' END FROM ends
),
found AS (
  SELECT f.file_name, e.series_id, e.n, e.path AS field_path, e.change_kind FROM every AS e JOIN files AS f USING (series_id, n)
  WHERE change_kind <> 'from' AND NOT EXISTS (SELECT 1 FROM every AS a WHERE a.series_id = e.series_id AND a.n = e.n AND starts_with(e.path, a.path || '.'))
)
"""

_P3_ALIASES = _P3_CHANGES + """,
link AS (
  SELECT f.series_id, f.field_path AS path, arg_min(a.old_path, (f.n, a.old_path)) AS canonical, min(f.n) AS n
  FROM found AS f JOIN agree AS a ON a.series_id = f.series_id AND a.n = f.n AND a.path = f.field_path WHERE f.change_kind = 'renamed' GROUP BY 1, 2
),
chain AS (
  SELECT series_id, path, canonical, n, 1 AS steps FROM link
  UNION ALL SELECT c.series_id, c.path, l.canonical, l.n, steps + 1 FROM chain AS c JOIN link AS l ON l.series_id = c.series_id AND l.path = c.canonical AND l.n < c.n
),
alias AS (SELECT series_id, path, arg_max(canonical, steps) AS canonical FROM chain GROUP BY 1, 2)
"""

SQL = {
    "p1_found": _P1_RECORDS + """
SELECT envelope_id, path AS node_path FROM records
UNION ALL SELECT envelope_id, path || '/answer_probs/' || answer FROM answers
UNION ALL SELECT envelope_id, path || '/cluster_info/clusters/' || i FROM clusters WHERE json_type(c) <> 'NULL'
UNION ALL SELECT envelope_id, path || '/cluster_info/clusters/' || i || '/' || m FROM members WHERE json_type(x) <> 'NULL'
UNION ALL SELECT envelope_id, path || '/cluster_info/cluster_probs/' || i FROM probs WHERE json_type(x) <> 'NULL'
""",
    "p1_records": _P1_RECORDS + """
SELECT envelope_id, path AS node_path, list AS parent_path, rec ->> 'id' AS id, rec ->> 'sentence' AS sentence, rec ->> 'sampler' AS sampler,
       rec ->> 'predicted_answer' AS predicted_answer, rec ->> 'correct' AS correct, CAST(rec ->> 'elapsed_ms' AS DOUBLE) AS elapsed_ms
FROM records
""",
    "p1_answers": _P1_RECORDS + """
, each AS (
  SELECT envelope_id, records.path, e.key AS answer, TRY_CAST(e.value ->> '$' AS DOUBLE) AS prob
  FROM records, json_each(json_extract(rec, '$.answer_probs')) AS e WHERE json_type(json_extract(rec, '$.answer_probs')) = 'OBJECT'
  UNION ALL
  SELECT envelope_id, path, x ->> 'answer', TRY_CAST(x ->> 'prob' AS DOUBLE)
  FROM (SELECT envelope_id, path, unnest(CAST(json_extract(rec, '$.answer_probs') AS JSON[])) AS x FROM records WHERE json_type(json_extract(rec, '$.answer_probs')) = 'ARRAY')
  WHERE x ->> 'answer' IS NOT NULL
)
SELECT envelope_id, path || '/answer_probs/' || answer AS node_path, path AS parent_path, answer, max(prob) AS prob FROM each GROUP BY ALL
""",
    "p1_clusters": _P1_RECORDS + """
SELECT envelope_id, path || '/cluster_info/clusters/' || i AS node_path, path AS parent_path, CAST(i AS INT) AS cluster_index FROM clusters WHERE json_type(c) <> 'NULL'
""",
    "p1_cluster_members": _P1_RECORDS + """
SELECT envelope_id, path || '/cluster_info/clusters/' || i || '/' || m AS node_path, path || '/cluster_info/clusters/' || i AS parent_path,
       CAST(i AS INT) AS cluster_index, CAST(m AS INT) AS member_index, CAST(x AS INT) AS member
FROM members WHERE json_type(x) <> 'NULL'
""",
    "p1_cluster_probs": _P1_RECORDS + """
SELECT envelope_id, path || '/cluster_info/cluster_probs/' || i AS node_path, path AS parent_path, CAST(i AS INT) AS cluster_index, CAST(x AS DOUBLE) AS prob
FROM probs WHERE json_type(x) <> 'NULL'
""",
    "p3_found": _P3_CHANGES + " SELECT file_name, field_path, change_kind FROM found",
    "p3_lifespans": _P3_CATALOGUE + """,
marked AS (SELECT *, CASE WHEN lag(n) OVER w = n - 1 AND lag(type) OVER w = type THEN 0 ELSE 1 END AS new FROM cat WINDOW w AS (PARTITION BY series_id, path ORDER BY n)),
island AS (SELECT *, sum(new) OVER (PARTITION BY series_id, path ORDER BY n) AS i FROM marked)
SELECT series_id, path, any_value(type) AS type, CAST(min(n) AS INT) AS first_n, CAST(max(n) AS INT) AS last_n, count(*) AS files, max(last) AS series_files FROM island GROUP BY series_id, path, i
""",
    "p3_aliases": _P3_ALIASES + " SELECT series_id, path, canonical FROM alias",
    "p3_consistent": _P3_ALIASES + """,
named AS (
  SELECT DISTINCT regexp_replace(f.series_id, '_s[0-9]+$', '') AS producer, f.file_name, f.record_key, f.type, CASE WHEN f.type = 'string' THEN f.v ->> '$' ELSE array_to_string(list_transform(regexp_extract_all(f.v::VARCHAR, '"(?:[^"\\\\]|\\\\.)*"|-?[0-9.]+|[^"0-9-]+'), lambda t: CASE WHEN regexp_full_match(t, '-?0\\.0000[0-9]+') THEN CAST(CAST(t AS DOUBLE) AS VARCHAR) ELSE t END), '') END AS value,
    coalesce((SELECT arg_max(a.canonical || substr(f.field_path, length(a.path) + 1), length(a.path)) FROM alias AS a WHERE a.series_id = f.series_id AND (a.path = f.field_path OR starts_with(f.field_path, a.path || '.'))), f.field_path) AS field
  FROM fld AS f WHERE f.type <> 'object' OR f.v::VARCHAR = '{}' OR (f.series_id, f.field_path) IN (SELECT (series_id, field_path) FROM maps)
),
kinds AS (SELECT producer, field, count(DISTINCT type) AS n, any_value(type) AS one, bool_or(type LIKE 'array%' OR type = 'object') AS container FROM named WHERE type NOT LIKE '%void%' GROUP BY 1, 2)
SELECT file_name, record_key, field, coalesce(CASE WHEN n = 1 THEN one WHEN container THEN 'json' ELSE 'string' END, type) AS type,
  CASE WHEN type = 'string' AND n > 1 AND container THEN to_json(value)::VARCHAR ELSE value END AS value
FROM named LEFT JOIN kinds USING (producer, field)
""",
}
