"""Queries of the language-model data operators (p2, p4 to p8), with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import mixing, packing, pair_defects, percentiles, shared_spans, truncation
from pairlens.plans.durable import cut
from pairlens.sources.tables import table


TIMING = ("run_id", "sampler")


def _timings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "sampler_timings").where(percentiles.usable("elapsed_ms"))
    return percentiles.once(rows, "timing_id", *TIMING, *columns, "elapsed_ms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.skewed_groups(_timings(spark, sf_dir), TIMING, "elapsed_ms")


def _estimates(rows: DataFrame, keys: tuple[str, ...], percents: tuple[float, ...]) -> DataFrame:
    """Sketches per day, merged where ``keys`` have no day."""
    daily = percentiles.sketches(rows, (*TIMING, "run_day"), "elapsed_ms")
    return percentiles.estimates(daily if "run_day" in keys else percentiles.merge(daily, keys), keys, percents)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and upper percentiles per run and sampler, from sketches per day that are merged."""
    return _estimates(_timings(spark, sf_dir, "run_day"), TIMING, (50, 90, 95, 99, 99.9))


def p2_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(_timings(spark, sf_dir, "run_day"), (*TIMING, "run_day"), (50, 95))


def _within_error(spark: SparkSession, sf_dir: str, keys: tuple[str, ...], percents: tuple[float, ...]) -> DataFrame:
    """Exact percentiles, found from the estimates, and whether the estimates' intervals hold them."""
    rows = cut(_timings(spark, sf_dir, "run_day"))
    bounds = cut(_estimates(rows, keys, percents))
    found = percentiles.exact(rows, keys, "elapsed_ms", bounds, percents)
    ends = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.col(f"p{p:g}_lo").alias("lo"), F.col(f"p{p:g}_hi").alias("hi")) for p in percents])).alias("x")
    named = bounds.select(*keys, ends).select(*[F.col(k).alias(f"_{k}") for k in keys], "x.*").withColumnRenamed("percent", "_percent")
    met = found.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("percent") == F.col("_percent")])
    return met.select(*keys, "percent", "n", "value", F.col("value").between(F.col("lo"), F.col("hi")).alias("within"))


def p2_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within_error(spark, sf_dir, TIMING, (50, 95, 99))


def p2_daily_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within_error(spark, sf_dir, (*TIMING, "run_day"), (50, 95))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.pair_defects(table(spark, sf_dir, "detailed_results"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "detailed_results"))


def p5_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(table(spark, sf_dir, "detailed_results"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversize(_placed(spark, sf_dir))


def p6_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container how many were used and how full they are."""
    each = packing.bins(_placed(spark, sf_dir), table(spark, sf_dir, "container_specs"))
    return each.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("fill"))


def p6_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.accounts(_placed(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares().where("short").select("mix_id", "source")


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).chosen


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p7_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source what must hold: no document beyond its repeats, and the tokens asked for (or all there are) reached to 1 % or 100 tokens."""
    made = _mix(spark, sf_dir)
    most = made.chosen.groupBy("mix_id", "source").agg(F.max("copies").alias("most"))
    due = F.least(F.col("target_tokens"), F.col("max_repeats") * F.col("has_tokens"))
    rows = made.shares().join(most, ["mix_id", "source"], "left")
    near = F.abs(F.col("actual_tokens") - due) <= F.greatest(F.lit(100.0), 0.01 * due)
    return rows.select("mix_id", "source", "has_tokens", F.round("target_tokens", 3).alias("target_tokens"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("reached"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_pairs(table(spark, sf_dir, "documents"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_coverage(table(spark, sf_dir, "documents"))


def p8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_links(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_percentiles, p2_daily_percentiles, p2_within_error, p2_daily_within_error, p4_found, p5_found, p5_by_source, p6_found, p6_contents, p6_fill, p6_accounts, p7_found, p7_selection, p7_shares, p7_accounts, p8_found, p8_coverage, p8_links)}

_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]+'))"

_TIMINGS = """
WITH d AS (SELECT DISTINCT timing_id, run_id, sampler, run_day, elapsed_ms FROM sampler_timings WHERE isfinite(elapsed_ms) AND elapsed_ms > 0)
"""


def _exact_sql(keys: str, percents: tuple[float, ...]) -> str:
    return _TIMINGS + " UNION ALL ".join(f"SELECT {keys}, CAST({p} AS DOUBLE) AS percent, count(*) AS n, quantile_disc(elapsed_ms, {p / 100}) AS value, TRUE AS within FROM d GROUP BY {keys}" for p in percents)


SQL = {
    "p2_found": _TIMINGS + """
SELECT run_id, sampler FROM d GROUP BY run_id, sampler HAVING quantile_disc(elapsed_ms, 0.95) > 5 * quantile_disc(elapsed_ms, 0.5)
""",
    "p2_within_error": _exact_sql("run_id, sampler", (50, 95, 99)),
    "p2_daily_within_error": _exact_sql("run_id, sampler, run_day", (50, 95)),
    "p6_found": f"""
SELECT c.container_id, d.doc_id
FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents) AS d JOIN container_specs AS c ON d.tokens > c.capacity_tokens
""",
    "p6_accounts": f"""
SELECT c.container_id, count(*) AS documents, CAST(sum(d.tokens) AS BIGINT) AS tokens, 0 AS overfull, 0 AS split_in_vain, 0 AS broken
FROM (SELECT DISTINCT doc_id, {_TOKENS} AS tokens FROM documents) AS d, container_specs AS c GROUP BY c.container_id
""",
    "p7_accounts": f"""
WITH d AS (SELECT source, {_TOKENS} AS tokens FROM documents), s AS (SELECT source, sum(tokens) AS has FROM d GROUP BY source)
SELECT m.mix_id, m.source, CAST(coalesce(s.has, 0) AS BIGINT) AS has_tokens, round(m.weight * m.total_fraction * (SELECT sum(tokens) FROM d), 3) AS target_tokens, true AS within_repeats, true AS reached
FROM mix_targets AS m LEFT JOIN s ON s.source = m.source
""",
    "p7_found": f"""
WITH d AS (SELECT source, {_TOKENS} AS tokens FROM documents),
s AS (SELECT source, sum(tokens) AS has FROM d GROUP BY source)
SELECT m.mix_id, m.source
FROM mix_targets AS m LEFT JOIN s ON s.source = m.source
WHERE m.max_repeats * coalesce(s.has, 0) < m.weight * m.total_fraction * (SELECT sum(tokens) FROM d)
""",
    "p8_coverage": """
WITH t AS (SELECT doc_id, text, length(text) AS n, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) - 1 AS copies FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, substr(text, CAST(i AS BIGINT), 160) AS s FROM (SELECT doc_id, text, unnest(range(1, n - 158)) AS i FROM t WHERE n >= 160)),
few AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i, lead(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS next FROM w JOIN few USING (s)),
covered AS (SELECT doc_id, sum(least(160, coalesce(next - i, 160))) AS chars FROM hit GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_chars, CAST(coalesce(c.chars, 0) AS BIGINT) AS shared_chars, CASE WHEN t.n > 0 THEN coalesce(c.chars, 0) / CAST(t.n AS DOUBLE) ELSE 0 END AS shared_share, t.class_id, t.copies
FROM t LEFT JOIN covered AS c USING (doc_id)
""",
    "p8_found": """
WITH w AS (SELECT DISTINCT doc_id, substr(text, CAST(i AS BIGINT), 160) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE length(text) >= 160)),
few AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
FROM (SELECT w.* FROM w JOIN few USING (s)) AS a JOIN (SELECT w.* FROM w JOIN few USING (s)) AS b ON a.s = b.s AND a.doc_id < b.doc_id
""",
}
