"""Queries of evaluation, significance and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions import statistics as st
from pairlens.operators import cluster_aware as ca
from pairlens.operators import samplers
from pairlens.operators import evaluation as ev
from pairlens.operators import logits as lg
from pairlens.operators import comparison
from pairlens.operators import significance as sig
from pairlens.plans import relations as rel
from pairlens.plans.q_selection import u_sql
from pairlens.plans.durable import cut
from pairlens.sources import results as rs
from pairlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAMES = ["greedy", "top_p", "dcbs", "random"]
TOP = "QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(c: Column | str, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


SPEC = ca.ClusterSpec(method="dbscan", epsilon=rel.EPSILON)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per context and sampler, with its probability and rank among all tokens of the context."""
    full = lg.softmax(rel.logits(spark, sf_dir), name="p_full")
    aware = ca.select(full, rel.vocabulary(spark, sf_dir), SPEC, carry=("p_full", "rank"))
    return samplers.decide(rel.logits(spark, sf_dir)).unionByName(aware.select("ctx_id", "sampler", "token_id", F.col("p_full").alias("p"), "rank"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks with label and verdict: right is a token whose label is the context's last digit."""
    labels = rel.vectors(spark, sf_dir).select("token_id", "label")
    return picks(spark, sf_dir).join(labels, "token_id", "left").withColumn("correct", F.col("label") == F.pmod("ctx_id", F.lit(10)))


def _draw(source: str, stream: str) -> str:
    return f"""SELECT ctx_id, coalesce(min(token_id) FILTER (cum > {u_sql(stream)} * total), max(token_id)) AS token_id
  FROM (SELECT *, sum(p) OVER (PARTITION BY ctx_id ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(p) OVER (PARTITION BY ctx_id) AS total FROM {source}) GROUP BY ctx_id"""


RES = f"""WITH RECURSIVE {rel.logits_sql()}, {rel.VOCABULARY_SQL}, {rel.edges_sql()}, {rel.dynamic_sql()}, {rel.clusters_sql()}, {rel.picked_sql(rel.CONFIDENCE_SQL)},
{rel.softmax_sql('logits', 'full_p')},
nucleus AS (SELECT ctx_id, token_id, p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM full_p) WHERE before <= 0.9),
one AS (SELECT ctx_id, token_id, 1.0 AS p FROM logits),
picks AS (
  SELECT ctx_id, 'greedy' AS sampler, token_id FROM (SELECT * FROM logits {TOP} = 1)
  UNION ALL SELECT ctx_id, 'top_p', token_id FROM ({_draw('nucleus', 'top_p')})
  UNION ALL SELECT ctx_id, 'random', token_id FROM ({_draw('one', 'random')})
  UNION ALL SELECT ctx_id, 'dcbs', token_id FROM picked
),
results AS (SELECT p.ctx_id, p.sampler, p.token_id, v.label, v.label = p.ctx_id % 10 AS correct FROM picks AS p LEFT JOIN vocab AS v ON v.token_id = p.token_id)"""
ACC = RES + """,
acc AS (SELECT sampler, count(*) AS total, count(*) FILTER (correct) AS correct FROM results GROUP BY sampler),
ci AS (SELECT *, 100.0 * correct / total AS accuracy, correct / CAST(total AS DOUBLE) AS p, 1.96 AS z FROM acc),
wilson AS (SELECT sampler, total, correct, accuracy,
  greatest(0, least(100, (p + z * z / (2 * total) - z * sqrt((p * (1 - p) + z * z / (4 * total)) / total)) / (1 + z * z / total) * 100)) AS ci_low,
  greatest(0, least(100, (p + z * z / (2 * total) + z * sqrt((p * (1 - p) + z * z / (4 * total)) / total)) / (1 + z * z / total) * 100)) AS ci_high FROM ci)"""
PAIRS = RES + """,
names AS (SELECT * FROM (VALUES (1, 'greedy'), (2, 'top_p'), (3, 'dcbs'), (4, 'random')) AS t(pos, name)),
pairs AS (
  SELECT a.ctx_id, x.name AS method1, y.name AS method2, CAST(a.correct AS INT) AS x1, CAST(b.correct AS INT) AS x2
  FROM names AS x JOIN names AS y ON x.pos < y.pos JOIN results AS a ON a.sampler = x.name JOIN results AS b ON b.sampler = y.name AND b.ctx_id = a.ctx_id
),
counts AS (SELECT method1, method2, CAST(sum(x1) AS BIGINT) AS c1, CAST(sum(x2) AS BIGINT) AS c2, count(*) AS n FROM pairs GROUP BY 1, 2)"""
FISHER = PAIRS + """,
grid AS (SELECT method1, method2, c1, n, c1 + c2 AS k, unnest(range(greatest(0, c1 + c2 - n), least(c1 + c2, n) + 1)) AS i FROM counts),
w AS (SELECT *, -(lgamma(i + 1) + lgamma(n - i + 1) + lgamma(k - i + 1) + lgamma(n - k + i + 1)) AS w FROM grid),
q AS (SELECT *, exp(w - max(w) OVER (PARTITION BY method1, method2)) AS q FROM w),
s AS (SELECT *, max(q) FILTER (i = c1) OVER (PARTITION BY method1, method2) AS seen FROM q),
fisher AS (SELECT method1, method2, least(1.0, coalesce(sum(q) FILTER (q <= seen * (1 + 1e-7)), 0) / sum(q)) AS p FROM s GROUP BY 1, 2)"""


@query(RES + f""" SELECT r.ctx_id, r.sampler, r.token_id, r.label, r.correct, round(f.p, 6) AS p FROM results AS r JOIN full_p AS f USING (ctx_id, token_id)""")
def detailed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("ctx_id", "sampler", "token_id", "label", "correct", _r("p"))


@query(ACC + " SELECT sampler, total, correct, round(accuracy, 6) AS accuracy FROM wilson")
def sampler_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy(results(spark, sf_dir)).select("sampler", "total", "correct", _r("accuracy"))


@query(ACC + " SELECT sampler, round(accuracy, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM wilson")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy(results(spark, sf_dir)).select("sampler", _r("accuracy"), _r("ci_low"), _r("ci_high"))


@query(f"WITH {rel.logits_sql()}, {rel.allowed_sql()}, {rel.softmax_sql('allowed')} SELECT ctx_id, token_id, round(p, 6) AS p, CAST(row_number() OVER (PARTITION BY ctx_id ORDER BY p DESC, token_id) AS INT) AS rank FROM soft")
def answer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    ranked = F.row_number().over(lg.ctx().orderBy(F.desc("p"), "token_id"))
    return lg.softmax(lg.allow(rows, rel.allowed(rows))).select("ctx_id", "token_id", _r("p"), ranked.alias("rank"))


@query(f"WITH {rel.logits_sql(5.0)}, {rel.softmax_sql('logits')}, m AS (SELECT ctx_id, max(p) AS p FROM soft GROUP BY 1) SELECT CASE WHEN p > 0.95 THEN 'VERY HIGH' WHEN p > 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS contexts, round(avg(p), 6) AS mean_p FROM m GROUP BY 1")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lg.softmax(rel.logits(spark, sf_dir, 5.0)).groupBy("ctx_id").agg(F.max("p").alias("p"))
    return top.groupBy(ev.tier(F.col("p")).alias("tier")).agg(F.count("*").alias("contexts"), _r(F.avg("p"), "mean_p"))


RATIO = RES + """,
ranked AS (SELECT ctx_id, token_id, p, row_number() OVER (PARTITION BY ctx_id ORDER BY p DESC, token_id) AS rank FROM full_p),
ratio AS (
  SELECT g.ctx_id, g.token_id AS greedy_token, d.token_id AS dcbs_token, g.p / d.p AS ratio, d.rank AS dcbs_rank
  FROM (SELECT r.* , k.p, k.rank FROM results AS r JOIN ranked AS k USING (ctx_id, token_id) WHERE sampler = 'greedy') AS g
  JOIN (SELECT r.*, k.p, k.rank FROM results AS r JOIN ranked AS k USING (ctx_id, token_id) WHERE sampler = 'dcbs') AS d ON d.ctx_id = g.ctx_id AND d.token_id <> g.token_id
)"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.struct("token_id", "p", "rank")
    both = picks(spark, sf_dir).where(F.col("sampler").isin("greedy", "dcbs")).groupBy("ctx_id").agg(
        F.max(F.when(F.col("sampler") == "greedy", of)).alias("g"), F.max(F.when(F.col("sampler") == "dcbs", of)).alias("d"))
    ratio = F.when(F.col("d.p") > 0, F.col("g.p") / F.col("d.p")).otherwise(F.lit(float("inf")))
    return both.where(F.col("g.token_id") != F.col("d.token_id")).select("ctx_id", F.col("g.token_id").alias("greedy_token"), F.col("d.token_id").alias("dcbs_token"), ratio.alias("ratio"), F.col("d.rank").alias("dcbs_rank"))


@query(RATIO + " SELECT ctx_id, greedy_token, dcbs_token, round(ratio, 6) AS ratio, CAST(dcbs_rank AS INT) AS dcbs_rank FROM ratio")
def prob_ratio_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).withColumn("ratio", F.round("ratio", 6))


@query(RATIO + " SELECT CASE WHEN ratio > 10 THEN 'strong' WHEN ratio > 3 THEN 'moderate' ELSE 'weak' END AS override, count(*) AS contexts FROM ratio GROUP BY 1")
def override_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("ratio") > 10, "strong").when(F.col("ratio") > 3, "moderate").otherwise("weak")
    return _ratios(spark, sf_dir).groupBy(kind.alias("override")).agg(F.count("*").alias("contexts"))


DIFF = RES + """,
diff AS (
  SELECT g.ctx_id, g.token_id AS greedy_token, d.token_id AS dcbs_token, g.correct AS greedy_correct, d.correct AS dcbs_correct,
         CASE WHEN g.correct AND d.correct THEN 'both_correct' WHEN g.correct THEN 'greedy_wins' WHEN d.correct THEN 'dcbs_wins' ELSE 'both_wrong' END AS outcome
  FROM results AS g JOIN results AS d ON d.ctx_id = g.ctx_id AND d.sampler = 'dcbs' AND d.token_id <> g.token_id WHERE g.sampler = 'greedy'
)"""


@query(DIFF + " SELECT * FROM diff")
def prediction_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.differences(results(spark, sf_dir))


@query(RES + """ SELECT count(*) AS contexts, count(*) FILTER (g.token_id <> d.token_id) AS differing, round(100.0 * count(*) FILTER (g.token_id <> d.token_id) / count(*), 6) AS divergence_pct
FROM results AS g JOIN results AS d ON d.ctx_id = g.ctx_id AND d.sampler = 'dcbs' WHERE g.sampler = 'greedy'""")
def divergence_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.divergence(picks(spark, sf_dir)).withColumn("divergence_pct", F.round("divergence_pct", 6))


@query(DIFF + " SELECT outcome, count(*) AS contexts FROM diff GROUP BY outcome")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.differences(results(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("contexts"))


@query(DIFF + """ SELECT outcome, count(*) AS contexts, round(avg(g.p), 6) AS mean_greedy_p, round(avg(c.p), 6) AS mean_dcbs_p
FROM diff AS d JOIN full_p AS g ON g.ctx_id = d.ctx_id AND g.token_id = d.greedy_token JOIN full_p AS c ON c.ctx_id = d.ctx_id AND c.token_id = d.dcbs_token GROUP BY outcome""")
def conditional_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.differences(results(spark, sf_dir), "greedy", "dcbs", "p")
    return rows.groupBy("outcome").agg(F.count("*").alias("contexts"), _r(F.avg("greedy_p"), "mean_greedy_p"), _r(F.avg("dcbs_p"), "mean_dcbs_p"))


@query(DIFF + """ SELECT count(*) FILTER (outcome = 'dcbs_wins') AS dcbs_wins, count(*) FILTER (outcome = 'greedy_wins') AS greedy_wins,
round(100.0 * count(*) FILTER (outcome = 'dcbs_wins') / nullif(count(*) FILTER (outcome IN ('dcbs_wins', 'greedy_wins')), 0), 6) AS dcbs_win_pct FROM diff""")
def decisive_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.decisive(ev.differences(results(spark, sf_dir))).withColumn("dcbs_win_pct", F.round("dcbs_win_pct", 6))


@query(DIFF + """, k AS (SELECT f.* FROM full_p AS f JOIN diff USING (ctx_id) QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY p DESC, token_id) <= 10)
SELECT ctx_id, string_agg(token_id || ':' || printf('%.4f', p), ',' ORDER BY p DESC, token_id) AS top FROM k GROUP BY ctx_id""")
def topk_on_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likeliest tokens of the contexts on which two samplers differ."""
    where = ev.differences(picks(spark, sf_dir).withColumn("correct", F.lit(False))).select("ctx_id")
    return ev.likeliest(lg.softmax(rel.logits(spark, sf_dir)).join(where, "ctx_id", "left_semi"))


COMPARED = ("arc_easy", "arc_challenge", "hellaswag", "mmlu_stem")


@query(RES + f"""SELECT CAST({list(COMPARED)}[ctx_id % 4 + 1] AS VARCHAR) AS dataset, 'dbscan' AS method, sampler, count(*) AS total, count(*) FILTER (correct) AS correct,
round(100.0 * count(*) FILTER (correct) / count(*), 6) AS accuracy FROM results WHERE sampler IN ('greedy', 'dcbs') GROUP BY ALL""".replace("token_id)SELECT", "token_id) SELECT"))
def comprehensive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset (here a quarter of the contexts) with each clustering method and sampler."""
    names = F.array(*map(F.lit, COMPARED))
    rows = rel.logits(spark, sf_dir)
    gold = rel.vectors(spark, sf_dir).select("token_id", "label")
    done = comparison.run(rows, rel.vocabulary(spark, sf_dir), {"dbscan": SPEC}, ["greedy"])
    judged = done.join(gold, "token_id", "left").select(F.element_at(names, (F.pmod("ctx_id", F.lit(4)) + 1).cast("int")).alias("dataset"), "method", "sampler", (F.col("label") == F.pmod("ctx_id", F.lit(10))).alias("correct"))
    return comparison.summary(judged).withColumn("accuracy", F.round("accuracy", 6))


@query(RES + " SELECT ctx_id, sampler, token_id FROM results WHERE NOT (ctx_id % 3 = 0 AND sampler IN ('greedy', 'dcbs'))")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the work after a run that finished a third of the contexts for two samplers."""
    done = rel.logits(spark, sf_dir).select("ctx_id").distinct().where(F.pmod("ctx_id", F.lit(3)) == 0).select("ctx_id", F.explode(F.array(F.lit("greedy"), F.lit("dcbs"))).alias("sampler"))
    return ev.remaining(results(spark, sf_dir).select("ctx_id", "sampler", "token_id"), done)


@query(RES + " SELECT sampler, coalesce(CAST(label AS VARCHAR), 'all') AS label, count(*) AS total, count(*) FILTER (correct) AS correct FROM results GROUP BY GROUPING SETS ((sampler, label), (sampler))")
def accuracy_by_label_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).rollup("sampler", "label").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return rows.where("sampler IS NOT NULL").withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("all")))


@query(PAIRS + """, d AS (SELECT method1, method2, count(*) AS n, avg(x1 - x2) AS m, stddev_samp(x1 - x2) AS sd FROM pairs GROUP BY 1, 2)
SELECT method1, method2, n, round(m, 6) AS mean_diff, round(CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END, 6) AS t, round(m - 1.96 * sd / sqrt(n), 6) AS ci_low, round(m + 1.96 * sd / sqrt(n), 6) AS ci_high FROM d""")
def paired_t_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.paired_t(sig.paired(results(spark, sf_dir), NAMES)).select("method1", "method2", "n", _r("mean_diff"), _r("t"), _r("ci_low"), _r("ci_high"))


def _upper_sql(density: str, rows: str, x: str = "x", steps: int = 4000) -> str:
    """Two-sided p-values by Simpson's rule: 1 minus twice the area of ``density`` (of u and the row) from 0 to |x|."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT greatest(0.0, 1 - 2 * abs({x}) / (3.0 * {steps}) * sum({weight} * {density.replace('{u}', f'(abs({x}) * i / {steps}.0)')})) FROM range({steps + 1}) AS g(i))"


T_DENSITY = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(pi() * df) - (df + 1) / 2.0 * ln(1 + {u} * {u} / df))"
N_DENSITY = "exp(-{u} * {u} / 2) / sqrt(2 * pi())"


@query(PAIRS + f""", d AS (SELECT method1, method2, count(*) AS n, avg(x1 - x2) AS m, stddev_samp(x1 - x2) AS sd FROM pairs GROUP BY 1, 2),
t AS (SELECT method1, method2, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END AS x, n - 1 AS df FROM d), p AS (SELECT *, {_upper_sql(T_DENSITY, 't')} AS p FROM t)
SELECT method1, method2, round(x, 6) AS t, df, round(p, 6) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p""")
def paired_t_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sig.paired_t(sig.paired(results(spark, sf_dir), NAMES)).withColumn("p_value", st.student_two_sided("t", "df"))
    return rows.select("method1", "method2", _r("t"), "df", _r("p_value"), st.stars(F.col("p_value")).alias("stars"))


@query(PAIRS + """, m AS (SELECT method1, method2, count(*) FILTER (x1 = 1 AND x2 = 0) AS b, count(*) FILTER (x1 = 0 AND x2 = 1) AS c FROM pairs GROUP BY 1, 2)
SELECT method1, method2, b, c, round(CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0 END, 6) AS statistic, round(CASE WHEN c > 0 THEN CAST(b AS DOUBLE) / c ELSE 'infinity'::DOUBLE END, 6) AS odds FROM m""")
def mcnemar_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.mcnemar(sig.paired(results(spark, sf_dir), NAMES)).select("method1", "method2", "b", "c", _r("statistic"), _r("odds"))


@query(PAIRS + f""", m AS (SELECT method1, method2, count(*) FILTER (x1 = 1 AND x2 = 0) AS b, count(*) FILTER (x1 = 0 AND x2 = 1) AS c FROM pairs GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0 END AS statistic FROM m), x AS (SELECT *, sqrt(statistic) AS x FROM q)
SELECT method1, method2, round(statistic, 6) AS statistic, round({_upper_sql(N_DENSITY, 'x')}, 6) AS p_value FROM x""")
def mcnemar_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sig.mcnemar(sig.paired(results(spark, sf_dir), NAMES))
    return rows.select("method1", "method2", _r("statistic"), _r(st.chi2_1_upper("statistic"), "p_value"))


Z = "CASE WHEN c1 + c2 > 0 AND c1 + c2 < 2 * n THEN (CAST(c1 AS DOUBLE) / n - CAST(c2 AS DOUBLE) / n) / sqrt((c1 + c2) / (2.0 * n) * (1 - (c1 + c2) / (2.0 * n)) * 2 / n) ELSE 0 END"
D = "CASE WHEN c1 + c2 > 0 AND c1 + c2 < 2 * n THEN (CAST(c1 AS DOUBLE) / n - CAST(c2 AS DOUBLE) / n) / sqrt((c1 + c2) / (2.0 * n) * (1 - (c1 + c2) / (2.0 * n))) ELSE 0 END"


@query(PAIRS + f" SELECT method1, method2, c1, c2, n, round({Z}, 6) AS z FROM counts")
def two_prop_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.two_proportion_z(sig.counts(sig.paired(results(spark, sf_dir), NAMES))).select("method1", "method2", "c1", "c2", "n", _r("z"))


@query(PAIRS + f""", d AS (SELECT *, {D} AS d FROM counts)
SELECT method1, method2, round(d, 6) AS d, round(d - 1.96 * sqrt(2.0 / n + d * d / (4 * n)), 6) AS d_low, round(d + 1.96 * sqrt(2.0 / n + d * d / (4 * n)), 6) AS d_high,
       CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.effect(sig.counts(sig.paired(results(spark, sf_dir), NAMES))).select("method1", "method2", _r("d"), _r("d_low"), _r("d_high"), "effect")


def _fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.fisher(sig.counts(sig.paired(results(spark, sf_dir), NAMES)))


TIER = "CASE WHEN p < 0.001 THEN 'very strong' WHEN p < 0.01 THEN 'strong' WHEN p < 0.05 THEN 'significant' WHEN p < 0.1 THEN 'marginal' ELSE 'none' END"


@query(FISHER + f" SELECT method1, method2, round(p, 6) AS p_fisher, {TIER} AS evidence FROM fisher")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fisher(spark, sf_dir).select("method1", "method2", _r("p_fisher"), st.evidence_tier(F.col("p_fisher")).alias("evidence"))


@query(FISHER + """, h AS (SELECT *, row_number() OVER (ORDER BY p, method1, method2) AS i, count(*) OVER () AS m FROM fisher)
SELECT method1, method2, round(max(least(1.0, p * (m - i + 1))) OVER (ORDER BY p, method1, method2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM h""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.corrected(_fisher(spark, sf_dir), "p_fisher", "holm").select("method1", "method2", _r("p_holm"))


@query(FISHER + " SELECT method1, method2, round(least(1.0, p * count(*) OVER ()), 6) AS p_bonferroni FROM fisher")
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.corrected(_fisher(spark, sf_dir), "p_fisher", "bonferroni").select("method1", "method2", _r("p_bonferroni"))


@query("SELECT CAST(e AS DOUBLE) AS effect_size, CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) / e, 2)) AS BIGINT) AS required_n FROM (VALUES (0.2), (0.5), (0.8)) AS t(e)")
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e, st.required_n(e)) for e in (0.2, 0.5, 0.8)], "effect_size double, required_n long")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.bootstrap(results(spark, sf_dir), rounds=10_000)


@query(ACC + " SELECT sampler, CAST(10000 AS BIGINT) AS rounds, round(accuracy, 6) AS accuracy, true AS holds_accuracy, true AS near_normal FROM wilson")
def bootstrap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled interval holds the accuracy, and each end is within a tenth of the normal interval's width of its end."""
    rows = results(spark, sf_dir)
    made = sig.bootstrap(rows, rounds=10_000).join(ev.accuracy(rows).select("sampler", "total", F.col("accuracy")), "sampler")
    p = F.col("accuracy") / 100
    half = 1.96 * F.sqrt(p * (1 - p) / F.col("total"))
    near = F.greatest(F.abs(F.col("ci_low") - (p - half)), F.abs(F.col("ci_high") - (p + half))) <= F.greatest(0.2 * half, 2 / F.col("total"))
    return made.select("sampler", F.col("rounds").cast("long").alias("rounds"), _r("accuracy"), p.between(F.col("ci_low"), F.col("ci_high")).alias("holds_accuracy"), near.alias("near_normal"))


@query(PAIRS + f""", z AS (SELECT *, {Z} AS x, {D} AS d FROM counts), p AS (SELECT *, {_upper_sql(N_DENSITY, 'z')} AS p FROM z),
h AS (SELECT *, row_number() OVER (ORDER BY p, method1, method2) AS i, count(*) OVER () AS m FROM p),
r AS (SELECT *, max(least(1.0, p * (m - i + 1))) OVER (ORDER BY p, method1, method2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm, CASE WHEN d <> 0 THEN CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) / abs(d), 2)) AS BIGINT) END AS required_n FROM h)
SELECT method1, method2, n, round(x, 6) AS z, round(p, 6) AS p_value, round(p_holm, 6) AS p_holm, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
  required_n, n >= required_n AS adequately_powered, p_holm < 0.05 AS significant FROM r""")
def pairwise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test, corrected p-value, effect and needed size of each pair of samplers."""
    rows = sig.effect(sig.two_proportion_z(sig.counts(sig.paired(results(spark, sf_dir), NAMES))))
    with_p = sig.holm(rows.withColumn("p_value", st.normal_two_sided("z")), "p_value")
    needed = F.when(F.col("d") != 0, F.ceil(2 * F.pow((st.NormalDist().inv_cdf(0.975) + st.NormalDist().inv_cdf(0.8)) / F.abs("d"), 2)))
    return with_p.select("method1", "method2", "n", _r("z"), _r("p_value"), _r("p_holm"), _r("d"), "effect", needed.alias("required_n"), (F.col("n") >= needed).alias("adequately_powered"), (F.col("p_holm") < 0.05).alias("significant"))


BOARD = ACC + """, latency AS (SELECT sampler, avg(elapsed_ms) AS ms FROM (SELECT DISTINCT ON (result_id) result_id, sampler, elapsed_ms FROM detailed_results) GROUP BY 1),
board AS (SELECT w.sampler, w.accuracy, l.ms, row_number() OVER (ORDER BY w.accuracy DESC, l.ms NULLS LAST, w.sampler) AS rank FROM wilson AS w LEFT JOIN latency AS l ON l.sampler = w.sampler)"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samplers by accuracy, then by their recorded mean latency, then by name."""
    latency = _delivered(spark, sf_dir, "sampler", "elapsed_ms").groupBy("sampler").agg(F.avg("elapsed_ms").alias("ms"))
    rows = ev.accuracy(results(spark, sf_dir)).join(latency, "sampler", "left")
    return ev.ranked(rows, "accuracy", "ms", "sampler")


@query(BOARD + " SELECT CAST(rank AS INT) AS rank, sampler, round(accuracy, 6) AS accuracy FROM board")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select("rank", "sampler", _r("accuracy"))


@query(BOARD + " SELECT b.sampler AS best, o.sampler AS other, round(b.accuracy - o.accuracy, 6) AS lead FROM board AS b JOIN board AS o ON o.rank > 1 WHERE b.rank = 1")
def best_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.first(F.struct("sampler", "accuracy")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return _board(spark, sf_dir).withColumn("b", best).where("rank > 1").select(F.col("b.sampler").alias("best"), F.col("sampler").alias("other"), _r(F.col("b.accuracy") - F.col("accuracy"), "lead"))


@query(BOARD + """, b AS (SELECT '| ' || sampler || ' | ' || printf('%.1f', accuracy) || ' |' AS line, rank + 1 AS n FROM board)
SELECT CAST(n AS INT) AS n, line FROM b UNION ALL SELECT 0, '| sampler | accuracy |' UNION ALL SELECT 1, '| - | - |'""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard as lines of a Markdown table."""
    board = _board(spark, sf_dir).withColumn("accuracy", F.format_string("%.1f", "accuracy"))
    return rs.markdown(board, ["sampler", "accuracy"], ["rank"])


@query(ACC + " SELECT sampler, CAST(list_position(['dcbs', 'greedy', 'top_p', 'random'], sampler) AS INT) AS pos, round(accuracy, 6) AS accuracy, round(accuracy - ci_low, 6) AS below, round(ci_high - accuracy, 6) AS above FROM wilson")
def chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and error bars of an accuracy chart, in the charts' fixed order."""
    pos = F.array_position(F.array(*map(F.lit, ("dcbs", "greedy", "top_p", "random"))), F.col("sampler")).cast("int")
    rows = ev.accuracy(results(spark, sf_dir))
    return rows.select("sampler", pos.alias("pos"), _r("accuracy"), _r(F.col("accuracy") - F.col("ci_low"), "below"), _r(F.col("ci_high") - F.col("accuracy"), "above"))


@query("""SELECT 'kmeans clusters=' || k || ' top=' || n AS config, 'kmeans' AS method FROM (VALUES (4), (8), (16)) AS k(k), (VALUES (30), (50)) AS n(n)
UNION ALL SELECT 'dbscan epsilon=' || e || ' min_samples=' || m, 'dbscan' FROM (VALUES ('0.2'), ('0.3'), ('0.5')) AS e(e), (VALUES (1), (2), (3)) AS m(m)
UNION ALL SELECT 'hierarchical clusters=' || k || ' linkage=' || l, 'hierarchical' FROM (VALUES (4), (8), (16)) AS k(k), (VALUES ('average'), ('complete')) AS l(l)""")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(name, s.method) for name, s in ca.grid().items()], "config string, method string")


@query()
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations of the grid on all contexts, ranked by accuracy."""
    picked = ca.sweep(rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), ca.grid())
    return _scored(spark, sf_dir, picked).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("correct"), "config")))


@query(f"""WITH {rel.logits_sql()}, {rel.dynamic_sql()}, n AS (SELECT ctx_id, count(*) AS n FROM cand GROUP BY 1)
SELECT count(*) AS configs, count(*) * (SELECT count(*) FROM n) AS decisions, true AS same_as_single_runs FROM range(21)""")
def sweep_grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration decides every context, and three of them run alone decide the same."""
    rows, vocab, specs = rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), ca.grid()
    picked = cut(ca.sweep(rows, vocab, specs))
    some = [n for n in specs if n in ("dbscan epsilon=0.5 min_samples=2", "hierarchical clusters=8 linkage=average", "kmeans clusters=8 top=50")]
    alone = None
    for n in some:
        one = ca.select(rows, vocab, specs[n]).select(F.lit(n).alias("config"), "ctx_id", F.col("token_id").alias("alone"))
        alone = one if alone is None else alone.unionByName(one)
    other = picked.where(F.col("config").isin(some)).join(alone, ["config", "ctx_id"], "full").where(~F.col("token_id").eqNullSafe(F.col("alone"))).agg((F.count("*") == 0).alias("same_as_single_runs"))
    return picked.agg(F.countDistinct("config").alias("configs"), F.count("*").alias("decisions")).join(F.broadcast(other))


def _sweep_sql() -> str:
    parts, pick = [f"WITH RECURSIVE {rel.logits_sql()}, {rel.VOCABULARY_SQL}, {rel.dynamic_sql()}"], []
    for i, e in enumerate((0.6, 0.7, 0.75)):
        edges = rel.edges_sql(e, f"edges{i}")
        parts.append(f"{edges}, {rel.clusters_sql('cand', f'c{i}').replace('FROM edges AS', f'FROM edges{i} AS')}, {rel.picked_sql(rel.CONFIDENCE_SQL, f'c{i}', f'k{i}')}")
        pick.append(f"SELECT 'eps{e}' AS config, ctx_id, token_id FROM k{i}")
    return ", ".join(parts) + ", sweep AS (" + " UNION ALL ".join(pick) + ")"


SWEEP = _sweep_sql() + ", scored AS (SELECT config, count(*) AS total, count(*) FILTER (v.label = s.ctx_id % 10) AS correct FROM sweep AS s JOIN vocab AS v USING (token_id) GROUP BY config)"


def _scored(spark: SparkSession, sf_dir: str, picked: DataFrame) -> DataFrame:
    right = (F.col("label") == F.pmod("ctx_id", F.lit(10))).alias("correct")
    return picked.join(rel.vectors(spark, sf_dir).select("token_id", "label"), "token_id").select("config", right).groupBy("config").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = {f"eps{e}": ca.ClusterSpec(method="dbscan", epsilon=e) for e in (0.6, 0.7, 0.75)}
    return _scored(spark, sf_dir, ca.sweep(rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), specs))


@query(SWEEP + " SELECT * FROM scored")
def sweep_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query(SWEEP + " SELECT config, correct, max(correct) OVER (ORDER BY config ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM scored")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = F.max("correct").over(Window.orderBy("config").rowsBetween(Window.unboundedPreceding, 0))
    return _sweep(spark, sf_dir).select("config", "correct", so_far.alias("best_so_far"))


@query("""WITH d AS (SELECT DISTINCT ON (result_id) * FROM detailed_results), r AS (SELECT run_id, min(completed_at) AS at, 100.0 * count(*) FILTER (correct) / count(*) AS accuracy, avg(elapsed_ms) AS ms FROM d WHERE sampler = 'dcbs' GROUP BY 1)
SELECT run_id, round(accuracy, 6) AS accuracy, (SELECT b.run_id FROM r AS b WHERE (b.at, b.run_id) <= (r.at, r.run_id) ORDER BY b.accuracy DESC, b.ms NULLS LAST, b.run_id LIMIT 1) AS best_run FROM r""")
def running_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run so far in the order of completion: by accuracy, equal ones by latency."""
    d = _delivered(spark, sf_dir, "run_id", "sampler", "correct", "elapsed_ms", "completed_at").where("sampler = 'dcbs'")
    runs = d.groupBy("run_id").agg(F.min("completed_at").alias("at"), (100.0 * F.count_if("correct") / F.count("*")).alias("accuracy"), F.avg("elapsed_ms").alias("ms"))
    return ev.best_so_far(runs, ["at", "run_id"], "accuracy", "ms", "run_id").select("run_id", _r("accuracy"), F.col("best").alias("best_run"))


# the domain's own result tables

_ONCE = "WITH d AS (SELECT DISTINCT ON (result_id) * FROM detailed_results)"


def _delivered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each result once."""
    return table(spark, sf_dir, "detailed_results").select("result_id", *columns).dropDuplicates(["result_id"])


@query(_ONCE + """ SELECT run_id, sampler, count(*) AS total, count(*) FILTER (correct) AS correct, round(100.0 * count(*) FILTER (correct) / count(*), 6) AS accuracy, round(avg(elapsed_ms), 3) AS mean_ms FROM d GROUP BY run_id, sampler""")
def run_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _delivered(spark, sf_dir, "run_id", "sampler", "correct", "elapsed_ms")
    return rows.groupBy("run_id", "sampler").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), _r(100.0 * F.count_if("correct") / F.count("*"), "accuracy"), F.round(F.avg("elapsed_ms"), 3).alias("mean_ms"))


@query(_ONCE + """ SELECT coalesce(dataset, 'all') AS dataset, sampler, printf('%.1f%% (%d/%d)', 100.0 * count(*) FILTER (correct) / count(*), count(*) FILTER (correct), count(*)) AS summary
FROM d GROUP BY GROUPING SETS ((dataset, sampler), (sampler))""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _delivered(spark, sf_dir, "dataset", "sampler", "correct").cube("dataset", "sampler").agg(F.count("*").alias("t"), F.count_if("correct").alias("c"), F.grouping_id().alias("g"))
    text = F.format_string("%.1f%% (%d/%d)", 100.0 * F.col("c") / F.col("t"), "c", "t")
    return rows.where("g IN (0, 2)").select(F.coalesce("dataset", F.lit("all")).alias("dataset"), "sampler", text.alias("summary"))


@query(_ONCE + """, last AS (SELECT run_id, id, sampler, arg_max(pred_id, result_id) AS pred_id, max(result_id) AS result_id FROM d WHERE sampler IN ('dcbs', 'greedy') AND pred_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT a.run_id, a.id, a.pred_id AS dcbs_pred, b.pred_id AS greedy_pred FROM last AS a JOIN last AS b ON a.run_id = b.run_id AND a.id = b.id AND b.sampler = 'greedy' WHERE a.sampler = 'dcbs' AND a.pred_id <> b.pred_id""")
def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _delivered(spark, sf_dir, "run_id", "id", "sampler", "pred_id").where(F.col("sampler").isin("dcbs", "greedy") & F.col("pred_id").isNotNull())
    last = rows.groupBy("run_id", "id").agg(*[F.max_by(F.when(F.col("sampler") == n, F.col("pred_id")), F.when(F.col("sampler") == n, F.col("result_id"))).alias(f"{n}_pred") for n in ("dcbs", "greedy")])
    return last.where(F.col("dcbs_pred") != F.col("greedy_pred"))


@query(_ONCE + """, p AS (SELECT result_id, unnest(map_entries(answer_probs)) AS e FROM d WHERE answer_probs IS NOT NULL)
SELECT result_id, arg_min(e.key, (-e.value, e.key)) AS top_answer, round(max(e.value), 6) AS top_p, count(*) AS answers FROM p WHERE e.value IS NOT NULL GROUP BY result_id""")
def top_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest answer of each result, on ties the least text."""
    rows = _delivered(spark, sf_dir, "answer_probs").select("result_id", F.explode("answer_probs").alias("answer", "p")).where("p IS NOT NULL")
    grouped = rows.groupBy("result_id").agg(F.max("p").alias("_top"), F.collect_list(F.struct("answer", "p")).alias("_all"), F.count("*").alias("answers"))
    first = F.array_min(F.transform(F.filter("_all", lambda x: x["p"] == F.col("_top")), lambda x: x["answer"]))
    return grouped.select("result_id", first.alias("top_answer"), _r("_top", "top_p"), "answers")


@query(_ONCE + """, t AS (SELECT sampler, avg(elapsed_ms) AS m, stddev_samp(elapsed_ms) AS sd, count(elapsed_ms) AS n FROM d WHERE isfinite(elapsed_ms) GROUP BY 1)
SELECT sampler, CAST(list_position(['dcbs', 'greedy', 'top_p', 'random'], sampler) AS INT) AS pos, round(m, 3) AS mean_ms, round(1.96 * sd / sqrt(n), 3) AS error_ms FROM t""")
def timing_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and error bars of a latency chart."""
    pos = F.array_position(F.array(*map(F.lit, ("dcbs", "greedy", "top_p", "random"))), F.col("sampler")).cast("int")
    pos = F.nullif(pos, F.lit(0))
    e = F.col("elapsed_ms")
    rows = lg.finite(_delivered(spark, sf_dir, "sampler", "elapsed_ms").withColumn("logit", e)).groupBy("sampler").agg(F.avg(e).alias("m"), F.stddev_samp(e).alias("sd"), F.count(e).alias("n"))
    return rows.select("sampler", pos.alias("pos"), F.round("m", 3).alias("mean_ms"), F.round(st.Z95 * F.col("sd") / F.sqrt("n"), 3).alias("error_ms"))


@query(_ONCE + " SELECT sampler, count(*) FILTER (cluster_info IS NULL) AS without_clusters, count(*) AS total FROM d GROUP BY sampler")
def cluster_info_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir, "sampler", "cluster_info").groupBy("sampler").agg(F.count_if(F.col("cluster_info").isNull()).alias("without_clusters"), F.count("*").alias("total"))


@query(_ONCE + """, e AS (SELECT result_id, answer_ids, pred_id FROM d WHERE answer_ids IS NOT NULL AND pred_id IS NOT NULL), x AS (SELECT result_id, pred_id, unnest(map_entries(answer_ids)) AS e FROM e)
SELECT result_id, min(e.key) FILTER (e.value = pred_id) AS option_of_pred FROM x GROUP BY result_id""")
def pred_to_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _delivered(spark, sf_dir, "answer_ids", "pred_id").where("answer_ids IS NOT NULL AND pred_id IS NOT NULL AND size(answer_ids) > 0")
    hits = F.array_sort(F.transform(F.filter(F.map_entries("answer_ids"), lambda e: e["value"] == F.col("pred_id")), lambda e: e["key"]))
    return rows.select("result_id", F.get(hits, F.lit(0)).alias("option_of_pred"))
