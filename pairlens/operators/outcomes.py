"""Who was right where two samplers disagreed, from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome() -> Column:
    """Of a sequence_end event; null where nothing was decided or nobody disagreed."""
    g, d = F.col("correctness.greedy_correct"), F.col("correctness.dcbs_correct")
    return F.when(F.coalesce("disagreement_count", F.lit(0)) > 0, F.when(g & d, "both_correct").when(g, "greedy_wins").when(d, "dcbs_wins").otherwise("both_wrong"))


def counters(events: DataFrame) -> DataFrame:
    """One row: sequences, those with disagreement, tokens in disagreement (as logged and as counted at the ends), outcomes, and both rates."""
    end, token = F.col("event_type") == "sequence_end", F.col("event_type") == "token_disagreement"
    names = ("greedy_wins", "dcbs_wins", "both_correct", "both_wrong")
    total = events.withColumn("_o", F.when(end, outcome())).agg(
        F.count_if(end).alias("sequences"), F.count_if(end & (F.col("disagreement_count") > 0)).alias("sequences_with"),
        F.count_if(token).alias("tokens_logged"), F.coalesce(F.sum(F.when(end, F.col("disagreement_count"))), F.lit(0)).alias("tokens_counted"),
        *[F.count_if(F.col("_o") == n).alias(n) for n in names])
    return total.withColumn("token_disagreements_per_sequence", F.col("tokens_counted") / F.greatest(F.lit(1), F.col("sequences"))).withColumn(
        "sequence_disagreement_pct", F.coalesce(F.try_divide(100.0 * F.col("sequences_with"), F.col("sequences")), F.lit(0.0)))


def by_outcome(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "sequence_end").select("run_id", outcome().alias("outcome")).where("outcome IS NOT NULL").groupBy("run_id", "outcome").agg(F.count("*").alias("n"))


def drift(events: DataFrame) -> DataFrame:
    """Per sequence the disagreements counted at its end and those logged, and whether they agree.

    One grouping over both kinds of events: a sequence without an end has a
    null count and doesn't agree, one without logged events has 0 of them.
    """
    end, token = F.col("event_type") == "sequence_end", F.col("event_type") == "token_disagreement"
    rows = events.where(end | token).groupBy("run_id", "sequence_id").agg(F.sum(F.when(end, F.coalesce("disagreement_count", F.lit(0)))).alias("counted"), F.count_if(token).alias("logged"))
    return rows.withColumn("agrees", F.coalesce(F.col("counted") == F.col("logged"), F.lit(False)))


def examples(rows: DataFrame, by: str, order: str, n: int = 10) -> DataFrame:
    """The first n rows of each group and how many more there are.

    The rank alone is filtered, so each task keeps n rows of a group before they
    are exchanged, and sizes are counted apart: a hot group never meets in one
    task.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    first = rows.withColumn("pos", rank).where(F.col("pos") <= n)
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.greatest(F.lit(0), F.count("*") - n).alias("more"))
    return first.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
