"""The append-only log of decisions: JSON lines of several event types in one wide schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event types.
TYPES = ("run_start", "token_disagreement", "sequence_end")
EVENT = (
    "event_type string, timestamp string, run_id string, version string, sequence_id string, timestep int,"
    " context struct<tokens:array<int>, text:string, length:int>, greedy struct<token:int, probability:double>,"
    " dcbs struct<token:int, probability:double, cluster_id:int, cluster_centroid:array<double>>, top_k_probs map<string,double>,"
    " dataset string, question string, answers struct<greedy:string, dcbs:string, correct:string>,"
    " correctness struct<greedy_correct:boolean, dcbs_correct:boolean>, disagreement_count int, metadata map<string,string>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All readable events; malformed lines are dropped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as a stream; events without a type (malformed lines) are dropped."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path).where(F.col("event_type").isNotNull())


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
