"""Result files, reports and finished work: readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = (
    "id string, sentence string, options array<string>, correct_answer string, correct_option string, cot_reasoning string, answer_ids map<string,int>,"
    " correct_id int, answer_probs map<string,double>, processing_time double, sampler string, pred_id int, predicted_answer string, correct boolean, elapsed_ms double"
)
FILE = f"statistics map<string,struct<accuracy double, correct bigint, total bigint, avg_time_ms double, confidence_interval array<double>>>, detailed_results array<struct<{RECORD.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean')}>>, evaluation_completed_at string"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per result file with its path and modification time; an unreadable file has null fields."""
    return spark.read.schema(FILE).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """The records of the newest readable file below ``path``; equal times go to the last path."""
    files = read_results(spark, path).where(F.col("detailed_results").isNotNull())
    newest = files.agg(F.max_by(F.struct("file", "detailed_results"), F.struct("modified", "file")).alias("x"))
    return newest.select(F.col("x.file").alias("file"), F.explode("x.detailed_results").alias("r")).select("file", "r.*")


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON document per row, appended; sets and numbers keep their types through the schema."""
    rows.write.mode("append").json(path)


def to_document(*columns: str) -> Column:
    """A row's columns as one JSON text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of a Markdown table, numbered; its rows must be few (a summary), since they are put in one order."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " - |" * len(columns))], "n int, line string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("n"), cells.alias("line"))
    return head.unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).orderBy("n").select("line").write.mode("overwrite").text(path)


class FinishedWork:
    """Keys of finished work as Parquet; what is left is an anti-join, so an interrupted or failed part is done again."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("run_id", "id", "sampler")) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.keys).distinct().write.mode("append").partitionBy(self.keys[0]).parquet(self.path)

    def runs(self, like: DataFrame) -> DataFrame:
        """The first key (the run) and how much of it is finished."""
        return self.done(like).groupBy(self.keys[0]).agg(F.count("*").alias("finished"))

    def forget(self, run: str) -> bool:
        """Deletes the finished work of one run; False if there is none."""
        jvm = self.spark.sparkContext._jvm
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.keys[0]}={run}")
        return bool(part.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True))

    def done(self, like: DataFrame) -> DataFrame:
        try:
            return self.spark.read.schema(like.select(*self.keys).schema).parquet(self.path).distinct()
        except Exception as e:  # no file yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return like.select(*self.keys).limit(0)

    def left(self, work: DataFrame) -> DataFrame:
        return work.join(self.done(work), list(self.keys), "left_anti")


def latest_compatible(states: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """The state whose settings equal ``wanted`` (nulls equal each other) with most completed, then the latest timestamp."""
    fits = F.lit(True)
    for key, value in wanted.items():
        fits = fits & F.col(key).eqNullSafe(F.lit(value))
    return states.where(fits).agg(F.max_by(F.struct(*states.columns), F.struct("completed", "timestamp")).alias("s")).where("s IS NOT NULL").select("s.*")
