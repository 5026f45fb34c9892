"""Cutting lineage so that it outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.errors import ConfigurationError


def _folder(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def _base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder of this machine, which serves local sessions only."""
    base = _folder(spark)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors see")
    return tempfile.mkdtemp(prefix="pairlens-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, below ``spark.checkpoint.dir``."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lost executors cost no more than what came after.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset,
    a cluster's session raises, and a local one, as in tests, takes a temporary
    folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_base(spark))
    return df.checkpoint(eager=True)


#: Rows, and bytes by their values, up to which a side counts as small.
SMALL_ROWS, SMALL_BYTES = 500_000, 16 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values: strings, binaries and arrays by their length, anything else as 8."""
    out = F.lit(8 * len(df.columns))
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            out = out + 8 * F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0))
    return out


def is_small(df: DataFrame, rows: int = SMALL_ROWS, most: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``most`` bytes together; no more than these rows are looked at."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return n <= rows and size <= most


def small_side(df: DataFrame, rows: int = SMALL_ROWS, most: int = SMALL_BYTES) -> DataFrame:
    """``df``, to be broadcast if it ``is_small``, else as it is, to be joined by a shuffle.

    For sides that are written already (``cut``), since they are counted.
    """
    return F.broadcast(df) if is_small(df, rows, most) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has less than half of that: rows of one small file whose work is costly.

    Larger inputs have more partitions than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
