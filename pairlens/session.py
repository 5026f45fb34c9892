"""Session defaults. A session that exists already is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small exchanges keep several tasks: a context's rows are few and cost much
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf names use "__" for "."."""
    builder = SparkSession.builder.master(master).appName("pairlens")
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
