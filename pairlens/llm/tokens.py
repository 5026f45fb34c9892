"""Sizes of texts in tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern: a run of letters, digits and underscores, or a run of other characters that are not white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]+"


def token_count(text: str = "text") -> Column:
    """Tokens of a text; 0 of an empty or blank one, null of null."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def sized(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id, tokens and ``columns``, each doc_id once, rows without one left out; a null text has 0 tokens."""
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", *columns, F.coalesce(token_count(), F.lit(0)).alias("tokens")).dropDuplicates(["doc_id"])
