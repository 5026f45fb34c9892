"""Evaluation files as flat tables with parent links, from the adjacency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.shred import ELEMENT, adjacency, entities
from pairlens.plans.durable import spread

#: The record lists of an evaluation file.
LISTS = ("detailed_results", "prediction_differences")
#: Subtrees that belong to no entity table, of the root, and of a record and its cluster_info.
UNUSED_ROOT, UNUSED = ("config", "statistics"), ("options", "labels", "cluster_sizes")


def _unused(*more: str) -> dict:
    """The places of the unused subtrees and of ``more`` keys of a record; answer texts are never among them."""
    record = {"cluster_info": dict.fromkeys(UNUSED)} | dict.fromkeys((*UNUSED, *more))
    return dict.fromkeys(UNUSED_ROOT) | {name: record | {ELEMENT: record} for name in LISTS}


def _apart(rows: DataFrame) -> DataFrame:
    """The same rows as a projection of their own: later ones then read its columns and don't repeat its expressions, whose code would grow too long to be compiled well."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_x")).select("_x.*")


def _located(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The nodes that belong to an entity: ``key``, entity, home (its object's id), list, i, cluster and member index, listed, label, scalar.

    Cheap tests of the parent's path come first; ids are only taken apart for
    the nodes that pass.
    """
    nodes = adjacency(spread(df.select(key, payload)), key, payload, skip=_unused(), once=False)
    parent = F.col("parent_id")
    element, there, scalar = F.col("ordinal").isNotNull(), F.col("kind") != "null", ~F.col("kind").isin("object", "array")
    probs, clusters = parent.endswith("/answer_probs"), parent.endswith("/cluster_info/clusters")
    child = F.col("label").isin("answer", "prob") & parent.contains("/answer_probs/") & ~element & scalar
    inner = parent.contains("/cluster_info/clusters/") & element & there
    near = nodes.where(
        (F.col("node_id").isin(*LISTS) & (F.col("kind") == "object")) | (parent.isin(*LISTS) & element & (F.col("kind") == "object"))
        | (probs & ~element) | child | (clusters & element & there) | inner | (parent.endswith("/cluster_info/cluster_probs") & element & there))
    # the id of a very long answer text is a digest; its parent's id tells its place. A single record in place of a list gets its index, so that places in the path are the same for both
    own = F.when(F.col("node_id").startswith("#"), F.concat(parent, F.lit("/"))).otherwise(F.col("node_id"))
    whole = F.regexp_replace(own, f"^({'|'.join(LISTS)})(?=$|/answer_probs|/cluster_info)", "$1/0")
    seg = _apart(near.select(key, "parent_id", "node_id", "ordinal", "label", "scalar", child.alias("child"), F.split(whole, "/").alias("s")))
    seg = _apart(seg.select(key, "parent_id", "node_id", "ordinal", "label", "scalar", "child", "s", (F.size("s") - 2).alias("n"), F.get("s", F.lit(1)).try_cast("int").alias("i"), F.get("s", F.lit(2)).alias("s2"), F.get("s", F.lit(3)).alias("s3")).where(F.col("s")[0].isin(*LISTS)))
    n = F.col("n")
    listed = F.col("child") & (F.col("s2") == "answer_probs") & (n == 3)
    in_clusters = (F.col("s2") == "cluster_info") & (F.col("s3") == "clusters")
    entity = (
        F.when(n == 0, "record")
        .when((F.col("s2") == "answer_probs") & (n == 2) & ~element, "answer")
        .when(listed, "answer")
        .when(in_clusters & (n == 3), "cluster")
        .when(in_clusters & (n == 4), "member")
        .when((F.col("s2") == "cluster_info") & (F.col("s3") == "cluster_probs") & (n == 3), "cluster_prob")
    )
    kept = _apart(seg.where(F.col("i").isNotNull()).select("*", entity.alias("entity"), F.coalesce(listed, F.lit(False)).alias("listed"))).where(F.col("entity").isNotNull())
    grouped = F.col("entity").isin("cluster", "member", "cluster_prob")
    return _apart(kept.select(
        key, "entity", F.when(F.col("listed"), parent).otherwise(F.col("node_id")).alias("home"), F.col("s")[0].alias("list"), F.col("i").alias("record_index"),
        F.when(grouped, F.get("s", F.lit(4)).cast("int")).alias("cluster_index"), F.when(F.col("entity") == "member", F.get("s", F.lit(5)).cast("int")).alias("member_index"),
        "listed", "label", "scalar"))


def _paths(rows: DataFrame) -> DataFrame:
    """Adds node_path and parent_path; an answer without a text has none."""
    base = F.concat_ws("/", "list", "record_index")
    of = lambda name: F.col("entity") == name
    cluster = F.concat(base, F.lit("/cluster_info/clusters/"), F.col("cluster_index"))
    path = (
        F.when(of("record"), base)
        .when(of("answer"), F.concat(base, F.lit("/answer_probs/"), F.col("answer")))
        .when(of("cluster"), cluster)
        .when(of("member"), F.concat(cluster, F.lit("/"), F.col("member_index")))
        .otherwise(F.concat(base, F.lit("/cluster_info/cluster_probs/"), F.col("cluster_index")))
    )
    parent = F.when(of("record"), F.col("list")).when(of("member"), cluster).otherwise(base)
    return rows.withColumn("node_path", path).withColumn("parent_path", parent).where(F.col("node_path").isNotNull())


def parts(df: DataFrame, key: str = "envelope_id", payload: str = "payload") -> DataFrame:
    """One row per entity of each readable payload.

    Columns: ``key``, entity (record, answer, cluster, member, cluster_prob),
    node_path, parent_path, list, record_index, answer, cluster_index,
    member_index, value. node_path is unique in its payload: where an answer
    text occurs twice in a record, the larger value stays. A single record in
    place of a list has index 0. A null array element gives no row and keeps
    its index. Payloads that are null, empty or unreadable give no rows, an
    empty table none at all. parent_path names the row's parent (the record of
    an answer, the cluster of a member, the list of a record).
    """
    # the two scalar children of a listed answer meet under their parent; any other node is an entity by itself
    listed, answer = F.col("listed"), F.col("entity") == "answer"
    text = F.when(listed, F.when(F.col("label") == "answer", F.col("scalar"))).when(answer, F.col("label"))
    value = F.when(listed, F.when(F.col("label") == "prob", F.col("scalar"))).when(F.col("entity").isin("answer", "member", "cluster_prob"), F.col("scalar"))
    keys = (key, "entity", "list", "record_index", "cluster_index", "member_index")
    # both groupings are by the record and more, so one exchange by records serves them; a large payload's records spread
    met = _located(df, key, payload).repartition(key, "list", "record_index").groupBy(*keys, "home").agg(F.max(text).alias("answer"), F.max(value).alias("value"))
    largest = F.max(F.struct(F.col("value").try_cast("double").alias("number"), "value"))["value"]
    return _paths(met).groupBy(*keys, "node_path", "parent_path", "answer").agg(largest.alias("value"))


def nodes_found(df: DataFrame) -> DataFrame:
    """envelope_id and node_path of every entity, each once."""
    return parts(df).select("envelope_id", "node_path")


def of_entity(df: DataFrame, entity: str, *columns: Column | str) -> DataFrame:
    """The flat table of one entity: its path, its parent's, and ``columns``."""
    return parts(df).where(F.col("entity") == entity).select("envelope_id", "node_path", "parent_path", *columns)


def records(df: DataFrame, fields: tuple[str, ...] = ("id", "sentence", "sampler", "predicted_answer", "correct", "elapsed_ms")) -> DataFrame:
    """One row per record with its scalar fields as strings, null where absent."""
    nodes = adjacency(df, "envelope_id", "payload", skip=_unused("answer_probs", "cluster_info"), once=False)
    single = F.col("node_id").isin(*LISTS)
    listed = F.col("parent_id").isin(*LISTS) & F.col("ordinal").isNotNull()
    rows = entities(nodes, "envelope_id", fields, single | listed)
    path = F.when(single, F.concat("node_id", F.lit("/0"))).otherwise(F.col("node_id"))
    return rows.select("envelope_id", path.alias("node_path"), F.when(single, F.col("node_id")).otherwise(F.col("parent_id")).alias("parent_path"), *fields)
