"""Schemas that drift between files: a catalogue of column lifespans.

Each readable record is walked into its fields (dotted paths of object keys)
with their types. A field's presence per file, numbered within its producer
(the series), gives islands: a field-type lives from a start to an end. Starts
and ends that meet at a file are additions, removals, changes of type or, where
the values of common records agree, renames; renames make the alias table, and
that the casts into one consistent table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.json_text import parse
from pairlens.operators.shred import text_array
from pairlens.plans.durable import cut, small_side

#: Fixed pattern: what names a field; other keys (answer texts) are data.
FIELD_NAME = re.compile("[A-Za-z_][A-Za-z0-9_]*")
#: Bytes of values up to which they are compared as they are; longer ones, and objects, by a digest of 128 bits.
PLAIN = 24
_SCALARS = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object"}
_sorted = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode
_written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _number(text: str, whole: bool) -> int | float:
    """Numbers of equal value are equal, however they are written."""
    if whole and len(text) < 300:
        return int(text)
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 1 << 53 else value


def _number_as_read(text: str, whole: bool) -> int | float:
    return int(text) if whole and len(text) < 300 else float(text)


def json_type(v: object) -> str:
    """string, number, boolean, object, or array<...> of these; void for an array's type without an element, mixed for several types."""
    if not isinstance(v, list):
        return _SCALARS[type(v)]
    depth, level = 0, v
    while True:
        depth += 1
        inner = [x for x in level if x is not None]
        lists = [x for x in inner if isinstance(x, list)]
        if not inner or len(lists) < len(inner):
            kinds = {_SCALARS[type(x)] for x in inner if not isinstance(x, list)} | ({"array"} if lists else set())
            core = kinds.pop() if len(kinds) == 1 else "mixed" if kinds else "void"
            return "array<" * depth + core + ">" * depth
        level = [y for x in lists for y in x]


def _canonical(v: object, dump=_sorted) -> str:
    """One text for equal values."""
    try:
        return dump(v)
    except RecursionError:
        # deeper than the encoder can go: what stands at each place, in order
        out, stack = [], [("", v)]
        while stack:
            at, x = stack.pop()
            if isinstance(x, (dict, list)):
                out.append(at + ("{" if isinstance(x, dict) else "["))
                stack.extend((str(k), y) for k, y in reversed(sorted(x.items()) if isinstance(x, dict) else list(enumerate(x))))
                stack.append((at, "}"))
            else:
                out.append(f"{at}:{x!r}")
        return "\n".join(out)


def _digest(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= PLAIN else "#" + blake2b(raw, digest_size=16).hexdigest()


def _fields_of(record: dict, whole: bool) -> list[tuple[str, str, str, str | None, bool]]:
    """(parent, path, type, value, text_map) of each non-null field; an object's value is made from its fields' values, so no text is written twice."""
    rows: list = []
    # (parent path, object, row of the object or None)
    stack: list = [("", record, None)]
    opened: list = []
    while stack:
        parent, fields_, own = stack.pop()
        children = []
        for name, v in fields_.items():
            if v is None:
                continue
            path = f"{parent}.{name}" if parent else name
            at = len(rows)
            children.append((name, at))
            if isinstance(v, dict):
                texts = any(not FIELD_NAME.fullmatch(k) for k in v) and all(x is None or type(x) in (int, float) for x in v.values())
                rows.append([parent, path, "object", _canonical(v, _written) if whole and all(x is None or type(x) in (int, float) for x in v.values()) else None, texts])
                stack.append((path, v, at))
            else:
                rows.append([parent, path, json_type(v), _canonical(v, _written) if whole else _digest(_canonical(v)), False])
        opened.append((own, children))
    if not whole:
        # inner objects were opened after their parents
        for own, children in reversed(opened):
            if own is not None:
                rows[own][3] = _digest("{" + ",".join(sorted(f"{name}:{rows[at][3]}" for name, at in children)) + "}")
    return rows


_COLUMNS = ("series_id", "file_name", "written_at", "record_key", "parent", "path", "type", "value", "text_map")


def _walk(whole: bool):
    number = _number_as_read if whole else _number
    schema = pa.schema([(c, pa.int64() if c == "written_at" else pa.bool_() if c == "text_map" else pa.string()) for c in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for series, file, written, key, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                try:
                    record = parse(payload, number) if payload else None
                except ValueError:
                    record = None
                # a row without a path stands for the record, readable or not
                rows.append((series, file, written, key if isinstance(record, dict) else None, None, "", None, None, None))
                if isinstance(record, dict):
                    rows.extend((series, file, None, key, *row) for row in _fields_of(record, whole))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([text_array(list(c)) if pa.types.is_string(f.type) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def fields(df: DataFrame, whole: bool = False) -> DataFrame:
    """One row per record (path "") and one per non-null field of it: series_id, file_name, written_at (of the record's row), record_key, parent, path, type, value, text_map.

    value tells values apart: it is the same for equal ones. With ``whole`` it
    is the field's JSON, and null for an object that holds
    anything but numbers. text_map tells an object with a key that is no
    field name and with numbers or nulls only. Unreadable, null and empty
    payloads and those that are no object have the record's row alone, without
    a key; rows without a series or file give none. One walk over Arrow
    batches, without a shuffle: records are of any depth.
    """
    rows = df.where("series_id IS NOT NULL AND file_name IS NOT NULL").select("series_id", "file_name", F.unix_micros(F.col("written_at").cast("timestamp")).alias("written_at"), "record_key", "payload")
    return rows.mapInArrow(_walk(whole), "series_id string, file_name string, written_at long, record_key string, parent string, path string, type string, value string, text_map boolean")


class Drift:
    """What the changes, lifespans and the consistent table of ``df`` (series_id, file_name, written_at, record_key, payload) are made from.

    Fields are walked once and written; the catalogue has a row per file and
    field and is written too.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.seen = cut(fields(df))
        self.catalogue = cut(self._catalogue())

    def _catalogue(self) -> DataFrame:
        """series_id, n (the file's number in its series), last (that of the series' last file), file_name, path, parent, type, map.

        Files are numbered by written_at, then file_name; a file without a
        readable record counts and has no field. A field of several types has
        them joined by "|"; element types unknown for want of elements give way
        to known ones. map tells a field that maps texts to numbers anywhere in
        the series; what lies directly below it is left out.
        """
        grouped = self.seen.groupBy("series_id", "file_name", "path").agg(F.min("parent").alias("parent"), F.min("written_at").alias("written_at"), F.collect_set("type").alias("types"), F.max("text_map").alias("map"))
        per = Window.partitionBy("series_id")
        numbered = grouped.where("path = ''").select("series_id", "file_name", F.row_number().over(per.orderBy("written_at", "file_name")).alias("n"), F.count("*").over(per).alias("last"))
        maps = grouped.where("map").select("series_id", F.col("path").alias("parent")).distinct()
        marks = maps.select("series_id", F.col("parent").alias("path"), F.lit(True).alias("map"))
        known = F.filter("types", lambda t: ~t.contains("void"))
        joined = F.array_join(F.array_sort(F.when(F.size(known) > 0, known).otherwise(F.col("types"))), "|")
        fields_ = grouped.where("path <> ''").join(maps, ["series_id", "parent"], "left_anti").select("series_id", "file_name", "path", "parent", joined.alias("type"))
        marked = fields_.join(marks, ["series_id", "path"], "left").join(numbered, ["series_id", "file_name"])
        return marked.select("series_id", "n", "last", "file_name", "path", "parent", "type", F.coalesce("map", F.lit(False)).alias("map"))

    def files(self) -> DataFrame:
        """series_id, n, file_name of the files with a field."""
        return self.catalogue.select("series_id", "n", "file_name").distinct()


def lifespans(drift: Drift) -> DataFrame:
    """One row per producer, field and type: path, type, first_n, last_n, files: the islands of unbroken presence."""
    by = Window.partitionBy("series_id", "path").orderBy("n")
    new = (F.lag("n").over(by) != F.col("n") - 1) | (F.lag("type").over(by) != F.col("type"))
    marked = drift.catalogue.withColumn("new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("new").over(by))
    return marked.groupBy("series_id", "path", "island").agg(
        F.first("type").alias("type"), F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count("*").alias("files"), F.max("last").alias("series_files"))


def _same(a: Column, b: Column) -> Column:
    """Equal types; an array whose elements aren't known fits any array."""
    return (a == b) | (a.startswith("array") & b.startswith("array") & (a.contains("void") | b.contains("void")))


def _matched(agree: DataFrame) -> DataFrame:
    """series_id, n, path, old_path: pairs in which each field occurs once.

    The pair with most records, then the first by name, is taken, then the
    next one of what is left, until no pair remains.
    """
    kind = "array<struct<old_path:string,path:string>>"
    taken = lambda held, x: F.exists(held, lambda y: (y["old_path"] == x["old_path"]) | (y["path"] == x["path"]))
    pair = lambda x: F.struct(x["old_path"].alias("old_path"), x["path"].alias("path"))
    ranked = agree.groupBy("series_id", "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("records")).alias("less"), "old_path", "path"))).alias("pairs"))
    chosen = F.aggregate("pairs", F.array().cast(kind), lambda held, x: F.when(taken(held, x), held).otherwise(F.concat(held, F.array(pair(x)).cast(kind))))
    return ranked.select("series_id", "n", F.explode(chosen).alias("x")).select("series_id", "n", "x.path", "x.old_path")


def _agreeing(drift: Drift, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (series_id, n, path, old_path) those whose values are equal in each common record that has either, with the number of these records.

    The fields' rows are read once: an equi-join keeps those of the files and
    paths in question, and of the records' own rows, which tell what is common.
    """
    files = drift.files()
    of = lambda back, name: pairs.select("series_id", (F.col("n") - back).alias("n"), F.col("n").alias("at"), F.explode(F.array(F.lit(""), F.col(name))).alias("path"), F.lit(back).alias("side")).distinct()
    asked = cut(of(0, "path").unionByName(of(1, "old_path")).join(files, ["series_id", "n"]).drop("n"))
    rows = drift.seen.where("record_key IS NOT NULL").join(small_side(asked), ["series_id", "file_name", "path"])
    found = rows.groupBy("series_id", "at", "record_key").agg(F.collect_set(F.struct("side", "path", "value")).alias("all"))
    there = lambda side: F.exists("all", lambda x: (x["side"] == side) & (x["path"] == ""))
    common = found.where(there(0) & there(1)).select("series_id", F.col("at").alias("n"), "all")
    values = lambda side, path: F.array_sort(F.transform(F.filter("all", lambda x: (x["side"] == side) & (x["path"] == F.col(path))), lambda x: x["value"]))
    met = common.join(pairs, ["series_id", "n"]).select("series_id", "n", "path", "old_path", values(0, "path").alias("new"), values(1, "old_path").alias("old")).where("size(new) + size(old) > 0")
    return met.groupBy("series_id", "n", "path", "old_path").agg(F.min((F.col("new") == F.col("old")).cast("int")).alias("equal"), F.count("*").alias("records")).where("equal = 1").drop("equal")


def raw_changes(drift: Drift) -> DataFrame:
    """Changes by file: series_id, n, path, old_path, change_kind, nothing left out below a changed field.

    A new field is renamed if it agrees with any vanished one, and each vanished
    field that agrees is marked ``renamed_from``; old_path is null where all of
    its vanished partners went to other fields.
    """
    by = Window.partitionBy("series_id", "path").orderBy("n")
    step = drift.catalogue.select("series_id", "n", "last", "path", "parent", "type", F.lag("n").over(by).alias("before"), F.lag("type").over(by).alias("old_type"), F.lead("n").over(by).alias("after"))
    nothing = F.lit(None).cast("string")
    beside = F.col("before") == F.col("n") - 1
    moves = F.filter(F.array(
        F.when((F.col("n") > 1) & ~F.coalesce(beside, F.lit(False)), F.struct(F.lit("start").alias("kind"), F.col("n").alias("n"))),
        F.when((F.col("n") < F.col("last")) & ~F.coalesce(F.col("after") == F.col("n") + 1, F.lit(False)), F.struct(F.lit("end").alias("kind"), (F.col("n") + 1).alias("n"))),
        F.when(beside & ~_same(F.col("type"), F.col("old_type")), F.struct(F.lit("typed").alias("kind"), F.col("n").alias("n"))),
    ), lambda x: x.isNotNull())
    moved = cut(step.select("series_id", "parent", "path", "type", F.explode(moves).alias("m")).select("series_id", "m.n", "m.kind", "parent", "path", "type"))
    starts, ends = moved.where("kind = 'start'").drop("kind"), moved.where("kind = 'end'").select("series_id", "n", "parent", F.col("path").alias("old_path"), F.col("type").alias("old_type"))
    pairs = cut(starts.join(ends, ["series_id", "n", "parent"]).where(_same(F.col("type"), F.col("old_type"))).select("series_id", "n", "path", "old_path"))
    agree = cut(_agreeing(drift, pairs))
    renames = agree.select("series_id", "n", "path").distinct().join(_matched(agree), ["series_id", "n", "path"], "left").select("series_id", "n", "path", "old_path", F.lit("renamed").alias("change_kind"))
    # of one field at one file a start, an end or a change of type: those that agree are said above
    new = agree.select("series_id", "n", "path", F.lit("start").alias("kind")).unionByName(agree.select("series_id", "n", F.col("old_path").alias("path"), F.lit("end").alias("kind"))).distinct()
    said = {"start": "added", "end": "removed", "typed": "type_changed"}
    plain = moved.join(new, ["series_id", "n", "path", "kind"], "left_anti").select("series_id", "n", "path", nothing.alias("old_path"), F.create_map(*[F.lit(x) for kv in said.items() for x in kv])[F.col("kind")].alias("change_kind"))
    left = new.where("kind = 'end'").select("series_id", "n", "path", nothing.alias("old_path"), F.lit("renamed_from").alias("change_kind"))
    return plain.unionByName(renames).unionByName(left)


def changes(drift: Drift) -> DataFrame:
    """Every change of a file against the file before it in its series.

    Columns: series_id, n, file_name, field_path, old_path, change_kind (added,
    removed, renamed, type_changed). old_path is null unless renamed, and where
    a renamed field's vanished partners all went to other new fields. Nothing is
    reported below a field that itself appeared, vanished or changed type. The
    first file of a series reports nothing. Null and empty payloads count as
    unreadable; an empty table gives no row; redelivered rows and extra columns
    change nothing.
    """
    every = cut(raw_changes(drift))
    moved = every.select("series_id", "n", "path").unionByName(every.where("old_path IS NOT NULL").select("series_id", "n", F.col("old_path").alias("path"))).distinct()
    parts = F.split("path", "\\.")
    above = F.expr("transform(sequence(1, size(parts) - 1), i -> array_join(slice(parts, 1, i), '.'))")
    below = (
        moved.withColumn("parts", parts).where(F.size("parts") > 1)
        .select("series_id", "n", "path", F.explode(above).alias("above"))
        .join(moved.select("series_id", "n", F.col("path").alias("above")), ["series_id", "n", "above"], "left_semi").select("series_id", "n", "path").distinct()
    )
    per = Window.partitionBy("series_id").orderBy("written_at", "file_name")
    names = drift.seen.where("path = ''").groupBy("series_id", "file_name").agg(F.min("written_at").alias("written_at")).select("series_id", "file_name", F.row_number().over(per).alias("n"))
    top = every.where("change_kind <> 'renamed_from'").join(below, ["series_id", "n", "path"], "left_anti").join(names, ["series_id", "n"])
    return top.select("series_id", "n", "file_name", F.col("path").alias("field_path"), "old_path", "change_kind")


def aliases(found: DataFrame) -> DataFrame:
    """series_id, path, canonical: each renamed field under the oldest name of its chain.

    Of a field renamed more than once the first time counts, and a chain goes on
    only to earlier renames, so it ends even where names come back. Chains are
    followed by doubling until none goes on.
    """
    renamed = found.where("change_kind = 'renamed' AND old_path <> field_path")
    first = F.min(F.struct("n", "old_path"))
    link = cut(renamed.groupBy("series_id", F.col("field_path").alias("path")).agg(first.alias("x")).select("series_id", "path", F.col("x.old_path").alias("canonical"), F.col("x.n").alias("from"), F.col("x.n").alias("to")))
    while True:
        up = link.select("series_id", F.col("path").alias("canonical"), F.col("canonical").alias("further"), F.col("from").alias("next"), F.col("to").alias("end"))
        on = F.col("next") < F.col("to")
        link = cut(link.join(up, ["series_id", "canonical"], "left").select("series_id", "path", F.when(on, F.col("further")).otherwise(F.col("canonical")).alias("canonical"), "from", F.when(on, F.col("end")).otherwise(F.col("to")).alias("to"), F.coalesce(on, F.lit(False)).alias("moved")))
        if link.where("moved").isEmpty():
            return link.select("series_id", "path", "canonical")


def consistent(drift: Drift, producer: Column | None = None) -> DataFrame:
    """One consistent table: a row per record and canonical field, each value cast to the field's one type.

    Columns: file_name, record_key, field, type, value. Fields are the leaves:
    scalars, arrays, objects that map texts to numbers, and empty ones. A field takes its
    canonical name from the alias table (the longest renamed prefix of its path
    counts) and its one type from all types it ever had with its ``producer``
    (an expression of series_id, by default that itself): the common one, string
    where scalars differ, json where containers differ from scalars. Records
    without a key stay under a null key.
    """
    alias = aliases(changes(drift))
    rows = fields(drift.df, whole=True).where("value IS NOT NULL").select("series_id", "file_name", "record_key", "path", "type", "value")
    known = drift.catalogue.select("series_id", "file_name", "path", "map")
    one = rows.distinct().join(known, ["series_id", "file_name", "path"]).where("type <> 'object' OR map OR value = '{}'").drop("map")
    # canonical names of the paths, which are few, and not of the records' rows
    parts = drift.catalogue.select("series_id", "path").distinct().withColumn("parts", F.split("path", "\\."))
    prefixes = parts.withColumn("prefix", F.explode(F.expr("transform(sequence(1, size(parts)), i -> array_join(slice(parts, 1, i), '.'))")))
    hit = prefixes.join(alias.withColumnRenamed("path", "prefix"), ["series_id", "prefix"])
    best = hit.groupBy("series_id", "path").agg(F.max_by(F.struct("prefix", "canonical"), F.length("prefix")).alias("b"))
    names = cut(best.select("series_id", "path", F.concat(F.col("b.canonical"), F.expr("substring(path, length(b.prefix) + 1)")).alias("name")))
    named = one.join(small_side(names), ["series_id", "path"], "left")
    series = F.col("series_id") if producer is None else producer
    named = cut(named.select(series.alias("producer"), "file_name", "record_key", F.coalesce("name", "path").alias("field"), "type", "value"))
    kinds = named.where(~F.col("type").contains("void")).groupBy("producer", "field").agg(F.collect_set("type").alias("types"))
    container = F.exists("types", lambda t: t.startswith("array") | (t == "object"))
    one_type = F.when(F.size("types") == 1, F.col("types")[0]).when(container, "json").otherwise("string")
    plain = F.when(F.col("type") == "string", F.expr("try_cast(try_parse_json(value) AS STRING)")).otherwise(F.col("value"))
    typed = cut(kinds.select("producer", "field", one_type.alias("one_type")))
    return named.join(small_side(typed), ["producer", "field"], "left").select(
        "file_name", "record_key", "field", F.coalesce("one_type", "type").alias("type"),
        F.when(F.col("one_type").isin("json", "object") | F.col("one_type").startswith("array"), F.col("value")).otherwise(plain).alias("value"))
