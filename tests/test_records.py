"""Shredding, percentiles and drift on small fixtures, against plain Python."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.operators import drift, envelopes
from pairlens.functions import json_text
from pairlens.operators.shred import MAX_PATH, adjacency, entities

ENV = "envelope_id long, payload string, v int, m string, `open` boolean"


def env_rows(*payloads):
    return [(i, p if isinstance(p, str) or p is None else json.dumps(p, ensure_ascii=False), 1, "x", True) for i, p in enumerate(payloads)]


def found(spark, *payloads):
    df = spark.createDataFrame(env_rows(*payloads), ENV)
    return sorted((r[0], r[1]) for r in envelopes.nodes_found(df).collect())


def test_nodes_of_every_shape(spark):
    record = {"answer_probs": {"a/b": 0.1, "c": None}, "cluster_info": {"clusters": [[0, None, 2], [], None], "cluster_probs": [0.5, None]}}
    got = found(spark, {"detailed_results": [None, record], "prediction_differences": {"answer_probs": [{"answer": "x", "prob": None}, None, {"answer": "x", "prob": 1}]}})
    base = "detailed_results/1"
    assert got == sorted((0, p) for p in [
        base, f"{base}/answer_probs/a/b", f"{base}/answer_probs/c", f"{base}/cluster_info/clusters/0", f"{base}/cluster_info/clusters/0/0",
        f"{base}/cluster_info/clusters/0/2", f"{base}/cluster_info/clusters/1", f"{base}/cluster_info/cluster_probs/0",
        "prediction_differences/0", "prediction_differences/0/answer_probs/x"])


def test_answers_named_like_unused_subtrees(spark):
    names = ("config", "statistics", "options", "labels", "cluster_sizes", "cluster_info", "answer_probs")
    unused = {"options": ["a"], "labels": {"x": 1}, "cluster_sizes": [1], "cluster_info": {"labels": [0], "cluster_sizes": [1], "clusters": [[4]]}}
    shapes = ({n: 0.5 for n in names}, [{"answer": n, "prob": 0.5} for n in names])
    places = ({"config": {"detailed_results": [{}]}, "statistics": {}, "detailed_results": [unused | {"answer_probs": p}], "prediction_differences": unused | {"answer_probs": p}} for p in shapes)
    df = spark.createDataFrame(env_rows(*places), ENV)
    want = {f"{r}/0{p}" for r in envelopes.LISTS for p in ("", "/cluster_info/clusters/0", "/cluster_info/clusters/0/0", *(f"/answer_probs/{n}" for n in names))}
    got = [(r[0], r[1]) for r in envelopes.nodes_found(df).collect()]
    assert sorted(got) == sorted((i, p) for i in (0, 1) for p in want)
    answers = envelopes.of_entity(df, "answer", "answer", "value").collect()
    assert sorted((r["envelope_id"], r["answer"], r["value"]) for r in answers) == sorted((i, n, "0.5") for i in (0, 1) for n in names for _ in range(2))


def test_unreadable_null_and_empty_payloads(spark):
    assert found(spark, None, "", "{", "[1]", "null", '{"detailed_results": null}', {"detailed_results": []}) == []
    assert found(spark) == []


def test_redelivered_and_keyless_envelopes(spark):
    p = json.dumps({"detailed_results": [{"id": "q"}]})
    df = spark.createDataFrame([(1, p, 1, "", True), (1, p, 2, "", True), (None, p, 1, "", True)], ENV)
    assert [(r[0], r[1]) for r in envelopes.nodes_found(df).collect()] == [(1, "detailed_results/0")]


def test_parents_exist(spark):
    df = spark.createDataFrame(env_rows({"detailed_results": [{"answer_probs": {"a": 1}, "cluster_info": {"clusters": [[1]]}}]}), ENV)
    rows = {r["node_path"]: r["parent_path"] for r in envelopes.parts(df).collect()}
    assert all(parent in rows or parent == "detailed_results" for parent in rows.values())


def test_adjacency_links_and_entities(spark):
    df = spark.createDataFrame(env_rows({"a": [{"b": 1, "c": {"d": "x"}}], "k~/": True}), ENV)
    nodes = adjacency(df, "envelope_id", "payload")
    got = {r["node_id"]: (r["parent_id"], r["kind"], r["scalar"], r["ordinal"]) for r in nodes.collect()}
    assert got["a/0/b"] == ("a/0", "number", "1", None) and got["a/0"] == ("a", "object", None, 0) and got["k~0~1"][1:3] == ("boolean", "true")
    assert {r["node_id"]: r["b"] for r in entities(nodes, "envelope_id", ["b"]).collect()} == {"": None, "a/0": "1", "a/0/c": None}


def test_deep_documents_and_odd_strings(spark):
    df = spark.createDataFrame(env_rows('{"a":' * 200 + "1" + "}" * 200, '{"x": "\\ud800", "n": 1.50, "e": 1e400}'), ENV)
    rows = adjacency(df, "envelope_id", "payload").collect()
    assert max(r["depth"] for r in rows) == 200
    assert {r["label"]: r["scalar"] for r in rows if r["envelope_id"] == 1 and r["depth"]} == {"x": "\ufffd", "n": "1.50", "e": "1e400"}


def test_very_deep_documents_keep_their_nodes(spark):
    deep = '{"a":[' * 50_000 + "7" + "]}" * 50_000
    df = spark.createDataFrame(env_rows(deep, '{"detailed_results": [{"deep": ' + deep + ', "answer_probs": {"x": 1}}]}', deep + "}"), ENV)
    nodes = adjacency(df, "envelope_id", "payload")
    rows = {r["node_id"]: r for r in nodes.where("envelope_id = 0").collect()}
    assert len(rows) == 100_001 and max(len(i) for i in rows) <= MAX_PATH
    assert all(r["parent_id"] in rows for i, r in rows.items() if r["depth"]) and [r["scalar"] for r in rows.values() if r["depth"] == 100_000] == ["7"]
    assert nodes.where("envelope_id = 2").isEmpty()
    assert [r["node_path"] for r in envelopes.nodes_found(df).orderBy("node_path").collect()] == ["detailed_results/0", "detailed_results/0/answer_probs/x"]
    got = drift.changes(drift.Drift(raw(spark, [[("a", {"x": 1})], [("a", deep)], [("a", deep.replace("7", "8"))]]))).collect()
    assert {(r["file_name"], r["field_path"], r["change_kind"]) for r in got} == {("f8", "x", "removed"), ("f8", "a", "added")}


def test_very_long_answer_texts(spark):
    long = "word / " * 2_000
    got = found(spark, {"detailed_results": [{"answer_probs": {long: 0.5}}]}, {"detailed_results": [{"answer_probs": [{"answer": long, "prob": 0.5}]}]})
    assert got == sorted((i, p) for i in (0, 1) for p in ("detailed_results/0", f"detailed_results/0/answer_probs/{long}"))


def test_what_is_no_json_is_unreadable(spark):
    assert found(spark, '{"detailed_results": [{"x": NaN}]}', '{"detailed_results": [{"x": -Infinity}]}') == []
    assert changed(spark, [("a", {"x": 1})], [("a", '{"x": NaN}')], [("a", {"x": 1})]) == [("f7", "x", "added"), ("f8", "x", "removed")]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.sampled_from([None, 1]))
def test_reading_by_stack_equals_the_usual_reader(value, indent):
    text = json.dumps(value, indent=indent)
    assert json_text._by_stack(text, lambda s, whole: int(s) if whole else float(s)) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "01", "1.", "nul", '"a', "[1]]", '{1:2}', "{]", "[}"])
def test_reading_by_stack_refuses(text):
    with pytest.raises(ValueError):
        json_text._by_stack(text, lambda s, whole: s)


def test_repeated_keys_take_the_last(spark):
    df = spark.createDataFrame(env_rows('{"a": 1, "a": 2}'), ENV)
    assert [r["scalar"] for r in adjacency(df, "envelope_id", "payload").where("label = 'a'").collect()] == ["2"]


RAW = "series_id string, file_name string, written_at timestamp, record_key string, payload string, n int, path string"


def raw(spark, files):
    """files: lists of (key, payload) in order of time."""
    rows = []
    for i, records in enumerate(files):
        for key, p in records:
            rows.append(("s", f"f{9 - i}", dt.datetime(2026, 1, 1 + i), key, p if isinstance(p, str) or p is None else json.dumps(p), 0, "z"))
    return spark.createDataFrame(rows, RAW)


def changed(spark, *files):
    return sorted((r["file_name"], r["field_path"], r["change_kind"]) for r in drift.changes(drift.Drift(raw(spark, files))).collect())


def test_added_removed_and_below(spark):
    got = changed(spark, [("a", {"x": 1, "o": {"p": 1}})], [("b", {"x": 1, "n": {"q": {"r": 1}}})])
    assert got == [("f8", "n", "added"), ("f8", "o", "removed")]


def test_rename_needs_equal_values_and_a_common_record(spark):
    assert changed(spark, [("a", {"x": 1, "k": 0})], [("a", {"y": 1, "k": 0})]) == [("f8", "y", "renamed")]
    assert changed(spark, [("a", {"x": 1})], [("a", {"y": 2})]) == [("f8", "x", "removed"), ("f8", "y", "added")]
    assert changed(spark, [("a", {"x": 1})], [("b", {"y": 1})]) == [("f8", "x", "removed"), ("f8", "y", "added")]
    assert changed(spark, [("a", {"x": 1}), ("b", {"x": 2})], [("a", {"y": 1}), ("b", {"k": 0})]) == [("f8", "k", "added"), ("f8", "x", "removed"), ("f8", "y", "added")]
    assert changed(spark, [("a", {"x": 1})], [("a", {"y": "1"})]) == [("f8", "x", "removed"), ("f8", "y", "added")]


def test_every_agreeing_pair_is_a_rename(spark):
    two = [("a", {"u": 0, "v": 0, "k": 1})], [("a", {"x": 0, "y": 0, "k": 1})]
    assert changed(spark, *two) == [("f8", "x", "renamed"), ("f8", "y", "renamed")]
    assert {(r["path"], r["canonical"]) for r in drift.aliases(drift.changes(drift.Drift(raw(spark, two)))).collect()} == {("x", "u"), ("y", "v")}
    assert changed(spark, [("a", {"u": 0, "k": 1})], [("a", {"x": 0, "y": 0, "k": 1})]) == [("f8", "x", "renamed"), ("f8", "y", "renamed")]
    assert changed(spark, [("a", {"u": {"p": 1}, "v": {"p": 1}})], [("a", {"x": {"p": 1}})]) == [("f8", "x", "renamed")]


def test_type_changes(spark):
    assert changed(spark, [("a", {"x": 1, "l": [1]})], [("a", {"x": "1", "l": ["1"]})]) == [("f8", "l", "type_changed"), ("f8", "x", "type_changed")]
    assert changed(spark, [("a", {"x": 1, "l": [1.5]})], [("a", {"x": 2.5, "l": [3, 4]})], [("a", {"x": 1, "l": []})]) == []
    assert changed(spark, [("a", {"x": {"y": 1}})], [("a", {"x": 1})]) == [("f8", "x", "type_changed")]


def test_text_maps_are_not_entered_and_nulls_are_absent(spark):
    assert changed(spark, [("a", {"p": {"An answer": 0.1}})], [("a", {"p": {"Another one": 0.2, "x": None}})]) == []
    assert changed(spark, [("a", {"x": None, "k": 1})], [("a", {"x": 3, "k": 1})]) == [("f8", "x", "added")]


def test_chains_of_names_have_no_limit(spark):
    found_ = spark.createDataFrame([("s", n, f"f{n}", f"x{n}", f"x{n - 1}", "renamed") for n in range(1, 400)] + [("t", 2, "f", "b", "a", "renamed"), ("t", 3, "f", "a", "b", "renamed")], "series_id string, n int, file_name string, field_path string, old_path string, change_kind string")
    got = {(r["series_id"], r["path"]): r["canonical"] for r in drift.aliases(found_).collect()}
    assert got == {("s", f"x{n}"): "x0" for n in range(1, 400)} | {("t", "b"): "a", ("t", "a"): "a"}


def test_unreadable_records_and_empty_table(spark):
    assert changed(spark, [("a", {"x": 1}), (None, "{"), (None, None), (None, "3")], [("a", {"x": 1}), (None, "")]) == []
    empty = drift.Drift(spark.createDataFrame([], RAW))
    assert drift.changes(empty).collect() == drift.lifespans(empty).collect() == drift.consistent(empty).collect() == []


def test_lifespans_and_one_table(spark):
    df = raw(spark, [[("a", {"x": 1})], [("a", {"y": 1})], [("a", {"y": "1"}), ("b", {"x": 5})]])
    made = drift.Drift(df)
    spans = {(r["path"], r["type"], r["first_n"], r["last_n"]) for r in drift.lifespans(made).collect()}
    assert spans == {("x", "number", 1, 1), ("x", "number", 3, 3), ("y", "number", 2, 2), ("y", "string", 3, 3)}
    one = sorted((r["file_name"], r["record_key"], r["field"], r["type"], r["value"]) for r in drift.consistent(made).collect())
    assert one == [("f7", "a", "x", "string", "1"), ("f7", "b", "x", "string", "5"), ("f8", "a", "x", "string", "1"), ("f9", "a", "x", "string", "1")]


def test_series_do_not_mix(spark):
    a = raw(spark, [[("a", {"x": 1})]])
    b = raw(spark, [[("a", {"y": 1})]]).withColumn("series_id", F.lit("t")).withColumn("file_name", F.lit("g"))
    assert drift.changes(drift.Drift(a.unionByName(b))).collect() == []
