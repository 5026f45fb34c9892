"""Evaluation, significance, sources, settings, streams."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from pairlens import config
from pairlens.errors import ConfigurationError, DataError
from pairlens.functions import statistics as st
from pairlens.operators import evaluation as ev
from pairlens.operators import outcomes, sequences
from pairlens.operators import significance as sig
from pairlens.plans import q_evaluation
from pairlens.sources import benchmark as bm
from pairlens.sources import event_log
from pairlens.sources import results as rs
from pairlens.streaming import decisions


def verdicts(spark, **by):
    return spark.createDataFrame([(i, s, i, bool(x)) for s, xs in by.items() for i, x in enumerate(xs)], "ctx_id long, sampler string, token_id long, correct boolean")


def counts(spark, c1, c2, n):
    return spark.createDataFrame([("a", "b", c1, c2, n)], "method1 string, method2 string, c1 long, c2 long, n long")


def test_wilson(spark):
    rows = spark.createDataFrame([(4, 5), (39, 50), (1448, 2000), (0, 0), (0, 3), (3, 3)], "c long, n long")
    low, high = st.wilson(F.col("c"), F.col("n"))
    got = [(round(r[0], 4), round(r[1], 4)) for r in rows.select(low, high).collect()]
    assert got[0] == (37.5528, 96.3777) and got[3] == (0.0, 0.0) and got[4][0] == 0.0 and got[5][1] == 100.0
    assert got[1] == pytest.approx((64.758, 87.246), abs=1e-3) and got[2] == pytest.approx((70.399, 74.315), abs=1e-3)


def test_paired_t_and_mcnemar(spark):
    x1 = [1] * 8 + [0] + [1] * 31 + [0] * 10
    x2 = [0] * 8 + [1] + [1] * 31 + [0] * 10
    pairs = sig.paired(verdicts(spark, a=x1, b=x2), ["a", "b"])
    t = sig.paired_t(pairs).withColumn("p", st.student_two_sided("t", "df")).collect()[0]
    assert t["n"] == 50 and t["t"] == pytest.approx(2.44694, abs=1e-5) and t["p"] == pytest.approx(0.0180, abs=5e-5)
    m = sig.mcnemar(pairs).withColumn("p", st.chi2_1_upper("statistic")).collect()[0]
    assert (m["b"], m["c"], m["statistic"], m["odds"]) == (8, 1, 4.0, 8.0) and m["p"] == pytest.approx(0.0455, abs=5e-5)
    same = sig.mcnemar(sig.paired(verdicts(spark, a=x1, b=x1), ["a", "b"])).collect()[0]
    assert (same["statistic"], same["odds"]) == (0.0, math.inf)
    assert sig.paired_t(sig.paired(verdicts(spark, a=x1, b=x1), ["a", "b"])).collect()[0]["t"] is None


def test_student_t_values():
    assert st.incomplete_beta(49 / 2, 0.5, 49 / (49 + 1.630**2)) == pytest.approx(0.1095, abs=1e-4)
    assert st.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)


def test_fisher_z_and_effect(spark):
    p = lambda *x: sig.fisher(counts(spark, *x)).collect()[0]["p_fisher"]
    assert p(39, 32, 50) == pytest.approx(0.185612, abs=1e-6) and p(1448, 1433, 2000) == pytest.approx(0.621924, abs=1e-6)
    assert p(0, 0, 0) == 1.0 and p(5, 5, 5) == pytest.approx(1.0) and p(3, 0, 3) == pytest.approx(0.1)
    row = sig.effect(sig.two_proportion_z(counts(spark, 39, 32, 50))).collect()[0]
    assert row["z"] == pytest.approx(1.542659, abs=1e-6) and row["d"] == pytest.approx(0.308532, abs=1e-6) and row["effect"] == "small"
    assert sig.two_proportion_z(counts(spark, 5, 5, 5)).collect()[0]["z"] == 0.0


def test_corrections_and_power(spark):
    rows = spark.createDataFrame([("m", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "method1 string, method2 string, p double")
    holm = {r["method2"]: r["p_holm"] for r in sig.corrected(rows, "p", "holm").collect()}
    assert [holm[str(i)] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [r["p_bonferroni"] for r in sig.corrected(rows, "p", "bonferroni").orderBy("method2").collect()] == pytest.approx([0.04, 0.16, 0.12, 0.02])
    with pytest.raises(ValueError):
        sig.corrected(rows, "p", "other")
    assert [st.required_n(e) for e in (0.2, 0.5, 0.8)] == [393, 63, 25]


def test_bootstrap(spark):
    rows = verdicts(spark, a=[1] * 60 + [0] * 40)
    one = sig.bootstrap(rows, 300).collect()[0]
    assert 0.45 < one["ci_low"] < 0.6 < one["ci_high"] < 0.75
    assert sig.bootstrap(rows.repartition(5), 300).collect()[0] == one


def test_accuracy_divergence_and_outcomes(spark):
    rows = spark.createDataFrame([(0, "greedy", 1, True), (0, "dcbs", 2, False), (1, "greedy", 1, False), (1, "dcbs", 2, True), (2, "greedy", 3, True), (2, "dcbs", 3, True), (3, "greedy", 1, False), (3, "dcbs", 4, False), (4, "greedy", 1, True)], "ctx_id long, sampler string, token_id long, correct boolean")
    assert {r["sampler"]: (r["correct"], r["total"]) for r in ev.accuracy(rows).collect()} == {"greedy": (3, 5), "dcbs": (2, 4)}
    assert {r["ctx_id"]: r["outcome"] for r in ev.differences(rows).collect()} == {0: "greedy_wins", 1: "dcbs_wins", 3: "both_wrong"}
    assert ev.divergence(rows).collect()[0]["divergence_pct"] == 75.0
    assert ev.divergence(rows.limit(0)).collect()[0]["divergence_pct"] == 0.0
    left = ev.remaining(rows, rows.where("ctx_id = 0"))
    assert left.count() == 7 and left.where("ctx_id = 0").count() == 0


def test_gold_and_token_match(spark):
    rows = spark.createDataFrame([(["a", "b"], "2"), (["a", "b"], "3"), (["a"], None), (None, "1"), (["a"], "x")], "o array<string>, c string")
    assert [r[0] for r in rows.select(ev.gold_answer(F.col("o"), F.col("c"))).collect()] == ["b", None, "a", None, "a"]
    cases = [(102, "test", "test", [102], True), (103, "multi", "multi token", [103, 104], True), (105, "answer", "multi token", [103, 104], False), (106, " Multi Token", "multi token", [103], True), (1, None, None, None, False)]
    df = spark.createDataFrame([c[:4] for c in cases], "p int, d string, a string, i array<int>")
    assert [r[0] for r in df.select(ev.token_match(*map(F.col, "pdai"))).collect()] == [c[4] for c in cases]


def test_read_examples(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps([{"id": "t1", "question": "q", "options": ["A", "B"], "correct_option": "1"}, {"id": "t2", "question": "q", "options": ["C", "D"], "correct_option": "2"}]))
    rows = bm.read_examples(spark, str(good)).select("id", ev.gold_answer(F.col("options"), F.col("correct_option")).alias("g")).collect()
    assert {r["id"]: r["g"] for r in rows} == {"t1": "A", "t2": "D"}
    with pytest.raises(FileNotFoundError):
        bm.read_examples(spark, str(tmp_path / "none.json"))
    for name, text in (("broken", "[{"), ("empty", "[]"), ("lacking", '[{"question": "q"}]')):
        (tmp_path / name).write_text(text)
        with pytest.raises(DataError):
            bm.read_examples(spark, str(tmp_path / name))


def test_standardize(spark):
    arc = spark.createDataFrame([("1", "q1", (["a", "b"], ["A", "B"]), "b"), ("2", "q2", (["a", "b"], ["1", "2"]), "9"), ("3", "q3", (["a", "b"], ["A", "B"]), None)], bm.RAW_ARC)
    hella = spark.createDataFrame([("ctx", ["x", "y"], "1", "lab", "a", "b")], bm.RAW_HELLASWAG)
    mmlu = spark.createDataFrame([("q", ["x", "y"], 0, "virology"), ("q", ["x", "y"], 0, "law")], bm.RAW_MMLU)
    every = bm.union_all([bm.standardize(arc, "arc_easy"), bm.standardize(hella, "hellaswag"), bm.standardize(mmlu, "mmlu_stem")])
    assert sorted((r["dataset"], r["correct_option"], r["correct_answer"]) for r in bm.accepted(every).collect()) == [("arc_easy", "2", "b"), ("hellaswag", "2", "y"), ("mmlu_stem", "1", "x")]
    assert bm.rejects(every).count() == 2 and bm.limit_each(every, 1).count() == 3
    with pytest.raises(ValueError):
        bm.spec_of("other")


def test_keys_and_letters(spark):
    df = spark.createDataFrame([(["A", "B"], "B", ["x", "y"]), (None, "b", ["x", "y"]), (["1", "2"], "2", ["x", "y"]), (["A"], "7", ["x"]), (None, None, ["x"])], "l array<string>, k string, o array<string>")
    assert [r[0] for r in df.select(bm.key_to_option(F.col("l"), F.col("k"), F.col("o"))).collect()] == ["2", "2", "2", "1", "1"]
    assert df.select(bm.lettered(F.col("o"))).first()[0] == "A. x\nB. y"
    text = df.select(bm.chat_text(bm.messages(F.lit("Q"), F.col("o"), F.lit("R")), bm.REASONED_LEAD)).first()[0]
    assert text.endswith("Assistant: The final answer is option") and "User: Q\n\nA. x\nB. y" in text and "Assistant: R" in text


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in bm.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_results_files(spark, tmp_path):
    import os

    for i, name in enumerate(("old", "new", "cut")):
        p = tmp_path / f"evaluation_results_{name}.json"
        p.write_text(json.dumps({"detailed_results": [{"id": name, "sampler": "greedy", "correct": True}]})[: 40 if name == "cut" else None])
        os.utime(p, (1_700_000_000 + i * 100,) * 2)
    assert [r["id"] for r in rs.latest_results(spark, str(tmp_path)).collect()] == ["new"]
    work = spark.createDataFrame([("r", str(i), s) for i in range(4) for s in ("a", "b")], "run_id string, id string, sampler string")
    store = rs.FinishedWork(spark, str(tmp_path / "done"))
    assert store.left(work).count() == 8
    store.add(work.where("id = '2'"))
    store.add(work.where("id = '2'"))
    assert store.left(work).count() == 6


def test_finished_work_by_run(spark, tmp_path):
    store = rs.FinishedWork(spark, str(tmp_path / "work"))
    rows = spark.createDataFrame([(f"r{i % 2}", str(i), "greedy") for i in range(5)], "run_id string, id string, sampler string")
    assert store.runs(rows).collect() == [] and not store.forget("r0")
    store.add(rows)
    assert {(r["run_id"], r["finished"]) for r in store.runs(rows).collect()} == {("r0", 3), ("r1", 2)}
    assert store.forget("r0") and [r["run_id"] for r in store.runs(rows).collect()] == ["r1"] and store.left(rows).count() == 3


def test_sample_instead_of_a_missing_file(spark, tmp_path):
    rows, sample = bm.examples_or_sample(spark, str(tmp_path / "none.json"))
    assert sample and all(int(r["correct_option"]) <= len(r["options"]) for r in rows.collect())
    (tmp_path / "some.json").write_text(json.dumps([{"id": "1", "question": "q", "options": ["a"], "correct_option": "1"}]))
    rows, sample = bm.examples_or_sample(spark, str(tmp_path / "some.json"))
    assert not sample and rows.count() == 1


def test_caches_of_keys_last_used(spark):
    rows = spark.createDataFrame([("u", i, k) for i, k in enumerate(["a", "b", "a", "c", "b", None, None, "a"])] + [(None, 0, "a"), (None, 1, "a")], "u string, t int, k string")
    got = {(r["u"], r["t"]): r["hit"] for r in sequences.lru_hits(rows, "u", ["t"], "k", 2).collect()}
    assert got == {("u", i): i in (2, 6) for i in range(8)} | {(None, 0): False, (None, 1): True}
    timed = spark.createDataFrame([("u", dt.datetime(2026, 1, 1, 0, 0, s), "a") for s in (0, 5, 9, 16, 20)], "u string, at timestamp, k string")
    assert [r["hit"] for r in sequences.lru_hits(timed, "u", ["at"], "k", 2, "at", 10).orderBy("at").collect()] == [False, True, True, False, True]
    with pytest.raises(ValueError):
        sequences.lru_hits(rows, "u", ["t"], "k", 0)


def test_latest_compatible(spark):
    s = spark.createDataFrame([("a", None, 5, "t1"), ("b", None, 9, "t0"), ("c", 3, 99, "t9"), ("d", None, 9, "t2")], "run string, k int, completed int, timestamp string")
    assert rs.latest_compatible(s, {"k": None}).collect()[0]["run"] == "d"
    assert rs.latest_compatible(s, {"k": 8}).collect() == []


def test_markdown(spark):
    rows = spark.createDataFrame([("b", 1.5), ("a", None)], "name string, x double")
    assert [r["line"] for r in rs.markdown(rows, ["name", "x"], ["name"]).orderBy("n").collect()] == ["| name | x |", "| - | - |", "| a |  |", "| b | 1.5 |"]


def log(spark):
    def end(i, n, g, d):
        return json.dumps({"event_type": "sequence_end", "run_id": "r", "sequence_id": f"s{i}", "disagreement_count": n, "correctness": {"greedy_correct": g, "dcbs_correct": d}})

    token = lambda i: json.dumps({"event_type": "token_disagreement", "run_id": "r", "sequence_id": f"s{i}", "timestep": 0})
    return [json.dumps({"event_type": "run_start", "run_id": "r"}), token(0), end(0, 1, True, False), token(1), token(1), end(1, 2, False, True), token(2), end(2, 1, True, True), token(3), end(3, 1, False, False), end(4, 0, True, True), "broken"]


def test_event_log_batch_and_stream_agree(spark, tmp_path):
    lines = log(spark)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text("\n".join(lines[:4]))
    events = lambda: event_log.read(spark, str(tmp_path / "log"))
    stream = lambda: event_log.stream(spark, str(tmp_path / "log"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    decisions.ingest(decisions.sequences(stream()), out, state).awaitTermination()
    (tmp_path / "log" / "2.json").write_text("\n".join(lines[4:]))
    decisions.ingest(decisions.sequences(stream()), out, state).awaitTermination()
    closed = {r["sequence_id"]: (r["logged"], r["counted"], r["outcome"]) for r in spark.read.parquet(out).collect()}
    assert closed == {"s0": (1, 1, "greedy_wins"), "s1": (2, 2, "dcbs_wins"), "s2": (1, 1, "both_correct"), "s3": (1, 1, "both_wrong"), "s4": (0, 0, None)}
    decisions.to_table(decisions.running_outcomes(stream()), "running", str(tmp_path / "state2"))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, outcomes.by_outcome(events()).collect()))
    c = outcomes.counters(events()).collect()[0]
    assert (c["sequences"], c["sequences_with"], c["tokens_logged"], c["greedy_wins"], c["dcbs_wins"], c["both_correct"], c["both_wrong"]) == (5, 4, 5, 1, 1, 1, 1)
    assert c["token_disagreements_per_sequence"] == 1.0 and c["sequence_disagreement_pct"] == 80.0
    assert all(r["agrees"] for r in outcomes.drift(events()).collect())


def test_late_events_and_expiry(spark, tmp_path):
    line = lambda kind, i, **more: json.dumps({"event_type": kind, "run_id": "r", "sequence_id": f"s{i}", **more})
    end = {"disagreement_count": 1, "correctness": {"greedy_correct": True, "dcbs_correct": False}}
    (tmp_path / "log").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    go = lambda: decisions.ingest(decisions.sequences(event_log.stream(spark, str(tmp_path / "log"))), out, state).awaitTermination()
    for n, lines in enumerate(([line("token_disagreement", 0), line("sequence_end", 0, **end), line("token_disagreement", 1)], [line("token_disagreement", 0), line("token_disagreement", 0), line("sequence_end", 1, **end)], [line("sequence_end", 0, **end)])):
        (tmp_path / "log" / f"{n}.json").write_text("\n".join(lines))
        go()
    rows = sorted((r["sequence_id"], r["kind"], r["logged"], r["closed"]) for r in spark.read.parquet(out).collect())
    assert rows == [("s0", "ended", 1, True), ("s0", "late", 0, True), ("s0", "late", 2, False), ("s1", "ended", 1, True)]


def test_a_stream_that_failed_goes_on_where_it_was(spark, tmp_path):
    """A batch whose sink failed is done again, and each event counts once."""
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"event_type": "token_disagreement", "run_id": "r", "sequence_id": f"s{i}"}) for i in range(6)]
    (tmp_path / "log" / "1.json").write_text("\n".join(lines[:3]))
    out, state, fail = str(tmp_path / "out"), str(tmp_path / "state"), [True]

    def sink(batch, number):
        # a rewritten batch replaces what it left behind
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if fail.pop() if fail else False:
            raise RuntimeError("lost")

    run = lambda: event_log.stream(spark, str(tmp_path / "log")).select("sequence_id").writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    (tmp_path / "log" / "2.json").write_text("\n".join(lines[3:]))
    run()
    assert sorted(r["sequence_id"] for r in spark.read.parquet(out).collect()) == [f"s{i}" for i in range(6)]


def test_sequences_that_never_ended_are_kept(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(log(spark)[:2]))
    got = outcomes.drift(event_log.read(spark, str(tmp_path / "l.json"))).collect()
    assert [(r["sequence_id"], r["counted"], r["logged"], r["agrees"]) for r in got] == [("s0", None, 1, False)]


def test_first_examples_of_a_group(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(60)], "g string, t int")
    got = sorted(((r["g"] or "", r["t"], r["more"]) for r in outcomes.examples(rows, "g", "t", 2).collect()))
    assert got == [("", 0, 18), ("", 3, 18), ("a", 1, 38), ("a", 2, 38)]
    assert "WindowGroupLimit" in outcomes.examples(rows, "g", "t", 2)._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(v,) for v in [5, 3, 9, 1, None, 3] * 20], "v int").repartition(5)
    got = sequences.in_order(rows, ["v"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(120)) and [r["v"] for r in got] == sorted((r["v"] for r in got), key=lambda v: (v is not None, v))
    assert sequences.in_order(rows.limit(0), ["v"]).collect() == []


def test_datasets_are_loaded_by_name(spark, tmp_path):
    (tmp_path / "hellaswag.jsonl").write_text("\n".join(json.dumps({"ctx": f"c{i}", "endings": ["a", "b"], "label": str(i % 3)}) for i in range(4)))
    (tmp_path / "mmlu_stem.jsonl").write_text("\n".join(json.dumps({"question": f"q{i}", "choices": ["a", "b"], "answer": 1, "subject": s}) for i, s in enumerate(["anatomy", "law", "virology"])))
    assert [(r["question"], r["correct_option"], r["valid"]) for r in bm.load(spark, "hellaswag", str(tmp_path), 3).collect()] == [("c0", "1", True), ("c1", "2", True), ("c2", None, False)]
    rows, failed = bm.load_many(spark, "all", str(tmp_path))
    assert sorted(r["id"] for r in rows.collect()) == [*(f"hellaswag_{i}" for i in range(4)), "mmlu_stem_0", "mmlu_stem_1"] and set(failed) == {"arc_easy", "arc_challenge"}
    assert bm.load_many(spark, "other", str(tmp_path))[0] is None
    with pytest.raises(ValueError):
        bm.load(spark, "hellaswag", str(tmp_path), 0)


def test_lenient_shapes(spark):
    given = [{"id": "1", "question": "q", "choices": {"text": ["a", "b"], "label": ["1", "2"]}, "answerKey": "2"}, {"question": "q", "choices": {"choices": {"text": ["a", "b", "c"]}}, "answerKey": "C"}, {"id": "3", "choices": ["a", "b"], "answerKey": "2"}, {"id": "4", "choices": {"x": "a", "y": "b"}, "answerKey": "?"}, {"id": "5", "choices": 7}, {"id": "6"}]
    rows = spark.createDataFrame([(json.dumps(g),) for g in given] + [("{",), (None,)], "payload string")
    got = {r["id"]: (r["options"], r["choice_labels"], r["correct_option"]) for r in bm.lenient_arc(rows).collect()}
    assert got == {"1": (["a", "b"], ["1", "2"], "2"), "arc_3": (["a", "b", "c"], ["A", "B", "C"], "3"), "3": (["a", "b"], ["A", "B"], "2"), "4": (["a", "b"], ["A", "B"], "1")}


def test_tokens_of_labels(spark):
    vocabulary = spark.createDataFrame([(" A", 5), (" A", 4), ("B", 7), ("C.", 8), ("D", 10), (" D", 9), ("1", 11), ("x", 12)], "text string, token_id int")
    labels = spark.createDataFrame([(x,) for x in ("A", "B", "C", "D", "Q", "Z1", "x", "", None, "A")], "label string")
    assert {r["label"]: r["token_id"] for r in bm.answer_tokens(labels, vocabulary).collect()} == {"A": 4, "B": 7, "C": 8, "D": 9, "Q": 81, "Z1": 11, "x": 12}


def test_as_of_and_windows(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 4, None)], "k int, t int, v string")
    assert {(r["k"], r["t"]): r["v"] for r in sequences.as_of(left, right, "k", "t", "v").collect()} == {(1, 5): "x", (1, 1): None, (2, 9): None}
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(12)], "g string, t int, v double")
    assert [r["average"] for r in sequences.moving_average(rows, "g", ["t"], "v").orderBy("t").collect()] == [4.5, 5.5, 6.5]
    assert [r["t"] for r in sequences.every_nth(rows, "g", ["t"], 5).orderBy("t").collect()] == [4, 9]


def test_settings():
    env = {"HOME_DIR": "here", "PAIRLENS_LIMIT": "42", "PAIRLENS_CLUSTER_PARAMS_K": "5", "PAIRLENS_P_VALUES": "0.5,0.9"}
    got, unknown = config.validate({"benchmark": "${HOME_DIR}/${NAME:x}", "extra": 1}, env=env)
    assert got["benchmark"] == "here/x" and got["limit"] == 42 and got["cluster_params"] == {"k": 5, "top_n": 50, "cache_size": 1000} and got["p_values"] == [0.5, 0.9] and unknown == ["extra"]
    for bad in ({}, {"benchmark": "${MISSING}"}, {"benchmark": "b", "limit": 0}, {"benchmark": "b", "limit": True}, {"benchmark": "b", "clustering_method": "x"}, {"benchmark": "b", "p_values": [2.0]}):
        with pytest.raises(ConfigurationError):
            config.validate(bad, env={})
    assert config.merge({"a": 1, "g": {"x": 1, "y": 2}}, {"a": None, "g": {"x": 3}}) == {"a": 1, "g": {"x": 3, "y": 2}}
    assert ConfigurationError("m", {"a": 1}).to_dict()["kind"] == "configuration"


def test_settings_file(tmp_path):
    (tmp_path / "c.yaml").write_text("benchmark: b\ndbscan_eps: 1\n")
    got, _ = config.load(str(tmp_path / "c.yaml"), {"limit": 3, "log_level": None}, env={})
    assert got["dbscan_eps"] == 1.0 and got["limit"] == 3 and got["log_level"] == "INFO"
    with pytest.raises(ConfigurationError):
        config.load(str(tmp_path / "none.yaml"))


def test_bootstrap_query_runs_all_rounds(spark, monkeypatch):
    monkeypatch.setattr(q_evaluation, "results", lambda *_: verdicts(spark, a=[1] * 30 + [0] * 10))
    got = q_evaluation.bootstrap_ci(spark, "").collect()[0]
    assert got["rounds"] == 10_000 and 0.55 < got["ci_low"] < 0.75 < got["ci_high"] < 0.9
    assert tuple(q_evaluation.bootstrap_check(spark, "").collect()[0]) == ("a", 10_000, 75.0, True, True)


def test_top_answer_keeps_results_with_ties(spark, tmp_path):
    given = [(1, {"b": 0.5, "a": 0.5}), (2, {"z": 0.9, "x": 0.0, "y": 0.0}), (2, {"z": 0.9, "x": 0.0, "y": 0.0}), (3, {"c": 0.7, "d": None}), (4, {"e": None}), (5, None)]
    spark.createDataFrame(given, "result_id long, answer_probs map<string,double>").write.parquet(f"{tmp_path}/detailed_results.parquet")
    assert sorted(map(tuple, q_evaluation.top_answer(spark, str(tmp_path)).collect())) == [(1, "a", 0.5, 2), (2, "z", 0.9, 3), (3, "c", 0.7, 1)]


def test_resume_leaves_the_columns_and_keys_of_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, [1.0, float(i)], i) for i in (0, 1, 2, 3, 3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = [(u, f'{{"k": {k}}}', float(100 * k + u)) for u in range(7) for k in range(4)]
    spark.createDataFrame(events, "user_id long, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    left = q_evaluation.resume_antijoin(spark, str(tmp_path))
    assert left.dtypes == [("ctx_id", "bigint"), ("sampler", "string"), ("token_id", "int")]
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(q_evaluation.SQL["resume_antijoin"])
    assert left.columns == [c[0] for c in want.description]
    rows = sorted(map(tuple, left.collect()))
    assert rows == sorted(want.fetchall())
    assert {r[:2] for r in rows} == {(c, s) for c in range(7) for s in q_evaluation.NAMES if c % 3 or s not in ("greedy", "dcbs")}
