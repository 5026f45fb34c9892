"""Containers and mixes: invariants and brute force."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import mixing, packing
from pairlens.llm.tokens import token_count

DOCS = "doc_id long, text string, source string, lane int, tokens string, p double"
SPECS = "container_id string, capacity_tokens int, h int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, 0, "", 0.5) for d, t, s in rows], DOCS)


def test_tokens_as_words_and_signs(spark):
    texts = ["", " \t\n", "a-b c", "It's 3.14…", "日本語 text_1", "x y z", "😀😀 ok", "é́ n̈", None, "a\x1cb\x85c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(token_count()).collect()]
    assert got == [None if t is None else len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=300), st.integers(1, 8))
def test_best_fit_never_overfills_and_takes_the_fullest(sizes, limit):
    fit, free = packing.BestFit(50, limit), {}
    for s in sizes:
        open_before = {n: f for f, ns in fit.by_free.items() for n in ns}
        number = fit.place(s)
        if number in open_before:
            assert open_before[number] == min(f for f in open_before.values() if f >= s)
        else:
            assert not any(f >= s for f in open_before.values())
        free[number] = free.get(number, 50) - s
        assert free[number] >= 0
        assert fit.open == sum(map(len, fit.by_free.values())) <= limit
        assert fit.mask == sum(1 << f for f in fit.by_free)


def test_every_document_is_placed_whole_or_split(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 90))), "s") for i in range(400)] + [(500, None, "s"), (501, "", None), (502, "w " * 1000, "s"), (0, "w", "s"), (None, "w", "s")]
    first = {}
    for d, t, _ in rows:
        first.setdefault(d, t)
    specs = spark.createDataFrame([("small", 20, 1), ("big", 64, 1), ("big", 64, 2), ("bad", 0, 1), (None, 5, 1)], SPECS)
    frame = docs(spark, [r for r in rows if r != (0, "w", "s")])
    placed = packing.pack(frame, specs, open_bins=4, lane_tokens=3000).collect()
    for name, capacity in (("small", 20), ("big", 64)):
        mine = [r for r in placed if r["container_id"] == name]
        used, pieces = {}, {}
        for r in mine:
            used[r["bin_no"]] = used.get(r["bin_no"], 0) + r["tokens"]
            pieces.setdefault(r["doc_id"], []).append(r)
        assert max(used.values()) <= capacity
        assert set(pieces) == {d for d, _, _ in rows if d is not None}
        for d, ps in pieces.items():
            total = len((first[d] or "").split())
            assert sum(p["tokens"] for p in ps) == total and len(ps) == max(1, -(-total // capacity))
        over = {r["doc_id"] for r in packing.oversize(packing.pack(frame, specs, 4, 3000)).where(f"container_id = '{name}'").collect()}
        assert over == {d for d, t in first.items() if d is not None and len((t or "").split()) > capacity}
    assert {r["container_id"] for r in placed} == {"small", "big"}


def test_more_kinds_than_a_thousand(spark):
    specs = spark.createDataFrame([(f"k{i}", 5 + i % 7, 0) for i in range(1_500)], SPECS)
    frame = docs(spark, [(i, "w " * (i % 9), "s") for i in range(12)])
    counts = packing.accounts(packing.pack(frame, specs, 4, 20), specs).collect()
    assert len(counts) == 1_500 and {(r["documents"], r["overfull"], r["split_in_vain"], r["broken"]) for r in counts} == {(12, 0, 0, 0)}


def test_nothing_to_pack(spark):
    specs = spark.createDataFrame([("small", 20, 1)], SPECS)
    assert packing.pack(docs(spark, []), specs).collect() == []
    assert packing.pack(docs(spark, [(1, "a", "s")]), specs.limit(0)).collect() == []


TARGETS = "mix_id string, source string, weight double, max_repeats int, total_fraction double, lane int"


def test_flight_keeps_sums():
    rng = np.random.default_rng(0)
    p, t = list(rng.uniform(0.1, 0.9, 3)), [5, 9, 20]
    before = sum(p), sum(x * y for x, y in zip(p, t))
    mixing.flight_step(p, t, 0.4)
    assert np.allclose((sum(p), sum(x * y for x, y in zip(p, t))), before) and any(x in (0.0, 1.0) for x in p)


def test_probabilities_stay_on_average():
    taken = np.zeros(12)
    for seed in range(3000):
        units = [(i, 10 + i, 0, 0.3) for i in range(12)]
        flown = list(mixing.fly(iter(units), seed))
        done, rest = [u for u in flown if u[3] in (0.0, 1.0)], [u for u in flown if 0 < u[3] < 1]
        for u in done:
            taken[u[0]] += u[3]
        for u in rest:
            taken[u[0]] += u[3]
    assert np.abs(taken / 3000 - 0.3).max() < 0.05


def test_mix_reaches_targets_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 60), "big") for i in range(1500)] + [(2000 + i, "w " * 30, "small") for i in range(10)] + [(3000 + i, "w " * 20, None) for i in range(100)] + [(4000, None, "big"), (4001, "", "small")]
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.5, 0), ("m", "small", 0.4, 3, 0.5, 0), ("m", "none", 0.1, 9, 0.5, 0), (None, "big", 1.0, 1, 1.0, 0), ("z", "big", -1.0, 1, 1.0, 0)], TARGETS)
    made = mixing.Mix(docs(spark, rows), targets, lane_docs=400)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    shares = {(r["mix_id"], r["source"]): r for r in made.shares().collect()}
    assert abs(shares["m", "big"]["actual_tokens"] - 0.25 * total) <= 60
    assert shares["m", "small"]["actual_tokens"] == 900 and shares["m", "none"]["actual_tokens"] == 0 == shares["z", "big"]["actual_tokens"]
    short = {k for k, r in shares.items() if r["short"]}
    assert short == {("m", "small"), ("m", "none")}
    copies = {(r["source"], r["doc_id"]): r["copies"] for r in made.chosen.where("mix_id = 'm'").collect()}
    assert max(v for (s, _), v in copies.items() if s == "big") == 1 and all(v == 3 for (s, _), v in copies.items() if s == "small")


def test_lanes_in_levels_reach_the_target(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 40), f"s{i % 2}") for i in range(900)]
    targets = spark.createDataFrame([("m", f"s{k}", 0.5, 1, 0.4, 0) for k in range(2)], TARGETS)
    made = mixing.Mix(docs(spark, rows), targets, lane_docs=9)
    total = sum(len(t.split()) for _, t, _ in rows)
    for r in made.shares().collect():
        assert abs(r["actual_tokens"] - 0.2 * total) <= 40, r


def test_equal_and_repeated_documents(spark):
    targets = spark.createDataFrame([("m", "s", 1.0, 2, 0.5, 0)], TARGETS)
    chosen = mixing.mix(docs(spark, [(i, "a b c", "s") for i in range(100)] * 2), targets).chosen.collect()
    assert sum(r["copies"] for r in chosen) == 50


def test_empty_mix(spark):
    targets = spark.createDataFrame([("m", "s", 1.0, 2, 0.5, 0)], TARGETS)
    assert mixing.mix(docs(spark, []), targets).chosen.collect() == []
    assert mixing.mix(docs(spark, [(1, "a", "s")]), targets.limit(0)).shares().collect() == []
