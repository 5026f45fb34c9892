"""Percentiles from sketches, against exact ones."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import percentiles
from pairlens.llm.req_sketch import ReqSketch

@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0.001, 1e6), min_size=1, max_size=3000), st.integers(1, 5))
def test_sketch_is_within_its_error(values, parts):
    merged = ReqSketch(section=8)
    for chunk in np.array_split(np.array(values), parts):
        one = ReqSketch(section=8)
        one.add(chunk)
        merged.merge(ReqSketch.load(one.dump()))
    assert merged.count == len(values) == sum(len(x) << h for h, x in enumerate(merged.levels))
    ranked = np.sort(values)
    for q in (0.5, 0.95, 0.999):
        v, error = merged.quantiles([q])[0], merged.rank_error(q, 6) + 1 / len(values)
        low, high = np.searchsorted(ranked, v, "left") / len(values), np.searchsorted(ranked, v, "right") / len(values)
        assert low - error <= q <= high + error


def test_small_sketch_is_exact():
    s = ReqSketch()
    s.add(np.arange(1.0, 101.0))
    assert s.exact and list(s.quantiles([0.5, 0.95, 1.0])) == [50.0, 95.0, 100.0]
    assert np.isnan(ReqSketch().quantiles([0.5])[0])


def timings(spark, rows):
    return spark.createDataFrame(rows, "timing_id long, run_id string, sampler string, run_day date, elapsed_ms double, n long, sketch string")


def test_skewed_groups_and_merging_days(spark):
    rng, rows, values = np.random.default_rng(3), [], {}
    for g, tail in (("a", 30.0), ("b", 1.5)):
        for i in range(4000):
            v = float(rng.exponential() + 1) * (tail if i % 8 == 0 else 1)
            values.setdefault(g, []).append(v)
            rows.append((len(rows), "r", g, dt.date(2026, 1, 1 + i % 3), v, 0, ""))
    rows += [(10_000, "r", "a", None, None, 0, ""), (10_001, "r", "a", None, float("nan"), 0, ""), (10_002, "r", "b", None, float("inf"), 0, ""), (10_003, "r", "b", None, -5.0, 0, "")]
    rows += rows[:500]
    once = percentiles.once(timings(spark, rows), "timing_id", "run_id", "sampler", "run_day", "elapsed_ms")
    assert [tuple(r) for r in percentiles.skewed_groups(once, ("run_id", "sampler"), "elapsed_ms", section=8).collect()] == [("r", "a")]
    daily = percentiles.sketches(once, ("run_id", "sampler", "run_day"), "elapsed_ms")
    got = {r["sampler"]: r for r in percentiles.estimates(percentiles.merge(daily, ("run_id", "sampler")), ("run_id", "sampler"), (50, 95)).collect()}
    for g in values:
        assert got[g]["n"] == 4000
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert got[g][name + "_lo"] <= np.quantile(values[g], q, method="inverted_cdf") <= got[g][name + "_hi"]


def test_undecided_groups_are_settled_exactly(spark):
    rows = [(i, "r", "edge", None, v, 0, "") for i, v in enumerate([1.0] * 600 + [5.0] * 339 + [5.0001] * 61 + [2.0] * 200)]
    rows += [(5000 + i, None, "under", None, v, 0, "") for i, v in enumerate([1.0] * 700 + [5.0] * 500)]
    found = percentiles.skewed_groups(timings(spark, rows), ("run_id", "sampler"), "elapsed_ms", section=4).collect()
    want = []
    for key in (("r", "edge"), (None, "under")):
        v = np.sort([r[4] for r in rows if (r[1], r[2]) == key])
        if v[int(np.ceil(len(v) * 0.95)) - 1] > 5 * v[int(np.ceil(len(v) * 0.5)) - 1]:
            want.append(key)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_percentiles_of_nothing(spark):
    assert percentiles.skewed_groups(timings(spark, []), ("run_id", "sampler"), "elapsed_ms").collect() == []


def test_exact_percentiles_of_any_group(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.lognormal(size=5000), "ties": np.repeat([1.0, 2.0, 3.0], 700), "one": np.array([4.5]), None: rng.integers(1, 9, 900).astype(float)}
    rows = [(i, "r", g, None, float(v), 0, "") for g, vs in groups.items() for i, v in enumerate(vs)]
    df, keys, percents = timings(spark, rows), ("run_id", "sampler"), (0, 50, 95, 99.9, 100)
    bounds = percentiles.estimates(percentiles.sketches(df, keys, "elapsed_ms", section=4), keys, percents)
    got = {(r["sampler"], r["percent"]): r["value"] for r in percentiles.exact(df, keys, "elapsed_ms", bounds, percents).collect()}
    assert got == {(g, float(p)): float(np.sort(v)[max(1, int(np.ceil(len(v) * p / 100 - 1e-9))) - 1]) for g, v in groups.items() for p in percents}


def test_many_groups_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(percentiles, "HELD_BYTES", 5_000)
    rows = [(i, "r", f"g{i % 300}", None, float(1 + i % 7), 0, "") for i in range(6000)]
    got = percentiles.estimates(percentiles.sketches(timings(spark, rows), ("run_id", "sampler"), "elapsed_ms"), ("run_id", "sampler"), (50,)).collect()
    assert len(got) == 300 and {r["n"] for r in got} == {20}
