"""Candidates, samplers, clusters and cluster-aware selection: fixtures with known results, invariants, numpy references."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import category, clustering, samplers
from pairlens.operators import cluster_aware as ca
from pairlens.operators import logits as lg
from pairlens.plans import q_selection, relations

E = [(1, 0), (0.95, 0.05), (0, 1), (0.05, 0.95), (-1, 0), (0.7, 0.7)]
L = [1, 0.9, 1.2, 0.1, 1.25, -1]


def logits(spark, *contexts):
    rows = [(c, t, float(v)) for c, values in enumerate(contexts) for t, v in (values.items() if isinstance(values, dict) else enumerate(values))]
    return spark.createDataFrame(rows, "ctx_id long, token_id int, logit double")


def allowed(spark, *contexts):
    return spark.createDataFrame([(c, t) for c, ts in enumerate(contexts) for t in ts or ()], "ctx_id long, token_id int")


def emb(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "token_id int, vec array<double>")


def chosen(df):
    return {r["ctx_id"]: r["token_id"] for r in df.collect()}


def support(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["ctx_id"], set()).add(r["token_id"])
    return out


def test_greedy(spark):
    rows = logits(spark, [1, 3, 2, 0.5], [1, 3, 2, 0.5], [2, 2])
    assert chosen(samplers.greedy(rows)) == {0: 1, 1: 1, 2: 0}
    assert chosen(samplers.greedy(rows, allowed(spark, [0, 2]))) == {0: 2, 1: 1, 2: 0}
    assert chosen(samplers.greedy(rows, allowed(spark, []))) == {0: 1, 1: 1, 2: 0}
    assert chosen(samplers.greedy(rows, allowed(spark, [9]))) == {1: 1, 2: 0}


def test_bad_parameters(spark):
    rows = logits(spark, [1, 2])
    for bad in (lambda: lg.softmax(rows, 0), lambda: lg.softmax(rows, -1), lambda: samplers.top_k_support(rows, 0), lambda: ca.ClusterSpec(method="x"), lambda: samplers.run(rows, ["x"]), lambda: ca.select(rows, None)):
        with pytest.raises(ValueError):
            bad()


def test_supports(spark):
    rows = logits(spark, [1, 5, 2, 0.5, 4, 3])
    assert support(samplers.top_k_support(rows, 3)) == {0: {1, 4, 5}}
    assert support(samplers.top_k_support(rows, 3, allowed(spark, [1, 5]))) == {0: {1, 5}}
    assert support(samplers.top_k_support(rows, 2, allowed(spark, [3, 2]))) == {0: {2}}
    assert support(samplers.top_k_support(rows, 2, allowed(spark, [77]))) == {0: {1}}
    assert support(samplers.top_k_support(rows, 99)) == {0: set(range(6))}
    assert support(samplers.top_p_support(logits(spark, [10, 9, 1, 0.1], [1, 3, 2, 0.5]))) == {0: {0, 1}, 1: {1, 2, 0}}


def test_probabilities_sum_to_one_and_large_logits(spark):
    p = lg.softmax(logits(spark, [1000, 999], [-1e9, 0, 3])).groupBy("ctx_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in p)


def test_low_temperature_is_greedy_and_draws_follow_probabilities(spark):
    many = logits(spark, *[[1, 3, 2, 0.5]] * 400)
    assert set(chosen(samplers.temperature(many, 0.01)).values()) == {1}
    picks = np.bincount(list(chosen(samplers.temperature(many, 1.0)).values()), minlength=4) / 400
    assert np.abs(picks - np.exp([1, 3, 2, 0.5]) / np.exp([1, 3, 2, 0.5]).sum()).max() < 0.03
    assert set(chosen(samplers.random_(many)).values()) == {0, 1, 2, 3}
    assert chosen(samplers.temperature(many.repartition(7), 1.0)) == chosen(samplers.temperature(many, 1.0))


def test_not_finite_logits(spark):
    rows = logits(spark, [1, float("nan"), 3], [float("inf"), 1, 2])
    assert chosen(samplers.greedy(lg.finite(rows))) == {0: 2, 1: 2} and lg.rejected(rows).count() == 2
    with pytest.raises(Exception, match="not finite"):
        lg.strict(rows).collect()


def test_number_of_candidates(spark):
    uniform, small, peaked = [0.0] * 150, list(range(10)), {t: (50.0 if t == 0 else 0.0) for t in range(60)}
    sizes = {r["ctx_id"]: r["n"] for r in lg.dynamic_candidates(logits(spark, uniform, small, peaked), top=5).groupBy("ctx_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 100, 1: 5, 2: 20}
    assert lg.dynamic_candidates(logits(spark, uniform), top=7, dynamic=False).count() == 7
    wide = {t: (10.0 - t + 10 if 10 <= t < 20 else -100.0) for t in range(100)}
    assert support(lg.top_n_forced(logits(spark, wide), 5, [30, 40])) == {0: {10, 11, 12, 13, 14, 30, 40}}
    assert support(lg.candidates(logits(spark, [1, 2, 3], [1, 2, 3]), allowed(spark, [0]))) == {0: {0}, 1: {0, 1, 2}}


def test_components_and_scores_by_hand(spark):
    rows, vocab = logits(spark, L), emb(spark, E)
    for eps, clusters, scores, token in (
        (0.1, {0: 0.384647, 2: 0.328739, 4: 0.259285, 5: 0.027328}, {0: 0.316272, 2: 0.260453, 4: 0.141786, 5: -0.077590}, 0),
        (0.3, {0: 0.740715, 4: 0.259285}, {0: 0.709599, 4: 0.141786}, 2),
    ):
        spec = ca.ClusterSpec(method="dbscan", epsilon=eps)
        mass = category.confidence_score(category.mass(ca.clustered(rows, vocab, spec))).collect()
        assert {r["cluster_id"]: round(r["mass"], 6) for r in mass} == pytest.approx(clusters, abs=2e-6)
        assert {r["cluster_id"]: r["score"] for r in mass} == pytest.approx(scores, abs=2e-6)
        assert chosen(ca.select(rows, vocab, spec)) == {0: token}
    assert chosen(samplers.greedy(rows)) == {0: 4}


def test_components_are_per_context(spark):
    """Without the bridging token two clusters stay apart."""
    bridge = logits(spark, L, {t: v for t, v in enumerate(L) if t != 5})
    got = support(ca.clustered(bridge, emb(spark, E), ca.ClusterSpec(method="dbscan")).select("ctx_id", F.col("cluster_id").alias("token_id")))
    assert got == {0: {0, 4}, 1: {0, 2, 4}}


@pytest.mark.parametrize("eps,samples", [(0.3, 2), (0.6, 2), (0.6, 1)])
def test_components_equal_the_general_method(spark, eps, samples):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 5))
    rows = logits(spark, *[{int(t): float(rng.normal()) for t in rng.choice(60, 30, replace=False)} for _ in range(6)])
    cand = rows.withColumn("rank", F.row_number().over(lg.by_logit()))
    a = clustering.components(cand, clustering.epsilon_edges(emb(spark, vectors), eps))
    b = clustering.per_context(cand, emb(spark, vectors), lambda x: clustering.density(x, eps, samples))
    key = lambda df: sorted((r["ctx_id"], r["token_id"], r["cluster_id"]) for r in df.collect())
    assert key(a) == key(b)


def test_border_points_go_to_the_first_cluster():
    points = np.array([[np.cos(a), np.sin(a)] for a in np.radians([0, 4, 8, 12, 26, 40, 44, 48, 52, 180])])
    labels = clustering.density(points, 1 - math.cos(math.radians(15)), 4)
    assert labels[4] == labels[3] == labels[0] and labels[5] == labels[8] != labels[0] and labels[9] not in labels[:9]


def test_agglomerative_linkages():
    points = np.array([[np.cos(a), np.sin(a)] for a in np.radians([0, 2, 90, 92, 180])])
    for linkage in ("average", "complete", "single", "ward"):
        labels = clustering.agglomerative(points, 3, linkage)
        assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3
    with pytest.raises(ValueError):
        clustering.agglomerative(points, 2, "other")


def test_adaptive_k(spark):
    want = {4: 2, 9: 3, 20: 4, 50: 7, 51: 8, 1: 1, 2: 2}
    got = spark.createDataFrame([(n,) for n in want], "n long").withColumn("k", clustering.adaptive_k(F.col("n"), 8)).collect()
    assert {r["n"]: r["k"] for r in got} == want == {n: clustering.k_for(n, 8) for n in want}


def test_batch_goldens(spark):
    """Euclidean clusters of normalized vectors, the heaviest category; the bounded form takes vectors as they are."""
    vectors = [(0, 0), (0.1, 0), (0.2, 0), (10, 10), (10.1, 10.1), (20, 20)]
    a, b = [-1, -1.1, -1.2, 4, 3.9, 0.5], [0, 0.5, 0.8, -1, -1, 1]
    spec = ca.ClusterSpec(method="euclidean", category="greedy", clusters=2, top=5, dynamic=False, bypass=0)
    assert chosen(ca.select(logits(spark, a, b), emb(spark, vectors), spec)) == {0: 3, 1: 5}
    assert set(chosen(ca.select(logits(spark, *[a] * 6), emb(spark, vectors), spec)).values()) == {3}
    bounded = ca.ClusterSpec(method="euclidean", category="greedy", clusters=2, top=5, dynamic=False, bypass=0, normalize=False)
    assert chosen(ca.select(logits(spark, a), emb(spark, vectors), bounded)) == {0: 3}


@pytest.mark.parametrize("method", ["kmeans", "dbscan", "hierarchical", "single"])
def test_all_methods(spark, method):
    rng = np.random.default_rng(0)
    vocab = emb(spark, rng.normal(size=(100, 8)))
    peaks = {t: -10.0 for t in range(100)} | {t: 5.0 - t % 10 for c in (10, 30, 50) for t in range(c, c + 5)}
    one = {t: (10.0 if t == 42 else -100.0) for t in range(100)}
    rows, spec = logits(spark, peaks, one), ca.ClusterSpec(method=method)
    first = chosen(ca.select(rows, vocab, spec))
    assert first[1] == 42 and first == chosen(ca.select(rows.repartition(5), vocab, spec))
    inside = chosen(ca.select(rows, vocab, spec, allowed(spark, [42, 43, 44, 45], [5])))
    assert inside[0] in {42, 43, 44, 45} and inside[1] == 5
    if method == "single":
        assert first == chosen(samplers.greedy(rows))


def test_few_candidates_are_not_clustered(spark):
    rows = logits(spark, L)
    got = ca.select(rows, emb(spark, E), ca.ClusterSpec(method="dbscan"), allowed(spark, [0, 1, 4])).collect()
    assert [(r["token_id"], r["cluster_id"]) for r in got] == [(4, None)]


def test_information_equals_mass_unless_empty(spark):
    rows = spark.createDataFrame([(0, 0, 0.5, 2), (0, 1, 0.5, 1), (1, 0, 0.0, 1), (1, 1, 1.0, 1), (2, 0, 1e-12, 1), (2, 5, 0.4, 1), (2, 6, 0.6, 1)], "ctx_id long, cluster_id int, mass double, size long").withColumn("token_id", F.col("cluster_id"))
    by = lambda f: {r["ctx_id"]: r["cluster_id"] for r in category.best_cluster(f(rows)).collect()}
    assert by(category.information_score) == by(category.greedy_score) == {0: 0, 1: 1, 2: 6}
    kept = category.information_score(rows, least=1).where("ctx_id = 2 AND score > 0").count()
    assert kept == 2


def test_divergence_of_a_removal_equals_its_definition(spark):
    masses = [0.7, 0.3 - 1e-11, 1e-11]
    rows = spark.createDataFrame([(0, i, m, 1, i) for i, m in enumerate(masses)] + [(1, 0, 0.0, 1, 0)], "ctx_id long, cluster_id int, mass double, size long, token_id int")
    got = {(r["ctx_id"], r["cluster_id"]): r["kl"] for r in category.kl_of_removal(rows).collect()}
    p = np.array(masses) / sum(masses)
    q = p * [1, 1, 0] / p[:2].sum()
    want = sum(a * math.log(a / b) for a, b in zip(p, q) if b > 1e-10)
    assert got[0, 0] == got[0, 1] == math.inf and got[1, 0] == 0 and got[0, 2] == pytest.approx(want, rel=1e-4) and got[0, 2] < 0


def test_one_pass_equals_the_single_samplers(spark):
    rng = np.random.default_rng(6)
    rows = logits(spark, *[{int(t): float(rng.normal() * 3) for t in rng.choice(200, 40, replace=False)} for _ in range(80)])
    one = {(r["ctx_id"], r["sampler"]): r["token_id"] for r in samplers.decide(rows).collect()}
    many = {(r["ctx_id"], r["sampler"]): r["token_id"] for r in samplers.run(rows, ["greedy", "top_p", "random"]).collect()}
    assert one == many
    draws = {n: [one[c, n] for c in range(80)] for n in ("top_p", "random")}
    assert sum(a == b for a, b in zip(*draws.values())) < 40


def test_any_token_where_nothing_can_be_drawn(spark):
    rows = logits(spark, [float("nan"), 1, 2], [float("-inf")] * 3, [float("-inf"), 5, 5], [float("inf"), 1], [1, 2, 3])
    got = chosen(samplers.sampled_or_any(rows, 1.0, allowed(spark, [1, 2])))
    assert set(got) == set(range(5)) and got[0] in (1, 2) and got[2] in (1, 2) and got[3] == 0
    many = logits(spark, *[[float("nan"), 1, 2]] * 300)
    assert set(chosen(samplers.sampled_or_any(many)).values()) == {0, 1, 2}


def test_tokens_that_stand_in_for_filtered_ones(spark):
    rows = spark.createDataFrame([(c, t, t + 1, 0 if t < 2 else 2, 0.4 - t / 10) for c in range(5) for t in range(4)], "ctx_id long, token_id int, rank int, cluster_id int, p double")
    best = spark.createDataFrame([(c, 0) for c in range(5)], "ctx_id long, cluster_id int")
    got = chosen(category.allowed_token(rows, best, allowed(spark, [1, 3], [3, 2], [9, 8], [])))
    assert got == {0: 1, 1: 2, 2: 8, 3: 0, 4: 0}


def test_a_vocabulary_in_several_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 4))
    x[5] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if 1 - unit[i] @ unit[j] <= 0.6}
    for block in (7, 40, 1000):
        assert {(r["a"], r["b"]) for r in clustering.epsilon_edges(emb(spark, x), 0.6, block).collect()} == want
    assert clustering.epsilon_edges(emb(spark, x).limit(0), 0.6).collect() == []


def test_vectors_too_many_to_be_looked_up_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, vocab = logits(spark, *[{int(t): float(rng.normal()) for t in rng.choice(50, 20, replace=False)} for _ in range(5)]), emb(spark, rng.normal(size=(45, 3)))
    key = lambda: sorted(map(tuple, ca.select(rows, vocab, ca.ClusterSpec()).collect()))
    near = key()
    monkeypatch.setattr(clustering, "SMALL_VALUES", 10)
    assert key() == near


def test_a_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(7)
    rows, vocab = logits(spark, *[{int(t): float(rng.normal()) for t in rng.choice(60, 30, replace=False)} for _ in range(4)], [1, 2, 3]), emb(spark, rng.normal(size=(60, 5)))
    specs = ca.grid()
    assert len(specs) == 21
    got = {(r["config"], r["ctx_id"]): (r["token_id"], r["cluster_id"]) for r in ca.sweep(rows, vocab, specs).collect()}
    assert len(got) == 21 * 5
    for name in ("dbscan epsilon=0.5 min_samples=3", "hierarchical clusters=4 linkage=complete", "kmeans clusters=16 top=30"):
        assert {(name, r["ctx_id"]): (r["token_id"], r["cluster_id"]) for r in ca.select(rows, vocab, specs[name]).collect()}.items() <= got.items()


def test_methods_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(clustering, "CUSTOM", {})
    monkeypatch.setattr(category, "SCORES", dict(category.SCORES))
    monkeypatch.setattr(samplers, "REGISTRY", dict(samplers.REGISTRY))
    clustering.register("halves", lambda x, spec: np.arange(len(x)) % 2)
    category.register("smallest", lambda m: m.withColumn("score", -F.col("mass")))
    samplers.register("least", lambda rows, allowed=None: rows.groupBy("ctx_id").agg(F.min("token_id").alias("token_id")).select("ctx_id", F.lit("least").alias("sampler"), "token_id"))
    rows, vocab = logits(spark, L), emb(spark, E)
    spec = ca.ClusterSpec(method="halves", category="smallest")
    assert chosen(ca.select(rows, vocab, spec)) == {0: 2} == chosen(ca.sweep(rows, vocab, {"x": spec}))
    assert chosen(samplers.run(rows, ["least"])) == {0: 0}
    for again in (lambda: clustering.register("kmeans", None), lambda: category.register("greedy", None), lambda: samplers.register("greedy", None)):
        with pytest.raises(ValueError):
            again()


def test_zero_and_missing_vectors(spark):
    rows = logits(spark, [1, 2, 3, 4, 5])
    vocab = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [1.0, 0.0]), (3, [1.0, 0.1])], "token_id int, vec array<double>")
    for method in ("kmeans", "dbscan", "hierarchical"):
        assert ca.select(rows, vocab, ca.ClusterSpec(method=method)).count() == 1


def test_empty_inputs(spark):
    rows = logits(spark)
    assert samplers.run(rows, ["greedy", "top_p", "random"]).count() == 0
    assert ca.select(rows, emb(spark, E), ca.ClusterSpec(method="dbscan")).count() == 0


def test_wide_logits(spark):
    rows = lg.wide_to_long(spark.createDataFrame([(7, [0.1, 0.9])], "ctx_id long, logits array<double>"))
    assert chosen(samplers.greedy(rows)) == {7: 1}


def test_one_exchange_per_key(spark):
    """Softmax, candidates and nucleus of a context share the exchange of ctx_id."""
    plan = samplers.top_p_support(lg.dynamic_candidates(logits(spark, L)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_edges_and_vocabulary_beyond_the_first_hundred(spark, tmp_path):
    vectors = np.random.default_rng(5).normal(size=(130, 3))
    spark.createDataFrame([(i, [float(x) for x in v], i % 10) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = [(1, '{"k": 3}', 1.0), (1, '{"k": 120}', 2.0), (2, '{"k": 120}', 1.5), (2, '{"k": 500}', 1.0), (3, None, 1.0)]
    spark.createDataFrame(events, "user_id long, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    unit = vectors.astype("f4").astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {(i, j) for i in range(130) for j in range(i + 1, 130) if 1 - unit[i] @ unit[j] <= relations.EPSILON}
    assert {(r["a"], r["b"]) for r in q_selection.eps_edges(spark, str(tmp_path)).collect()} == want
    assert max(b for _, b in want) > 100
    assert sorted(r["token_id"] for r in relations.vocabulary(spark, str(tmp_path)).collect()) == [3, 120]
