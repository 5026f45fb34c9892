"""Shared spans against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import recompression, shared_spans

DOCS = "doc_id long, text string, name string, stretch int, spots string"


def brute(texts, least):
    seen, out = {}, set()
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            seen.setdefault(t[i : i + least], set()).add(d)
    for group in seen.values():
        out |= {(a, b) for a in group for b in group if a < b}
    return out


def words(rng, n, alphabet="abcdefgh "):
    return "".join(rng.choice(alphabet) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["ab", "a", "abcdefghij ", "é漢😀a "]), st.integers(0, 60))
def test_equal_stretches_keep_a_common_symbol(seed, alphabet, extra):
    rng = random.Random(seed)
    common = words(rng, 160 + extra, alphabet)
    a, b = (words(rng, rng.randrange(80), alphabet) + common + words(rng, rng.randrange(80), alphabet) for _ in range(2))
    which, _, name = recompression.anchors([a, b], 160)
    assert set(name[which == 0]) & set(name[which == 1])


def test_runs_of_unequal_length_meet(spark):
    rng = random.Random(5)
    tail = words(rng, 70)
    a, b = "x" + "=" * 400 + tail, words(rng, 30) + "=" * 95 + tail
    which, _, name = recompression.anchors([a, b], 160)
    assert set(name[which == 0]) & set(name[which == 1])


def corpus(seed, n=60):
    rng = random.Random(seed)
    texts = {i: words(rng, rng.randrange(20, 700)) for i in range(n)}
    for _ in range(40):
        a, b = rng.sample(range(n), 2)
        size = rng.choice([120, 155, 159, 160, 161, 200, 400])
        i = rng.randrange(max(1, len(texts[a]) - size))
        j = rng.randrange(len(texts[b]) + 1)
        texts[b] = texts[b][:j] + texts[a][i : i + size] + texts[b][j:]
    texts[n], texts[n + 1] = texts[0], texts[0]
    return texts


@pytest.mark.parametrize("few", [32, 1])
def test_pairs_equal_brute_force(spark, few):
    """few = 1 sends every name through the stretches of crowded ones."""
    texts = corpus(7)
    rows = [(d, t, "n", 1, "s") for d, t in texts.items()] + [(0, texts[0], "n", 2, "s"), (900, None, "", 0, ""), (901, "", "", 0, ""), (None, texts[0], "", 0, "")]
    got = [tuple(r) for r in shared_spans.shared_pairs(spark.createDataFrame(rows, DOCS), few=few).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 160)


@pytest.mark.parametrize("few", [32, 1])
def test_coverage_equals_brute_force(spark, few):
    texts = corpus(11, 30)
    rows = [(d, t, "n", 1, "s") for d, t in texts.items()]
    got = {r["doc_id"]: r["shared_chars"] for r in shared_spans.shared_coverage(spark.createDataFrame(rows, DOCS), few=few).collect()}
    where = {}
    for d, t in texts.items():
        for i in range(len(t) - 159):
            where.setdefault(t[i : i + 160], []).append((d, i))
    want = {d: set() for d in texts}
    for spots in where.values():
        if len({d for d, _ in spots}) > 1:
            for d, i in spots:
                want[d].update(range(i, i + 160))
    assert got == {d: len(x) for d, x in want.items()}


def test_crowded_phrase_without_shared_stretch(spark):
    """A phrase below the length in every document gives no pair, and all pairs where it is long enough."""
    rng = random.Random(3)
    short, long = words(rng, 140), words(rng, 170)
    rows = [(i, words(rng, 50) + short + words(rng, 50), "", 0, "") for i in range(60)]
    assert shared_spans.shared_pairs(spark.createDataFrame(rows, DOCS)).collect() == []
    rows = [(i, words(rng, 50) + long + words(rng, 50), "", 0, "") for i in range(40)]
    assert shared_spans.shared_pairs(spark.createDataFrame(rows, DOCS)).count() == 40 * 39 // 2


def test_links_hold_all_pairs_without_writing_them_out(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "BLOCK", 7)
    rng = random.Random(9)
    boiler = words(rng, 400)
    texts = corpus(21, 30) | {100 + i: words(rng, 60) + boiler + words(rng, 60) for i in range(60)} | {200: boiler, 201: boiler}
    frame = spark.createDataFrame([(d, t, "", 0, "") for d, t in texts.items()], DOCS)
    want = brute(texts, 160)
    assert {tuple(r) for r in shared_spans.shared_pairs(frame).collect()} == want
    groups, reps = {}, {}
    rows = shared_spans.shared_links(frame).collect()
    for r in rows:
        if r["kind"] == "copies":
            reps[r["doc_id"]] = r["group_id"]
        else:
            groups.setdefault((r["kind"], r["group_id"]), set()).add(r["doc_id"])
    of = {d: [x for x in texts if reps.get(x, x) == d] for d in texts}
    linked = {tuple(sorted((x, y))) for g in groups.values() for a in g for b in g if a < b for x in of[a] for y in of[b]} | {(a, b) for a in reps for b in reps if a < b and reps[a] == reps[b]}
    assert linked == want and len(rows) < len(want) / 2


def test_long_texts_in_pieces():
    text = words(random.Random(2), 5000)
    cuts = list(recompression.pieces(text, 160, 1000))
    assert all(text[o : o + len(p)] == p for o, p in cuts)
    assert all(any(o <= i and i + 160 <= o + len(p) for o, p in cuts) for i in range(len(text) - 159))


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert shared_spans.shared_pairs(empty).collect() == [] and shared_spans.shared_coverage(empty).collect() == []


def test_too_short_stretches_are_refused():
    with pytest.raises(ValueError):
        recompression.widths(60)
