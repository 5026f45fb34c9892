"""Pair defects and cut texts."""

import itertools

import numpy as np
import pytest

from pairlens.llm import pair_defects as pd_
from pairlens.llm import truncation
from pairlens.llm.crf import Chain
from pairlens.llm.language import SEEDS, Profiles, words

RESULTS = "result_id long, sampler string, sentence string, options array<string>, predicted_answer string, cot_reasoning string, `bits` int, shown string"
QUESTION = "Which change happens when the lamp near Tarvel warms the frozen lake?"
OPTIONS = ["The ice over the lake melts", "A colder wind from the hill", "More snow than rain"]
SOUND = "First we look at the lamp, which gives 41.20 W. The ice is thin near the shore. So the answer is A."


def rows(spark, cases):
    return spark.createDataFrame([(i, "s", *c, 0, "") for i, c in enumerate(cases)], RESULTS)


CASES = [
    (None, (QUESTION, OPTIONS, OPTIONS[0], SOUND)),
    (None, (QUESTION, OPTIONS, "(B) a colder wind FROM the hill.", None)),
    (None, (QUESTION, OPTIONS, OPTIONS[2], "I cannot rule out the second option yet, so compare 12.40 mL with the rest. Sorry, the unit was wrong above. " + SOUND)),
    ("empty", (QUESTION, OPTIONS, None, SOUND)),
    ("empty", (QUESTION, OPTIONS, " — ", SOUND)),
    ("empty", (QUESTION, OPTIONS, "N/A", None)),
    (None, (QUESTION, [*OPTIONS, "None"], "None", SOUND)),
    ("truncated", (QUESTION, OPTIONS, "The ice over the la", SOUND)),
    ("truncated", (QUESTION, OPTIONS, "C) More sno...", None)),
    ("refusal", (QUESTION, OPTIONS, "I would rather not answer questions about Tarvel.", None)),
    ("refusal", (QUESTION, OPTIONS, OPTIONS[1], "As an assistant I am not allowed to help with this topic.")),
    ("copied_question", (QUESTION, OPTIONS, QUESTION.upper(), None)),
    ("copied_question", (QUESTION, OPTIONS, OPTIONS[1], f"Question: {QUESTION}\nAnswer: {QUESTION}")),
    ("other_language", (QUESTION, OPTIONS, "El hielo del lago", "La pregunta pide una causa. El viento es frío y la lámpara no calienta el agua. Por tanto, la respuesta es A.")),
    ("other_language", (QUESTION, OPTIONS, OPTIONS[0], "Лампа даёт тепло. Лёд тает у берега. Значит, ответ A.")),
    (None, ("¿Qué ocurre cuando la lámpara calienta el lago?", ["El hielo se derrite", "El viento del norte"], "El hielo se derrite", "El hielo es muy fino en la orilla. Por tanto, la respuesta es A.")),
    (None, (None, None, "anything", None)),
]


def test_each_defect(spark):
    got = {r["result_id"]: r["defect"] for r in pd_.pair_defects(rows(spark, [c for _, c in CASES])).collect()}
    sure = [i for i in range(len(CASES)) if CASES[i][1][0] is not None]
    assert {i: got.get(i) for i in sure} == {i: CASES[i][0] for i in sure}


def test_redelivered_and_empty_table(spark):
    df = rows(spark, [c for _, c in CASES[3:5]])
    assert pd_.pair_defects(df.unionByName(df)).count() == 2
    assert pd_.pair_defects(df.limit(0)).collect() == []


SUBJECTS = ("river stone lamp cloud rabbit engine mirror feather candle pepper anchor window".split(), "warms cools lifts bends covers melts turns holds".split())


def made_rows(seed, n):
    """Sound rows of an invented table."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    out = []
    for _ in range(n):
        nouns = list(rng.permutation(SUBJECTS[0]))
        options = [f"The {nouns[i]} {pick(SUBJECTS[1])} the {nouns[i + 3]}" for i in range(3)]
        sentence = f"What happens first when the {nouns[7]} {pick(SUBJECTS[1])} the {nouns[8]} at night?"
        at = rng.integers(3)
        reasoning = pick(["Consider the choices.", "We begin with the setup.", "Take each one in turn."]) + f" The {nouns[at]} reads {rng.integers(10, 99)}.5 W near the {nouns[8]}. " + pick(["So the answer is ", "That leaves ", "Hence the best choice is "]) + "ABC"[at] + "."
        out.append((sentence, options, options[at], reasoning if rng.random() < 0.8 else None))
    return out


# Declining in words that the seed phrases don't have.
HELD_OUT = [
    "This falls beyond what such a program was built to cover.", "That sits off limits here.", "Matters like these lie outside my remit.", "My creators told us to stay away from these.", "Count me out.",
    "It seems wiser to leave that one alone.", "Nobody here is going to weigh in.", "Those details stay private.", "Such things ought to be left alone by machines.", "Kindly go elsewhere with it.",
    "We keep silent whenever these come up.", "Giving that away would break our terms.", "Let's skip it.", "Pass.", "The system blocks replies of that sort.", "Content withheld for safety reasons.",
    "Sharing views on it isn't within scope.", "They programmed these boundaries into us.", "Moving on without comments.", "Access denied by moderation.",
]


def test_held_out_accuracy():
    """Defects in another form and in other words than those trained on, in rows not trained on."""
    function_words = set(words(SEEDS["en"])) | {"it", "isn't", "let's"}
    listed = {w for ps in pd_.DECLINING.values() for p in ps for w in words(p)} - function_words
    clean = [p for p in HELD_OUT if not set(words(p)) & listed]
    assert len(clean) >= 14
    model = pd_.train(made_rows(1, 400))
    cases = []
    for i, (s, o, p, c) in enumerate(made_rows(2, 600)):
        cases.append([
            (None, (s, o, p, c)), (None, (s, o, p.upper() + ".", c)), (None, (s, o, p, f"I can not see how {o[0]} would. " + (c or "So the answer is A."))), (None, (s, o, "Answer: " + p, None)),
            ("refusal", (s, o, clean[i % len(clean)], c)), ("refusal", (s, o, p, clean[i % len(clean)])), ("copied_question", (s, o, f"**{s}**", c)),
            ("truncated", (s, o, o[0][: len(o[0]) * 2 // 3], c)), ("empty", (s, o, ("N.A.", "(none)", "...", "unknown!", "no answer.")[i % 5], c)),
            ("other_language", (s, o, "La piedra del río", "Primero hay que mirar la lámpara, que está muy caliente. Por eso creo que la respuesta es A.")),
        ][i % 10])
    got = pd_.defects(model, [c for _, c in cases])
    for kind in {w for w, _ in cases if w}:
        true = sum(w == kind for w, _ in cases)
        found = sum(g == kind for g in got)
        both = sum(w == g == kind for (w, _), g in zip(cases, got))
        assert both >= 0.9 * true and both >= 0.9 * found, (kind, true, found, both)


LID = ("What keeps the water warm at night?", ["a lid on the pot", "the wind from the north", "more salt than sand"])
METAL = ("Quale metallo è più pesante nella scatola?", ["la barra di piombo", "un foglio di stagno", "il filo di rame"])
PROBES = [
    ("refusal", (*LID, "This falls beyond what this program was built to cover.", None)),
    ("refusal", (*LID, "That sits off limits here.", None)),
    ("refusal", (*METAL, "Non posso rispondere a questa domanda.", None)),
    ("refusal", (*LID, "Não posso responder a essa pergunta.", None)),
    ("other_language", (*METAL, "the lead bar in the box", "First we weigh the bar. The sheet is lighter than the bar, so the answer is the first one.")),
    ("other_language", (*METAL, "the lead bar that is in the box", None)),
    (None, (*METAL, METAL[1][0], "Il foglio pesa meno della barra. La risposta è A.")),
    (None, (*LID, "a lid on the pot", "I cannot see any way the wind could help. No option but the lid can answer the question.")),
    (None, (*LID, "Option A", None)),
    ("empty", (*LID, "No answer available.", None)),
    ("empty", (*LID, "???", "The lid keeps it warm, so A.")),
]


def test_probes():
    model = pd_.train(made_rows(3, 300))
    assert pd_.defects(model, [c for _, c in PROBES]) == [w for w, _ in PROBES]


def test_languages_of_the_table_are_learned():
    p = Profiles()
    assert [p.language(t) for t in ("Non so dove sono andati tutti quanti", "Het water is niet meer warm genoeg", "どうしてですか", "12 %", "")] == ["it", "nl", "ja", None, None]
    p.learn(["Wuzzle the glorp and the fremble of the snorf, because it was there when they looked"] * 50)
    assert p.language("wuzzle glorp fremble") == "en"


def test_training_takes_sequences_of_any_length():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 1, 30, 2])
    kinds, which, y = np.eye(3), rng.integers(0, 3, 38), None
    y = which.copy()
    chain = Chain(3, 3).fit(kinds, which, y, lengths, np.ones(4))
    assert (chain.decode((kinds @ chain.w)[which], lengths) == y).all()


def test_decoding_equals_all_paths():
    rng = np.random.default_rng(1)
    chain = Chain(3, 3)
    chain.t, chain.s = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 1, 3, 4])
    e = rng.normal(size=(lengths.sum(), 3))
    got, at = chain.decode(e, lengths), 0
    for n in lengths:
        mine = e[at : at + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: chain.s[p[0]] + sum(mine[i, p[i]] for i in range(n)) + sum(chain.t[p[i], p[i + 1]] for i in range(n - 1)))
        assert tuple(got[at : at + n]) == best
        at += n


CUT = {
    "broken": ["The ice is th�", "The ice \\u00", "The ice &#8", "The ice <em", 'The <a href="x', "It is R&amp", "see http://a.b/c%2", "see a%20b%", "Ã©tait trÃ"],
    "ellipsis": ["The ice is thi…", "The ice is thi..."],
    "open": ["The ice (near the", 'We say "the', "The ice “near the shore", "It is **bold", '<div class="x">hello.', "<b>hello. <i>there</i>."],
    "number": ["The lamp gives 41"],
    "point": ["The lamp gives 41."],
    "label": ["A. The ice melts. It is warm.\nB."],
    "unterminated": ["The ice is thi", "The ice near the lake,", "A. The ice over the lake melts"],
}
WHOLE = ["", "  ", "The ice melts.", "It melts (near the shore.)", "So the answer is B", "answer = C", "**B**", "Final answer: (A)", "Therefore it must be The ice over the lake melts", QUESTION, f"“{QUESTION.upper()}”", 'So we pick "More snow than rain"', "Das „Eis“ schmilzt.", "B) stays.", "It's the lamp's glow!", "5' 3\" tall.", '<div class="x">hello.</div>', "<p>hello.<br/>", "We laughed :(  It is fine.", f"{QUESTION} {QUESTION}", " ".join([QUESTION] * 9), "word. " * 300 + "So the answer is B"]
# missing ends, to be held against the source, and no broken signs
PLAIN = ["The yield is 50%", "x > 3 and y < 4", "It is R&", "It is AT&T", "x <y and z"]


def test_evidence():
    for kind, texts in CUT.items():
        assert {t: truncation.evidence(t, QUESTION, OPTIONS) for t in texts} == dict.fromkeys(texts, kind)
    assert {t: truncation.evidence(t, QUESTION, OPTIONS) for t in WHOLE} == dict.fromkeys(WHOLE, "complete")
    assert all(truncation.evidence(t, QUESTION, OPTIONS) in truncation._UNENDED for t in PLAIN)


def test_the_last_clause_is_looked_for_in_the_whole_text():
    for filler in ("", "word " * 200):
        assert truncation.evidence(f"B. {filler}stays", QUESTION, OPTIONS) == "unterminated"


def test_numbers_before_the_last_full_stop(spark):
    years = [(QUESTION, OPTIONS, None, f"It began in {1900 + i}. The war ended in 1945.") for i in range(9)] + [(QUESTION, OPTIONS, None, "The answer is 42.")]
    assert truncation.truncated(rows(spark, years)).collect() == []
    decimals = [(QUESTION, OPTIONS, None, f"The lamp gives {i}.25 W. The ice melts.") for i in range(9)] + [(QUESTION, OPTIONS, None, "The lamp gives 3.25 W. The ice has 42.")]
    assert [r[0] for r in truncation.truncated(rows(spark, decimals)).collect()] == [9]


def test_baseline_of_a_source(spark):
    plain = [(QUESTION, OPTIONS, None, f"note {i}") for i in range(10)] + [(QUESTION, OPTIONS, None, "note (open")]
    df = rows(spark, plain)
    assert [r[0] for r in truncation.truncated(df).collect()] == [10]
    ended = [(QUESTION, OPTIONS, None, f"note {i} is done.") for i in range(10)] + [(QUESTION, OPTIONS, None, "note and"), (None, None, None, "note and"), (QUESTION, OPTIONS, None, None)]
    df = rows(spark, ended)
    assert sorted(r[0] for r in truncation.truncated(df.unionByName(df)).collect()) == [10, 11]
    report = truncation.by_source(df).collect()[0]
    assert (report["texts"], report["cut"]) == (12, 2)
    assert truncation.truncated(df.limit(0)).collect() == []


def test_mostly_cut_source_is_judged_by_its_inner_ends(spark):
    mostly = [(QUESTION, OPTIONS, None, f"The ice {i} is warm. The lamp is ne") for i in range(8)] + [(QUESTION, OPTIONS, None, "The ice melts. It is warm.")] * 2
    assert sorted(r[0] for r in truncation.truncated(rows(spark, mostly)).collect()) == list(range(8))
    report = truncation.by_source(rows(spark, mostly)).collect()[0]
    assert (report["texts"], report["cut"], report["unterminated"]) == (10, 8, 8)
    assert [r[0] for r in truncation.truncated(rows(spark, mostly[:1])).collect()] == [0]
    bare = [(QUESTION, OPTIONS, None, f"the ice {i} is warm\nthe lamp is near") for i in range(8)] + [(QUESTION, OPTIONS, None, "the ice is warm\nthe lamp and the")]
    assert [r[0] for r in truncation.truncated(rows(spark, bare)).collect()] == [8]


def test_very_long_text():
    text = "word " * 400_000
    assert truncation.evidence(text + "and", QUESTION, OPTIONS) == "unterminated"
    model = pd_.Model()
    assert pd_.features(model, [(QUESTION, OPTIONS, text, text)])[3] == [2]


def test_all_words_of_a_long_clause_count():
    model = pd_.Model()
    spanish = "the ice " * 2 + "el hielo que no es de los que la tienen " * 5_000
    bits = pd_.features(model, [(QUESTION, OPTIONS, OPTIONS[0], "The ice of the lake was there when they came " * 300 + spanish)])[0]
    assert bits[1] & pd_._BIT["other_clearly"]
