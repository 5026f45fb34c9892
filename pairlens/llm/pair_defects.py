"""Broken prompt and response pairs, by a conditional random field over clauses.

The response (the predicted answer, then the reasoning) is cut into clauses.
A chain tags each as answer, refusal, echo, foreign, unfinished or nothing
from binary features: its match with the question and the options, its
language against the question's by learned letter profiles, what its words say
for an answer or against one by learned odds, and its form. The coverage of
the clauses by the tags decides the pair's defect. Everything is trained here,
on a bounded sample of the rows from which defective ones are made and on seed
phrases, so no labels are needed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.crf import Chain
from pairlens.llm.language import CLEAR, LANGUAGES, LEAD, WORD, Profiles, script, telling
from pairlens.plans.durable import spread

#: Rows, at most, from which training pairs are made.
TRAIN_ROWS = 1_200
#: Rows of more clauses aren't trained on.
TRAIN_CLAUSES = 64

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished", "nothing")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, NOTHING = range(6)
# Seed words for training: what stands where no answer was given.
FILLERS = tuple("none null nan n/a na nil nul undefined unknown empty blank tbd todo missing nothing void no answer given available applicable keine nichts leer nada ninguna vacío rien aucune vide нет пусто".split()) + ("no answer", "no answer available", "no answer given", "no answer provided", "answer missing", "not available", "not applicable", "none given", "keine Angabe", "sin dato", "sin respuesta", "pas de réponse", "keine Antwort", "нет ответа")
# Words before a repeated question.
_CUES = re.compile(r"^(?:q|a|question|answer|frage|antwort|pregunta|respuesta|réponse|вопрос|ответ)+$")
_CUE_START = re.compile(r"^\W*(?:q|a|question|answer|frage|antwort|pregunta|respuesta|réponse|вопрос|ответ)\s*:\s*", re.I)

_SPLIT = re.compile(r"(?<=[.!?…])[\"”»)*]*\s+|\n+")
_NO_WORD = re.compile(r"[\W_]+")
_LABEL = re.compile(r"^\s*[(\[*]*(?:[A-Ha-h]|\d{1,2})[)\].:*]+\s*(?=\S)")
_ONLY_LABEL = re.compile(r"^\W*(?:(?:option|choice|answer)\W+)?(?:[A-Ha-h]|\d)\W*$", re.I)
_CHOICE = re.compile(r"(?:^|[\s(*:=])[A-H](?:[\s).!*]|$)")
_DIGIT = re.compile(r"\d")

_FEATURES = (
    "always predicted own_language own_clearly other_language other_clearly no_language echo_clause echo_field option_match option_prefix unmatched digit choice option_inside option_words "
    "question_words filler short single sound soundly declines declines_clearly field_sound field_declines only_clause first field_digit field_choice field_options terminated elided no_options"
).split()
_BIT = {name: 1 << i for i, name in enumerate(_FEATURES)}
#: Log odds at which words speak for or against an answer, and at which they do so clearly.
ODDS, CLEAR_ODDS = 1.5, 5.0


def squeeze(text: str) -> str:
    """Letters and digits only, without case, accents' coding or signs."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NO_WORD.sub("", text).casefold()


def repeats(squeezed: str, question: str) -> bool:
    """Nothing but the question (squeezed), once or more, and words like "Q" before it."""
    if not question or question not in squeezed:
        return False
    rest = squeezed.replace(question, "")
    return not rest or bool(_CUES.match(rest))


_FILLED = frozenset(map(squeeze, FILLERS))
_FILLING = frozenset(w for f in FILLERS for w in WORD.findall(f.lower()))


class Model:
    """Language profiles, words' odds of declining, common words and, once trained, the chain."""

    def __init__(self) -> None:
        self.profiles = Profiles()
        self.odds: dict[str | tuple[str, str], float] = {}
        self.common: frozenset[str] = frozenset()
        self.chain = Chain(len(_FEATURES), len(LABELS))
        self.asked: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"asked": {}}

    def learn_words(self, sound: Sequence[str], declining: Sequence[str]) -> None:
        """Log odds of words and pairs of them in declining clauses against sound ones, and the words that say least about a subject."""
        one, two = (Counter(g for t in texts for g in _grams(t)) for texts in (declining, sound))
        n_one, n_two = sum(one.values()) + 1.0, sum(two.values()) + 1.0
        # words of few texts are names and subjects
        self.odds = {g: float(np.clip(np.log((one[g] + 0.1) / n_one) - np.log((two[g] + 0.1 * n_two / n_one) / n_two), -3, 3)) for g in one.keys() | {g for g, c in two.items() if c >= 3}}
        often = Counter(w for t in sound for w in set(_words(t)))
        self.common = frozenset(w for w, c in often.items() if c >= max(3, len(sound) // 50)) | {w for t in declining for w in _words(t)}


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(text: str) -> list:
    found = _words(text)
    return [*found, *zip(found, found[1:])]


class _Asked:
    """What a question and its options are matched by."""

    def __init__(self, model: Model, sentence: str, options: tuple[str, ...]) -> None:
        self.letters, self.own = squeeze(sentence), model.profiles.language(sentence)
        self.own_index = LANGUAGES.index(self.own) if self.own in LANGUAGES else -1
        self.options = [squeeze(o) for o in options]
        self.words = {w for w in _words(sentence) if w not in model.common}
        self.option_words = {w for o in options for w in _words(o) if len(w) > 2 and w not in model.common} - self.words


#: Questions that a task remembers.
_ASKED = 20_000


def features(model: Model, rows: Sequence[tuple]) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Of all clauses of some rows, one after another: feature bits, field (0 the predicted answer, 1 the reasoning), letters; and of each row how many clauses it has.

    Rows are (sentence, options, predicted, reasoning). A field that is null or
    blank has no clause.
    """
    odds, profiles, nothing = model.odds.get, model.profiles, repeat(0.0)
    profiles.rest()
    remembered = model.asked
    if len(remembered) > _ASKED:
        remembered.clear()
    bits_, fields, sizes, lengths = [], [], [], []
    ids, counted, owns = [], [], []  # of each clause its words' rows, how many, and its question's language
    for sentence, options, predicted, reasoning in rows:
        key = (sentence or "", tuple(o for o in options or () if o))
        asked = remembered.get(key)
        if asked is None:
            asked = remembered[key] = _Asked(model, *key)
        texts, own = asked.options, asked.own
        began = len(bits_)
        for field, text in ((0, predicted), (1, reasoning)):
            if not text or text.isspace():
                continue
            clauses = [c for c in _SPLIT.split(text) if c and not c.isspace()]
            single = len(clauses) == 1
            whole = squeeze(text)
            bits = _BIT["always"] if texts else _BIT["always"] | _BIT["no_options"]
            if not field:
                bits |= _BIT["predicted"]
                body = squeeze(_LABEL.sub("", text, count=1))
                if body in texts or whole in texts or _ONLY_LABEL.match(text):
                    bits |= _BIT["option_match"]
                else:
                    if not whole or whole in _FILLED or _FILLING.issuperset(_words(text) or ("-",)):
                        bits |= _BIT["filler"]
                    if body and any(o.startswith(body) for o in texts):
                        bits |= _BIT["option_prefix"]
                    elif texts and not any(o and o in whole for o in texts):
                        bits |= _BIT["unmatched"]
            if single:
                bits |= _BIT["only_clause"]
            if _DIGIT.search(text):
                bits |= _BIT["field_digit"]
            if _CHOICE.search(text):
                bits |= _BIT["field_choice"]
            if repeats(whole, asked.letters):
                bits |= _BIT["echo_field"]
            first, leaning = len(bits_), 0.0
            for number, clause in enumerate(clauses):
                b, letters = bits, whole if single else squeeze(clause)
                if not number:
                    b |= _BIT["first"]
                raw = WORD.findall(clause)
                other = script(clause)
                telling_ = ()
                if other:
                    b |= _BIT["own_language"] if other == own else _BIT["other_language"] | _BIT["other_clearly"] if own else _BIT["no_language"]
                    owns.append(-2)
                elif own is None:
                    b |= _BIT["no_language"]
                    owns.append(-2)
                elif asked.own_index < 0:
                    b |= _BIT["other_language"] | _BIT["other_clearly"] if raw else _BIT["no_language"]
                    owns.append(-2)
                else:
                    telling_ = profiles.ids(telling(raw))
                    owns.append(asked.own_index)
                ids.extend(telling_)
                counted.append(len(telling_))
                uncued = letters if ":" not in clause else squeeze(_CUE_START.sub("", clause, count=1))
                if len(uncued) > 3 and uncued in asked.letters and (len(raw) > 2 or 2 * len(uncued) >= len(asked.letters)):
                    b |= _BIT["echo_clause"]
                if _DIGIT.search(clause):
                    b |= _BIT["digit"]
                if _CHOICE.search(clause):
                    b |= _BIT["choice"]
                for o in texts:
                    if o in letters:
                        b |= _BIT["option_inside"]
                        break
                found = [w.lower() for w in raw]
                if not asked.option_words.isdisjoint(found):
                    b |= _BIT["option_words"]
                if not asked.words.isdisjoint(found):
                    b |= _BIT["question_words"]
                if len(found) <= 2:
                    b |= _BIT["single"] if len(found) < 2 else _BIT["short"]
                # the question's own words say nothing for or against an answer
                lean = 0.0 if b & _BIT["echo_clause"] else sum(map(odds, found, nothing)) + sum(map(odds, zip(found, found[1:]), nothing))
                leaning += lean
                if lean >= ODDS:
                    b |= _BIT["declines"] | (_BIT["declines_clearly"] if lean >= CLEAR_ODDS else 0)
                elif lean <= -ODDS:
                    b |= _BIT["sound"] | (_BIT["soundly"] if lean <= -CLEAR_ODDS else 0)
                end = clause.rstrip()
                if end[-1:] in ".!?":
                    b |= _BIT["terminated"]
                if end.endswith(("…", "...")):
                    b |= _BIT["elided"]
                bits_.append(b)
                fields.append(field)
                sizes.append(len(letters))
            more = _BIT["field_declines"] if leaning >= ODDS else _BIT["field_sound"] if leaning <= -ODDS else 0
            if any(b & (_BIT["option_words"] | _BIT["option_inside"]) for b in bits_[first:]):
                more |= _BIT["field_options"]
            if more:
                bits_[first:] = [b | more for b in bits_[first:]]
        lengths.append(len(bits_) - began)
    bits_ = np.array(bits_, dtype=np.int64)
    own_index = np.array(owns, dtype=int)
    mine = np.flatnonzero(own_index >= 0)
    if len(mine):
        ends = np.cumsum(counted)
        total = np.zeros((len(ids) + 1, len(LANGUAGES)))
        np.cumsum(profiles.scores[ids], 0, out=total[1:])
        score = (total[ends] - total[ends - np.array(counted)])[mine]
        own = score[np.arange(len(mine)), own_index[mine]]
        score[np.arange(len(mine)), own_index[mine]] = -np.inf
        # by how much the best other language leads the question's
        lead = score.max(1) - own
        bits_[mine] |= np.select(
            [lead >= CLEAR, lead >= LEAD, lead <= -CLEAR, lead <= -LEAD],
            [_BIT["other_language"] | _BIT["other_clearly"], _BIT["other_language"], _BIT["own_language"] | _BIT["own_clearly"], _BIT["own_language"]], _BIT["no_language"])
    return bits_, fields, sizes, lengths


def unpack(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(_FEATURES)) & 1).astype(float)


# Seed phrases for training: ways to decline, written for this purpose, by language; {} takes a word of the question.
DECLINING = {
    "en": ("I can't answer that.", "I am unable to respond to this request.", "Sorry, I will not help with that question.", "I would prefer not to discuss {}.", "My rules do not allow me to choose an option.", "As an assistant I must refuse to pick one.", "Please ask a qualified person about {}.", "No answer will be given to this item.", "This is not something I may comment on.", "Let us choose another topic than {}.", "That is outside what I can do for you.", "Unfortunately I have to decline.", "I'd rather talk about something else.", "It would be against my guidelines to take part in this.", "You should consult a specialist instead of me.", "I won't be commenting on {} today."),
    "es": ("No puedo responder a esa pregunta.", "Lo siento, no me permiten elegir.", "Prefiero no hablar de {}.", "Pregunte mejor a un especialista.", "No debo ayudar con este tema.", "Tengo que rechazar esta solicitud.", "No me corresponde opinar sobre {}.", "No está permitido que opine.", "Elegir una opción no me corresponde.", "No quiero contestar a esto."),
    "fr": ("Je ne peux pas répondre à cette question.", "Désolé, je ne dois pas choisir.", "Je préfère ne pas parler de {}.", "Demandez plutôt à un spécialiste.", "Il ne m'est pas permis de traiter ce sujet.", "Je dois refuser cette demande.", "Ce n'est pas à moi de juger {}.", "Il m'est interdit de donner une réponse.", "Choisir une option n'est pas de mon ressort.", "Je ne veux pas en parler."),
    "de": ("Das kann ich nicht beantworten.", "Leider darf ich keine Antwort geben.", "Ich möchte nicht über {} sprechen.", "Bitte fragen Sie einen Lehrer.", "Zu diesem Thema darf ich nichts sagen.", "Ich muss diese Anfrage ablehnen.", "Dafür bin ich nicht zuständig.", "Es ist mir nicht erlaubt, dazu etwas zu sagen.", "Eine Auswahl treffe ich hier nicht.", "Dazu will ich mich nicht äußern."),
    "ru": ("Я не могу ответить на это.", "Извините, мне нельзя выбирать вариант.", "Я предпочёл бы не говорить про {}.", "Лучше спросите специалиста.", "На такие вопросы я не отвечаю.", "Мне придётся отклонить эту просьбу.", "Это не входит в мои задачи.", "Мне не разрешено давать советы.", "Выбирать ответ я не стану.", "Не хочу об этом говорить."),
    "it": ("Non posso rispondere a questa domanda.", "Mi dispiace, non mi è permesso scegliere.", "Preferisco non parlare di {}.", "Chieda piuttosto a uno specialista.", "Devo rifiutare questa richiesta.", "Non mi è consentito dare una risposta.", "Scegliere un'opzione non spetta a me."),
    "pt": ("Não posso responder a essa pergunta.", "Desculpe, não me é permitido escolher.", "Prefiro não falar de {}.", "Pergunte antes a um especialista.", "Tenho de recusar este pedido.", "Não estou autorizado a dar uma resposta.", "Escolher uma opção não me cabe."),
}
# Sound clauses in words of declining: {} takes words of an option.
HARD = {
    "en": ("I cannot see any way {} could help.", "No option but {} can answer the question.", "We must not choose {} without a reason.", "Sorry, I should compare {} first."),
    "es": ("No puedo ver cómo {} podría ayudar.", "Ninguna opción salvo {} responde a la pregunta."),
    "fr": ("Je ne peux pas voir comment {} aiderait.", "Aucune option sauf {} ne répond à la question."),
    "de": ("Ich kann nicht sehen, wie {} helfen würde.", "Keine Antwort außer {} passt zur Frage."),
    "ru": ("Я не могу понять, как поможет {}.", "Ни один вариант, кроме {}, не отвечает на вопрос."),
}
# Rows that are always trained on, so that a small table has some of each language.
BASE = (
    ("Which metal is heavier?", ("the lead bar in the box", "a thin sheet of tin", "the copper wire"), "the lead bar in the box", "First we weigh the bar, which has 12.5 kg. The sheet is lighter than the bar. So the answer is A."),
    ("What keeps the water warm at night?", ("a lid on the pot", "the wind from the north", "more salt than sand"), "a lid on the pot", "The pot loses 3.1 K with the lid. I cannot say more about the wind, it was 7 W. The evidence points to A."),
    ("¿Qué mantiene el agua caliente en la noche?", ("la tapa de la olla", "el viento del norte", "más sal que arena"), "la tapa de la olla", "La olla pierde 3.1 K con la tapa. El viento no cuenta. Por tanto, la respuesta es A."),
    ("Qu'est-ce qui garde l'eau au chaud dans la nuit ?", ("le couvercle de la marmite", "le vent du nord", "plus de sel"), "le couvercle de la marmite", "La marmite perd 3.1 K avec le couvercle. Le vent ne compte pas. Tout mène à A."),
    ("Was hält das Wasser in der Nacht warm?", ("der Deckel auf dem Topf", "der Wind aus dem Norden", "nur das Salz"), "der Deckel auf dem Topf", "Der Topf verliert mit dem Deckel 3.1 K. Der Wind ist nicht wichtig. Also ist A richtig."),
    ("Что сохраняет воду тёплой ночью?", ("крышка на кастрюле", "ветер с севера", "только соль"), "крышка на кастрюле", "С крышкой вода теряет 3.1 K. Ветер не важен. Значит, ответ A."),
)




def _split(values: Sequence, lengths: Sequence[int]) -> Iterator[Sequence]:
    at = 0
    for n in lengths:
        yield values[at : at + n]
        at += n


def sound_rows(model: Model, rows: Sequence[tuple]) -> list[tuple]:
    """The rows that may stand for sound pairs: the answer is an option, nothing is echoed, most clauses are in the question's language, and the reasoning tells of options, choices or numbers."""
    bits, fields, _, lengths = features(model, rows)
    out = []
    for row, mine, of in zip(rows, _split(bits.tolist(), lengths), _split(fields, lengths)):
        if not mine or of[0] or not mine[0] & _BIT["option_match"] or any(b & _BIT["echo_field"] for b in mine):
            continue
        reasoning = [b for b, f in zip(mine, of) if f]
        tells = not reasoning or reasoning[0] & (_BIT["field_digit"] | _BIT["field_choice"] | _BIT["field_options"])
        if tells and 2 * sum(bool(b & _BIT["other_language"]) for b in mine) <= len(mine):
            out.append(row)
    return out


def made_pairs(model: Model, sound: Sequence[tuple]) -> list[tuple[tuple, tuple[int, int], bool]]:
    """Rows (sentence, options, predicted, reasoning) made from sound ones, with the tags of both fields, and whether what their words say is left out."""
    own_of = [model.profiles.language(r[0] or "") for r in sound]
    by_language: dict[str | None, list[tuple]] = {}
    for r, own in zip(sound, own_of):
        by_language.setdefault(own, []).append(r)
    known = [x for x in by_language if x]
    out: list = []

    def add(row: tuple, tag: tuple[int, int], quiet: bool = False) -> None:
        out.append((row, tag, quiet))

    for i, ((sentence, options, predicted, reasoning), own) in enumerate(zip(sound, own_of)):
        add((sentence, options, predicted, reasoning), (ANSWER, ANSWER))
        word = max((sentence or "it").split() or ["it"], key=len)
        phrases, hard = DECLINING.get(own, DECLINING["en"]), HARD.get(own, HARD["en"])
        no = phrases[i % len(phrases)].format(word)
        more = f"{no} {phrases[(i + 3) % len(phrases)].format(word)}" if i // 5 % 2 else no
        kind, turn = i % 8, i // 8
        choice = [o for o in options or () if o]
        if kind in (0, 7):
            # half of them without what their words say: the form alone, since people decline in any words
            add((sentence, options, no, (None, reasoning, more)[turn % 3]), (REFUSAL, (ANSWER, ANSWER, REFUSAL)[turn % 3]), quiet=turn % 2 == 0)
        elif kind == 1:
            add((sentence, options, predicted, more), (ANSWER, REFUSAL), quiet=turn % 3 == 0)
        elif kind == 2 and sentence:
            copy = (sentence.upper(), f"Question: {sentence}\nAnswer: {sentence}", f"“{sentence}”", f"{sentence}\n\n{sentence}")[turn % 4]
            add((sentence, options, copy, reasoning if turn % 3 else None) if turn % 2 else (sentence, options, predicted, copy), (ECHO, ANSWER) if turn % 2 else (ANSWER, ECHO))
        elif kind == 3 and own and len(known) > 1:
            away = by_language[[x for x in known if x != own][turn % (len(known) - 1)]]
            other = away[i % len(away)]
            add((sentence, options, other[2], other[3] if turn % 3 else None), (FOREIGN, FOREIGN))
        elif kind == 4 and predicted and len(predicted) > 6:
            at = 3 + i * 7 % (len(predicted) - 4)
            body = predicted[:at] + ("..." if turn % 4 == 0 else "")
            if squeeze(body) and squeeze(body) not in {squeeze(o) for o in choice}:
                add((sentence, options, ("", "B) ", "(C) ", "D. ")[turn % 4] + body, reasoning if turn % 3 else None), (UNFINISHED, ANSWER))
        elif kind == 5 and choice:
            filler = FILLERS[turn % len(FILLERS)]
            if squeeze(filler) not in {squeeze(o) for o in choice}:
                add((sentence, options, (filler, filler.upper(), f"<{filler}>", f"{filler}.", " — ")[turn % 5], reasoning if turn % 3 else None), (NOTHING, ANSWER))
        elif kind == 6 and choice:
            said = hard[turn % len(hard)].format(choice[turn % len(choice)])
            add((sentence, options, predicted, f"{said} {reasoning or ''}".strip()), (ANSWER, ANSWER))
            # a reasoning that was cut is one still, an answer without options stays an answer, and a label is one
            cut = reasoning and reasoning[: 12 + i * 13 % max(1, len(reasoning) - 12)]
            label = "ABCDEFGH"[turn % min(len(choice), 8)]
            add((sentence, None if turn % 3 == 0 else options, predicted if turn % 2 else (label, f"Option {label}", f"({label})", f"{label}.")[turn // 2 % 4], cut if turn % 4 else None), (ANSWER, ANSWER))
    return out


def training_pairs(model: Model, made: Sequence[tuple]) -> Counter:
    """(feature bits, labels) of each sequence, and how often it occurs."""
    silent = ~sum(_BIT[x] for x in ("declines", "declines_clearly", "field_declines", "sound", "soundly", "field_sound"))
    bits, fields, _, lengths = features(model, [row for row, _, _ in made])
    out: Counter = Counter()
    for (_, tag, quiet), mine, of in zip(made, _split(bits.tolist(), lengths), _split(fields, lengths)):
        if 0 < len(mine) <= TRAIN_CLAUSES:
            mask = silent if quiet else -1
            out[tuple(b & mask for b in mine), tuple(tag[f] if not (b & _BIT["echo_clause"] and f) else ECHO for b, f in zip(mine, of))] += 1
    return out


def train(rows: Sequence[tuple]) -> Model:
    """A model from rows (sentence, options, predicted, reasoning)."""
    model = Model()
    texts = [" ".join([s or "", *(o for o in options or () if o), r or ""]) for s, options, _, r in (*BASE, *rows)]
    model.profiles.learn(texts)
    sound = sound_rows(model, (*BASE * 5, *rows))
    hard = [h.format("") for hs in HARD.values() for h in hs]
    model.learn_words([r[3] for r in sound if r[3]] + [o for r in sound for o in r[1] or () if o] + hard * 3, [p.format("") for ps in DECLINING.values() for p in ps])
    model.asked.clear()
    counted = training_pairs(model, made_pairs(model, sound_rows(model, (*BASE * 5, *rows))))
    lengths = np.array([len(b) for b, _ in counted])
    kinds, which = np.unique(np.array([x for b, _ in counted for x in b], dtype=np.int64), return_inverse=True)
    model.chain.fit(unpack(kinds), which, np.array([x for _, y in counted for x in y]), lengths, np.array(list(counted.values()), dtype=float))
    return model


def defect(tags: Sequence[int], fields: Sequence[int], sizes: Sequence[int]) -> str | None:
    """The defect of a pair from its clauses' tags and lengths: coverage decides, by field and over all; an answer without a clause, or of clauses that say nothing, is empty."""
    cover = [[0] * len(LABELS), [0] * len(LABELS)]
    for tag, field, size in zip(tags, fields, sizes):
        cover[field][tag] += max(size, 1)
    total = [sum(c) for c in cover]
    empty = cover[0][NOTHING] == total[0]
    if (not empty and cover[0][REFUSAL] * 2 > total[0]) or (total[1] and cover[1][REFUSAL] * 2 > total[1]):
        return "refusal"
    if any(t and c[ECHO] == t for c, t in zip(cover, total)):
        return "copied_question"
    if empty:
        return "empty"
    if 2 * (cover[0][FOREIGN] + cover[1][FOREIGN]) > total[0] + total[1]:
        return "other_language"
    if cover[0][UNFINISHED] * 2 > total[0] > 0:
        return "truncated"
    return None


def defects(model: Model, rows: Sequence[tuple]) -> list[str | None]:
    """The defect of each row (sentence, options, predicted, reasoning)."""
    bits, fields, sizes, lengths = features(model, rows)
    # equal bits get their emissions once
    seen, back = np.unique(bits, return_inverse=True)
    emissions = (unpack(seen) @ model.chain.w)[back] if len(bits) else np.zeros((0, len(LABELS)))
    counted = np.array(lengths, dtype=int)
    tags = model.chain.decode(emissions, counted[counted > 0]).tolist()
    return [defect(*x) for x in zip(_split(tags, lengths), _split(fields, lengths), _split(sizes, lengths))]


def _tagger(model: Model):
    schema = pa.schema([("result_id", pa.int64()), ("defect", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *columns = (batch.column(i).to_pylist() for i in range(5))
            rows = [(i, d) for i, d in zip(ids, defects(model, list(zip(*columns)))) if d]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pair_defects(results: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """result_id and defect of the defective pairs: empty, truncated, refusal, copied_question or other_language.

    Redelivered rows count once, rows without an id not at all. A null sentence has no language and is echoed
    by nothing; null options match nothing; a null reasoning is left out. Very
    long texts are read whole. An empty table gives no row. Other columns are
    ignored. Words, languages and chain are learned from up to ``train_rows`` rows with an answer,
    drawn by the hashes of their ids.
    """
    columns = [F.col(c) for c in ("result_id", "sentence", "options", "predicted_answer", "cot_reasoning")]
    rows = results.where(F.col("result_id").isNotNull()).select(*columns)
    # a share of the rows that holds about twice the sample, so that a task sends few rows however many tasks there are
    share = 2.0 * train_rows / max(1, results.count())
    order = F.xxhash64("result_id")
    near = rows.where(F.col("predicted_answer").isNotNull() & (F.pmod(order, F.lit(1 << 31)) < F.lit(min(1.0, share) * (1 << 31))))
    sample = near.orderBy(order, "result_id").limit(train_rows).collect()
    model = train([(r["sentence"], r["options"], r["predicted_answer"], r["cot_reasoning"]) for r in sample])
    found = spread(rows).mapInArrow(_tagger(model), "result_id long, defect string")
    return found.groupBy("result_id").agg(F.min("defect").alias("defect"))
