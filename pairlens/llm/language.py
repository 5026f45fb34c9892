"""The language of short texts by letter sequences, learned from seed texts and from the table at hand.

A word's score for each language is the log-likelihood of its letter sequences
(one to three letters, ends included) under that language's profile. Profiles
start from the seed texts below and take in the table's own questions, each
under the language that the seeds find in it, so that its subjects tell nothing
about the language any more. Other scripts are told by their letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

# Seed texts, written for this purpose: everyday sentences with many function words.
SEEDS = {
    "en": "Which of these is the reason that the water was warm when they looked at it? It is not the wind, because there was none, and so the answer must be one of the other two. What would happen if you had more than this? Then we should have seen how it changes with time, as most of them do. The best way to find out is to ask what each of them needs before it can be used by those who were there. She said that he could not have been right about her own work, which has been done for years. A small child at the school puts a red stone beside a glass and waits. What comes first, and where does it go after that? Each place on the list has its own name, but only some people know any of these by heart; nobody else at this table ever will.",
    "es": "¿Cuál de estas es la razón por la que el agua estaba caliente cuando la miraron? No es el viento, porque no había ninguno, y por eso la respuesta debe ser una de las otras dos. ¿Qué pasaría si tuviera más de esto? Entonces habríamos visto cómo cambia con el tiempo, como lo hace la mayoría de ellos. La mejor manera de saberlo es preguntar qué necesita cada uno antes de que lo usen los que estaban allí. Ella dijo que él no podía tener razón sobre su trabajo, que se hace desde hace muchos años.",
    "fr": "Laquelle de ces choses est la raison pour laquelle l'eau était chaude quand ils l'ont regardée ? Ce n'est pas le vent, car il n'y en avait pas, et donc la réponse doit être une des deux autres. Que se passerait-il si vous aviez plus que cela ? Alors nous aurions vu comment elle change avec le temps, comme le font la plupart d'entre eux. La meilleure façon de le savoir est de demander ce dont chacun a besoin avant qu'il soit utilisé par ceux qui étaient là. Elle a dit qu'il ne pouvait pas avoir raison sur son travail, qui se fait depuis des années.",
    "de": "Welches davon ist der Grund, dass das Wasser warm war, als sie es ansahen? Es ist nicht der Wind, denn es gab keinen, und so muss die Antwort eine der beiden anderen sein. Was würde geschehen, wenn du mehr als das hättest? Dann hätten wir gesehen, wie es sich mit der Zeit ändert, wie es die meisten von ihnen tun. Der beste Weg, das zu erfahren, ist zu fragen, was jeder braucht, bevor es von denen benutzt wird, die dort waren. Sie sagte, dass er mit seiner Arbeit, die seit Jahren gemacht wird, nicht recht haben konnte.",
    "it": "Quale di queste è la ragione per cui l'acqua era calda quando l'hanno guardata? Non è il vento, perché non ce n'era, e quindi la risposta deve essere una delle altre due. Che cosa succederebbe se tu avessi più di questo? Allora avremmo visto come cambia con il tempo, come fa la maggior parte di loro. Il modo migliore per saperlo è chiedere di che cosa ha bisogno ognuno prima che sia usato da quelli che erano lì. Lei ha detto che lui non poteva avere ragione sul suo lavoro, che si fa da molti anni.",
    "pt": "Qual destas é a razão pela qual a água estava quente quando olharam para ela? Não é o vento, porque não havia nenhum, e por isso a resposta deve ser uma das outras duas. O que aconteceria se você tivesse mais do que isto? Então teríamos visto como ela muda com o tempo, como faz a maioria deles. A melhor maneira de saber é perguntar do que cada um precisa antes que seja usado por aqueles que estavam lá. Ela disse que ele não podia ter razão sobre o seu trabalho, que se faz há muitos anos.",
    "nl": "Welke van deze is de reden dat het water warm was toen ze ernaar keken? Het is niet de wind, want die was er niet, en dus moet het antwoord een van de andere twee zijn. Wat zou er gebeuren als je meer dan dit had? Dan zouden we gezien hebben hoe het met de tijd verandert, zoals de meeste van hen doen. De beste manier om dat te weten is te vragen wat ieder nodig heeft voordat het gebruikt wordt door degenen die daar waren. Zij zei dat hij geen gelijk kon hebben over zijn werk, dat al jaren gedaan wordt.",
    "sv": "Vilken av dessa är skälet till att vattnet var varmt när de tittade på det? Det är inte vinden, för det fanns ingen, och därför måste svaret vara en av de andra två. Vad skulle hända om du hade mer än detta? Då skulle vi ha sett hur det ändras med tiden, som de flesta av dem gör. Det bästa sättet att få veta det är att fråga vad var och en behöver innan det används av dem som var där. Hon sade att han inte kunde ha rätt om sitt arbete, som har gjorts i många år.",
    "pl": "Która z tych rzeczy jest powodem, że woda była ciepła, kiedy na nią patrzyli? To nie jest wiatr, bo go nie było, więc odpowiedzią musi być jedna z dwóch pozostałych. Co by się stało, gdyby było tego więcej? Wtedy zobaczylibyśmy, jak zmienia się z czasem, tak jak większość z nich. Najlepiej jest zapytać, czego każdy potrzebuje, zanim użyją tego ci, którzy tam byli. Powiedziała, że on nie mógł mieć racji w sprawie swojej pracy, która trwa od lat.",
    "ru": "Что из этого является причиной того, что вода была тёплой, когда на неё смотрели? Это не ветер, потому что его не было, и поэтому ответом должен быть один из двух других. Что произошло бы, если бы этого было больше? Тогда мы увидели бы, как это меняется со временем, как и у большинства из них. Лучше всего спросить, что нужно каждому, прежде чем это используют те, кто там был. Она сказала, что он не мог быть прав насчёт своей работы, которая делается уже много лет.",
}
LANGUAGES = tuple(SEEDS)
#: Log units by which a language must lead for a text to be taken as of it, and for that to be clear.
LEAD, CLEAR = 3.0, 8.0
#: Words whose scores a task remembers.
CACHED = 200_000
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_OTHER_SCRIPT = re.compile(r"[Ͱ-Ͽ]|[֐-׿]|[؀-ۿ]|[぀-ヿ]|[一-鿿]|[가-힯]|[ऀ-ॿ]|[฀-๿]")
# First code points of scripts that tell a language by themselves.
SCRIPTS = ((0xAC00, "ko"), (0x4E00, "zh"), (0x3040, "ja"), (0x0E00, "th"), (0x0900, "hi"), (0x0600, "ar"), (0x0590, "he"), (0x0370, "el"))


def script(text: str) -> str | None:
    """The language of a script that stands for one, if at least a third of the letters are of one."""
    if text.isascii():
        return None
    found = _OTHER_SCRIPT.findall(text)
    if not found or 3 * len(found) < sum(c.isalpha() for c in text):
        return None
    point = ord(found[len(found) // 2])
    return next(name for first, name in SCRIPTS if point >= first)


def telling(found: list[str]) -> list[str]:
    """Of words those that tell a language, in lower case: capitals within a sentence are names and left out, unless most words have them."""
    if len(found) > 1:
        small = [found[0], *[w for w in found[1:] if not w[0].isupper()]]
        found = small if 2 * len(small) > len(found) or len(small) > 2 else found
    return [w.lower() for w in found]


def words(text: str) -> list[str]:
    """The words of a text that tell its language."""
    return telling(WORD.findall(text))


def _sequences(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


class Profiles:
    """Letter sequences by language."""

    def __init__(self) -> None:
        self.counts = {name: Counter(s for w in WORD.findall(text.lower()) for s in _sequences(w)) for name, text in SEEDS.items()}
        self.prior = np.zeros(len(LANGUAGES))
        self._build()

    def _build(self) -> None:
        # sequences of one length share one distribution; unseen ones count a little
        kinds = {s for c in self.counts.values() for s in c}
        totals = np.array([[sum(v for s, v in c.items() if len(s) == n) for c in self.counts.values()] for n in (1, 2, 3)], dtype=float)
        sizes = [max(1, sum(len(s) == n for s in kinds)) for n in (1, 2, 3)]
        self.unseen = np.array([np.log(0.2 / (totals[n] + 0.2 * sizes[n])) for n in range(3)])
        self.table = {s: np.log((np.array([c[s] for c in self.counts.values()]) + 0.2) / (totals[len(s) - 1] + 0.2 * sizes[len(s) - 1])) for s in kinds}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES)))

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "table": self.table, "unseen": self.unseen, "prior": self.prior}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def learn(self, texts: Iterable[str], turns: int = 1) -> "Profiles":
        """Takes in texts under the languages that are clear in them; longer ones are the clearer."""
        seeds, texts = self.counts, list(texts)
        for _ in range(turns):
            seen, times = {name: Counter() for name in seeds}, Counter()
            for text in texts:
                name = self.language(text, CLEAR)
                if name in seen:
                    times[name] += 1
                    seen[name].update(words(text))
            # each word once, as often as it was seen
            found = {name: Counter(c) for name, c in seeds.items()}
            for name, counted in seen.items():
                for w, n in counted.items():
                    for q in _sequences(w):
                        found[name][q] += n
            self.counts = found
            # half the log of a language's share among the texts
            self.prior = np.log(np.array([times[name] + 1.0 for name in LANGUAGES]) / (len(texts) + len(LANGUAGES))) / 2
            self._build()
        return self

    def ids(self, found: list[str]) -> list[int]:
        """Rows of ``scores`` of words; they hold until ``rest`` is called."""
        index = self.index
        try:
            return [index[w] for w in found]
        except KeyError:
            for w in found:
                if w not in index:
                    at = index[w] = len(index)
                    if at >= len(self.scores):
                        self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                    # sequences overlap: their evidence counts a third
                    total = sum((self.table.get(s, self.unseen[len(s) - 1]) for s in _sequences(w)), np.zeros(len(LANGUAGES))) / 3
                    self.scores[at] = total - total.max()
            return [index[w] for w in found]

    def rest(self) -> None:
        """Forgets the words seen so far if they are many."""
        if len(self.index) > CACHED:
            self._forget()

    def score(self, text: str) -> np.ndarray:
        """Log-likelihood of each language, but for a common constant."""
        found = words(text)
        ids = self.ids(found)
        return self.scores[ids].sum(0) if ids else np.zeros(len(LANGUAGES))

    def language(self, text: str, lead: float = LEAD) -> str | None:
        """The language that leads by ``lead`` or more; None where none does."""
        other = script(text)
        if other:
            return other
        s = self.score(text) + self.prior
        first, second = np.argsort(-s, kind="stable")[:2]
        return LANGUAGES[first] if s[first] - s[second] >= lead else None
