"""Texts cut off by field limits or in mid-transfer.

A stack automaton reads the structural signs of a text: quotes, brackets and
markup open and close, escapes, entities and multibyte sequences begin and
end. What is still open or begun at the end tells a cut, and so does an
ellipsis. Where nothing is open, the last clause must end: with a terminator
that is no decimal point or list label, or with a final choice. Missing ends
count only against the source's own style, which is read from the ends inside
the texts, where no cut can take them away, and a number before the last full
stop only in a source whose numbers have decimals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.pair_defects import repeats, squeeze
from pairlens.plans.durable import cut, spread

#: A source isn't known by missing ends if less than this share of its texts ends with a terminator or a choice, and less than this share of those with inner sentences or lines ends these with terminators.
BASELINE = 0.5

# Evidence that is a missing end alone.
_UNENDED = ("unterminated", "number")
_SIGN = re.compile(r"""[()\[\]{}“”„«»"`]|\*\*|</?[A-Za-z](?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+>""")
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
# Tags that need no end.
_VOID = frozenset("br hr p li img input meta link tr td th dt dd option wbr".split())
# Names of tags that a cut may leave begun without attributes.
_TAGS = "a abbr article aside b blockquote body br button caption center code dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav ol option p pre q s script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video".split()
# Names of entities.
_ENTITIES = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "hellip", "ndash", "mdash", "rsquo", "lsquo", "rdquo", "ldquo")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>$")
_BEGUN_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)?(\s[^<>]*=[^<>]*|/?)$")
_ESCAPE = re.compile(r"\\+(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$")
_ENTITY = re.compile(r"&(#(?:[0-9]*|x[0-9a-fA-F]*)|[a-z]*)$")
_WHOLE_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);")
_PERCENT = re.compile(r"\S*%[0-9A-Fa-f]?$")
_ENCODED = re.compile(r"://|%[0-9A-Fa-f]{2}")
# a character that begins a multibyte sequence read one byte at a time, and a whole such sequence
_LEAD, _MISREAD = re.compile(r"[ÂÃÄÅÐÑØÙà-ïð-ô]$|[à-ï][\x80-¿]$"), re.compile(r"[ÂÃÄÅÐÑØÙ][\x80-¿]|â€|[à-ï][\x80-¿]{2}")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\"”»)*\]]*$")
_CLOSERS = "\"”»“)]}*_`'’ \t\n\r"
_ENDED = re.compile(r"[.!?…][\"”»)*]*\s+")
_LIST_LABEL = re.compile(r"^\W*(?:[A-Ha-h]|\d{1,2})[.)]$")
_LISTED = re.compile(r"^\W*(?:[A-Ha-h]|\d{1,2})[.)]\s")
_CHOICE = re.compile(r"^(.*?)[(\[*\"“]*\b([A-H])\b[)\]*\"”]*$", re.S)
_INNER_END = re.compile(r"(\S*[^\W\d_])(?:[.!?…][\"”»)*\]]*\s+|[。！？])(?=\S)")
# Words after which no sentence ends in any of the five languages.
_LEADS_ON = frozenset("the and or than because if their its und oder der dem das dass weil et le les une du des que el los las del según и или что".split())
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_DIGIT_CHOICE = re.compile(r"(?:option|answer|choice|opción|respuesta|réponse|antwort|ответ)\W*\d$", re.I)


def open_signs(text: str) -> list[str]:
    """The stack of signs that are open at the end; a sign that closes nothing is passed over."""
    stack: list[str] = []
    for found in _SIGN.finditer(text):
        sign = found[0]
        if sign in "([{«„":
            # ":(" and ":-(" are faces
            if sign != "(" or text[found.start() - 1 : found.start()] not in (":", ";") and text[max(0, found.start() - 2) : found.start()] not in (":-", ";-"):
                stack.append(sign)
        elif sign == "“":
            if stack and stack[-1] == "„":
                stack.pop()
            else:
                stack.append(sign)
        elif sign in _CLOSES:
            want = _CLOSES[sign]
            if want in stack:
                while stack.pop() != want:
                    pass
        elif sign in ('"', "**", "`"):
            if sign in stack:
                while stack.pop() != sign:
                    pass
            # behind a digit it is a measure
            elif sign != '"' or not text[found.start() - 1 : found.start()].isdigit():
                stack.append(sign)
        else:
            name = re.match(r"</?([A-Za-z][\w-]*)", sign)[1].lower()
            if sign[1] == "/":
                if f"<{name}>" in stack:
                    while stack.pop() != f"<{name}>":
                        pass
            elif name not in _VOID and sign[-2] != "/":
                stack.append(f"<{name}>")
    return stack


def begun(text: str) -> bool:
    """Whether a text ends within a tag, an escape, an entity, an encoded address or a multibyte sequence."""
    last = text[-1:]
    if last in ("\ufffd", "\u200d") or "\ud800" <= last <= "\udfff":
        return True
    found = _ESCAPE.search(text)
    if found and (len(found[0]) - len(found[0].lstrip("\\"))) % 2 and not re.search(r"(?:^|\s)[A-Za-z]:\\\S*$", text[-300:]):
        return True
    found = _ENTITY.search(text)
    if found:
        name = found[1]
        if name.startswith("#") or (len(name) > 1 and any(e.startswith(name) for e in _ENTITIES)) or (any(e.startswith(name) for e in _ENTITIES) and _WHOLE_ENTITY.search(text)):
            return True
    found = _PERCENT.search(text) if "%" in text[-2:] else None
    if found and _ENCODED.search(found[0]):
        return True
    at = text.rfind("<")
    found = _BEGUN_TAG.match(text, at) if at >= 0 else None
    if found and (found[3].strip("/") or any(t.startswith((found[2] or "").lower()) for t in _TAGS if found[2]) or (found[1] and not found[2])):
        return True
    return bool(_LEAD.search(text[-2:]) and _MISREAD.search(text))


def last_clause(text: str) -> str:
    """What stands after the last end of a sentence or line."""
    line, end = text[text.rfind("\n") + 1 :], 0
    for found in _ENDED.finditer(line):
        end = found.end()
    return line[end:]


def states_choice(text: str, options: Sequence[str]) -> bool:
    """Whether a text without a terminator ends with its final choice: an option's label after words that lead to it, or a whole option."""
    clause = last_clause(text).strip()
    if _LISTED.match(clause):
        return False
    found = _CHOICE.match(clause)
    if found:
        lead, wrapped = found[1].strip(), clause[found.start(2) - 1 : found.start(2)] in ("(", "*", "[")
        if wrapped or lead[-1:] in (":", "=") or len(lead.split()) >= 2:
            return True
    if _DIGIT_CHOICE.search(clause):
        return True
    letters = squeeze(clause)
    return any(len(o) < len(letters) and letters.endswith(o) for o in map(squeeze, options) if o)


def style(text: str) -> bool | None:
    """Whether the sentences and lines inside a text, its last one left out, end with terminators: most do, or most don't; None if there are none.

    Items of a list and their labels tell nothing.
    """
    ended = sum(len(found) > 1 for found in _INNER_END.findall(text))
    lines = [line.strip() for line in text.rstrip().split("\n")[:-1]]
    bare = sum(line[-1:].isalnum() and not _LISTED.match(line) for line in lines)
    return ended >= bare if ended or bare else None


def leads_on(text: str) -> bool:
    """Whether the last sign or word of a text asks for more: a comma, or a word that ends no sentence."""
    end = text.rstrip()
    if end[-1:] in (",", "،", "、"):
        return True
    words = end[-40:].split()
    return bool(words) and words[-1].lower() in _LEADS_ON


def numbers(text: str) -> tuple[int, int]:
    """Numbers inside a text, the last word left out, and those of them with decimals."""
    words = _NUMBER.findall(text.rstrip().rpartition(" ")[0])
    return len(words), sum("." in w or "," in w for w in words)


def evidence(text: str, sentence: str | None, options: Sequence[str | None] | None) -> str:
    """complete, or how a cut shows: broken, ellipsis, open, point, number, label or unterminated."""
    shown = _shown(text, [o for o in options or () if o])
    return "complete" if shown != "complete" and sentence and repeats(squeeze(text), squeeze(sentence)) else shown


def _shown(text: str, choices: Sequence[str]) -> str:
    end = text.rstrip()
    if not end:
        return "complete"
    if begun(end):
        return "broken"
    if _ELLIPSIS.search(end):
        return "ellipsis"
    left = open_signs(end)
    if left:
        quoted = left == ['"'] and squeeze(end.rpartition('"')[2]) in {squeeze(o) for o in choices}
        return "complete" if quoted else "open"
    bare = end.rstrip(_CLOSERS)
    while bare.endswith(">") and _TAG.match(bare, bare.rfind("<")):
        bare = bare[: bare.rfind("<")].rstrip(_CLOSERS)
    if not bare:
        return "complete"
    if bare[-1] in ".!?。！？":
        if bare[-1] == "." and bare[-2:-1].isdigit():
            return "point"
        line = bare[bare.rfind("\n") + 1 :].strip()
        return "label" if _LIST_LABEL.match(line) else "complete"
    if states_choice(end, choices):
        return "complete"
    return "number" if bare[-1].isdigit() else "unterminated"


def _scanned():
    schema = pa.schema([("result_id", pa.int64()), ("sampler", pa.string()), ("shown", pa.string()), ("length", pa.int32()), ("style", pa.bool_()), ("leads_on", pa.bool_()), ("numbers", pa.int32()), ("decimals", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, samplers, sentences, options, texts = (batch.column(i).to_pylist() for i in range(5))
            shown = [evidence(t, s, o) for t, s, o in zip(texts, sentences, options)]
            counted = [numbers(t) for t in texts]
            columns = (ids, samplers, shown, [len(t) for t in texts], [style(t) for t in texts], [leads_on(t) for t in texts], [n for n, _ in counted], [d for _, d in counted])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def scanned(results: DataFrame) -> DataFrame:
    """result_id, sampler, shown (the evidence), length, style, leads_on, numbers and decimals of each reasoning text, redelivered rows once, written to the checkpoint folder."""
    rows = results.where("cot_reasoning IS NOT NULL AND result_id IS NOT NULL").select("result_id", "sampler", "sentence", "options", "cot_reasoning")
    seen = spread(rows).mapInArrow(_scanned(), "result_id long, sampler string, shown string, length int, style boolean, leads_on boolean, numbers int, decimals int")
    return cut(seen.groupBy("result_id").agg(F.min(F.struct("sampler", "shown", "length", "style", "leads_on", "numbers", "decimals")).alias("x")).select("result_id", "x.*"))


def _judged(seen: DataFrame, baseline: float) -> DataFrame:
    """Adds ``cut``; a source without a name is one of its own.

    Cuts lower the share of ended texts, but not the style inside the texts: a
    missing end counts if either tells that the source ends its sentences. Where
    neither does, it counts in a text whose last word or comma asks for more. A
    number before the last full stop is cut where half of the source's numbers
    or more have decimals.
    """
    source = F.coalesce("sampler", F.lit(""))
    usual = seen.groupBy(source.alias("_source")).agg(
        F.avg(F.when(F.col("shown").isin("complete", "point", *_UNENDED), F.col("shown").isin("complete", "point").cast("double"))).alias("usual"), F.avg(F.col("style").cast("double")).alias("inside"),
        (2 * F.sum("decimals") >= F.greatest(F.sum("numbers"), F.lit(1))).alias("decimal"))
    joined = seen.withColumn("_source", source).join(usual, "_source", "left")
    known = F.coalesce(F.col("usual") >= baseline, F.lit(True)) | F.coalesce(F.col("inside") >= baseline, F.lit(False)) | F.col("leads_on")
    counts = F.when(F.col("shown") == "point", F.col("decimal")).when(F.col("shown").isin(*_UNENDED), known).otherwise(F.col("shown") != "complete")
    return joined.withColumn("cut", counts).drop("_source", "usual", "inside", "decimal", "style", "leads_on", "numbers", "decimals")


def truncated(results: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """result_id of the rows whose cot_reasoning was cut off.

    A null text is none, an empty or blank one is whole. A full copy of the
    sentence is whole, and so is a text whose last words state a choice.
    Redelivered rows count once, rows without an id not at all; an empty table gives no row; other columns are
    ignored; very long texts are read whole.
    """
    return _judged(scanned(results), baseline).where("cut").select("result_id")


def by_source(results: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """Per sampler: texts, cut, share, the evidence counts, and the length at which most cut texts end, with how many do."""
    judged = _judged(scanned(results), baseline)
    kinds = ("broken", "ellipsis", "open", "point", "number", "label", "unterminated")
    total = judged.groupBy("sampler").agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"),
        *[F.count_if(F.col("cut") & (F.col("shown") == k)).alias(k) for k in kinds])
    limits = judged.where("cut").groupBy("sampler", "length").agg(F.count("*").alias("n")).groupBy("sampler").agg(F.max(F.struct("n", "length")).alias("m"))
    return total.alias("t").join(limits.alias("l"), F.col("t.sampler").eqNullSafe(F.col("l.sampler")), "left").select("t.*", F.col("m.length").alias("usual_limit"), F.col("m.n").alias("at_limit"))
