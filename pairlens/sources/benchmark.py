"""Benchmark questions: readers, and the shapes of several datasets made one.

``correct_option`` is a 1-based number in a string everywhere after reading;
0-based inputs are converted once, here.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.errors import DataError
from pairlens.operators.sequences import in_order

EXAMPLE = "id string, question string, options array<string>, choice_labels array<string>, correct_option string, answer_key string"
RAW_ARC = "id string, question string, choices struct<text array<string>, label array<string>>, answerKey string"
RAW_HELLASWAG = "ctx string, endings array<string>, label string, activity_label string, ctx_a string, ctx_b string"
RAW_MMLU = "question string, choices array<string>, answer int, subject string"


@dataclass(frozen=True)
class DatasetSpec:
    """How a dataset is read: its schema and the columns of question, choices and answer."""

    schema: str
    question: str
    choices: str
    answer: str
    subjects: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()


#: Subjects of the multi-subject dataset that are kept.
SUBJECTS = (
    "abstract_algebra", "anatomy", "astronomy", "college_biology", "college_chemistry", "college_computer_science",
    "college_mathematics", "college_physics", "computer_security", "conceptual_physics", "electrical_engineering",
    "elementary_mathematics", "high_school_biology", "high_school_chemistry", "high_school_computer_science",
    "high_school_mathematics", "high_school_physics", "high_school_statistics", "machine_learning", "medical_genetics",
    "nutrition", "professional_medicine", "virology",
)
SPECS = {
    "arc_easy": DatasetSpec(RAW_ARC, "question", "choices.text", "answerKey"),
    "arc_challenge": DatasetSpec(RAW_ARC, "question", "choices.text", "answerKey"),
    "hellaswag": DatasetSpec(RAW_HELLASWAG, "ctx", "endings", "label", extra=("activity_label", "ctx_a", "ctx_b")),
    "mmlu_stem": DatasetSpec(RAW_MMLU, "question", "choices", "answer", SUBJECTS, ("subject",)),
}


def spec_of(key: str) -> DatasetSpec:
    if key not in SPECS:
        raise ValueError(f"unknown dataset {key}; known: {', '.join(SPECS)}")
    return SPECS[key]


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of examples. Missing or empty files, or a first example without question or options, raise."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    rows = spark.read.schema(f"{EXAMPLE}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    first = rows.limit(1).collect()
    if not first:
        raise DataError(f"no examples in {path}")
    if first[0]["_corrupt_record"] is not None:
        raise DataError(f"not a JSON array of examples: {path}")
    missing = [f for f in ("question", "options") if first[0][f] is None]
    if missing:
        raise DataError(f"examples of {path} lack {', '.join(missing)}")
    return rows.drop("_corrupt_record")


# Sample questions, written for this purpose, for trying things out without a file.
SAMPLE = (
    ("sample_1", "Which of these floats on water?", ["a nail", "a cork", "a coin", "a stone"], ["A", "B", "C", "D"], "2", "B"),
    ("sample_2", "What do roots take up?", ["light", "sound", "water"], ["A", "B", "C"], "3", "C"),
    ("sample_3", "Which season comes after winter?", ["spring", "autumn"], ["1", "2"], "1", "1"),
)


def examples_or_sample(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The examples of a file, or the sample questions where it is missing or holds none; and whether they are the sample."""
    try:
        return read_examples(spark, path), False
    except (FileNotFoundError, DataError):
        return spark.createDataFrame(list(SAMPLE), EXAMPLE), True


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def malformed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that ``read_jsonl`` drops."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.select("*").where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def answer_index(answer: Column) -> Column:
    """0-based index of an answer: digits as they are, a letter by its place in the alphabet, else null."""
    text = F.trim(answer.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(text.rlike("^[A-Za-z]$"), F.ascii(F.upper(text)) - 65)


def standardize(raw: DataFrame, key: str) -> DataFrame:
    """id, dataset, question, options, correct_option (1-based), correct_answer, valid, and the dataset's own columns.

    Rows whose answer names no choice have valid = false; keep them apart with
    ``accepted`` and ``rejects``. ids number the rows in the order of question
    and choices, so that they don't hang on partitions; ranges of that order
    are numbered side by side.
    """
    s = spec_of(key)
    rows = of_subjects(raw, s)
    index = answer_index(F.col(s.answer))
    choices = F.col(s.choices)
    numbered = in_order(rows.withColumn("_question", F.col(s.question)).withColumn("_choices", F.to_json(F.struct(choices.alias("c")))), ["_question", "_choices"], "_position")
    valid = index.isNotNull() & (index < F.size(choices)) & (index >= 0)
    return numbered.select(
        F.concat(F.lit(f"{key}_"), F.col("_position")).alias("id"), F.lit(key).alias("dataset"), F.col(s.question).alias("question"), choices.alias("options"),
        F.when(valid, (index + 1).cast("string")).alias("correct_option"), F.when(valid, F.element_at(choices, index + 1)).alias("correct_answer"), F.coalesce(valid, F.lit(False)).alias("valid"), *s.extra)


def of_subjects(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The rows of the subjects that a dataset keeps, all where it names none."""
    return raw.where(F.col("subject").isin(list(spec.subjects))) if spec.subjects else raw


def load(spark: SparkSession, key: str, root: str, limit: int | None = None) -> DataFrame:
    """A dataset in standard form from ``root``/<key>.jsonl or .parquet, its first ``limit`` rows by id number."""
    spec = spec_of(key)
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, not {limit}")
    path = f"{root.rstrip('/')}/{key}"
    if os.path.exists(f"{path}.parquet"):
        raw = spark.read.parquet(f"{path}.parquet")
    elif os.path.exists(f"{path}.jsonl"):
        raw = read_jsonl(spark, f"{path}.jsonl", spec.schema)
    else:
        raise FileNotFoundError(f"{path}.jsonl")
    rows = standardize(raw, key)
    return rows if limit is None else rows.orderBy(F.substring_index("id", "_", -1).cast("long")).limit(limit)


def load_many(spark: SparkSession, keys: str | list[str], root: str, limit: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Several datasets, or "all", under one another, and what went wrong with those that can't be read."""
    wanted = list(SPECS) if keys == "all" else [keys] if isinstance(keys, str) else list(keys)
    frames, failed = [], {}
    for key in wanted:
        try:
            frames.append(load(spark, key, root, limit))
        except (FileNotFoundError, ValueError) as e:
            failed[key] = str(e)
    return (union_all(frames) if frames else None), failed


_LETTERS = [chr(65 + i) for i in range(26)]


def lenient_arc(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """id, question, options, choice_labels, correct_option, answer_key of questions as JSON texts of any of four shapes.

    choices may be {text, label}, {choices: {text, label}}, a list, or an object
    whose values are the options. Missing labels are letters from A on. The
    correct option is the key's place among the labels, else the key if it is a
    number, else "1". Texts that are no object or have other choices give no
    row. A null id becomes arc_<number of options>.
    """
    get = lambda path: F.get_json_object(payload, f"$.{path}")
    texts = lambda path: F.from_json(get(path), "array<string>")
    choices = F.trim(get("choices"))
    first = choices.substr(1, 1)
    flat, nested = get("choices.text").isNotNull() & get("choices.label").isNotNull(), get("choices.choices").isNotNull()
    options = F.when(first == "[", texts("choices")).when(flat, texts("choices.text")).when(nested, F.coalesce(texts("choices.choices.text"), F.array().cast("array<string>"))).when(first == "{", F.map_values(F.from_json(choices, "map<string,string>")))
    given = F.when(flat, texts("choices.label")).when(nested, texts("choices.choices.label"))
    rows = raw.select(get("id").alias("id"), F.coalesce(get("question"), F.lit("")).alias("question"), options.alias("options"), given.alias("_given"), F.coalesce(get("answerKey"), F.lit("")).alias("answer_key")).where(F.col("options").isNotNull())
    letters = F.slice(F.array(*map(F.lit, _LETTERS)), F.lit(1), F.least(F.size("options"), F.lit(26)))
    labelled = rows.withColumn("choice_labels", F.coalesce("_given", letters))
    place = F.nullif(F.array_position("choice_labels", F.col("answer_key")).cast("string"), F.lit("0"))
    number = F.when(F.col("answer_key").rlike("^[0-9]+$"), F.col("answer_key").cast("decimal(38,0)").cast("string"))
    return labelled.select(F.coalesce("id", F.concat(F.lit("arc_"), F.size("options"))).alias("id"), "question", "options", "choice_labels", F.coalesce(place, number, F.lit("1")).alias("correct_option"), "answer_key")


def answer_tokens(labels: DataFrame, vocabulary: DataFrame, label: str = "label") -> DataFrame:
    """label, token_id: the token that stands for each answer label, of a vocabulary (text, token_id).

    Tried in order: the label after a space, alone, with a full stop, and with
    both, as one token; then the last token of the label after a space, which is
    its longest end that is a token; then the code of its first character. Of
    tokens with the same text the lowest counts. Null and empty labels give no
    row.
    """
    wanted = labels.select(F.col(label).alias("label")).where("label <> ''").distinct()
    whole = F.array(*[F.struct(F.lit(i).alias("place"), t.alias("text")) for i, t in enumerate((F.concat(F.lit(" "), F.col("label")), F.col("label"), F.concat("label", F.lit(".")), F.concat(F.lit(" "), "label", F.lit("."))))])
    ends = F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.struct((i + 10).alias("place"), F.expr("substring(label, 1)").substr(i, F.length("label")).alias("text")))
    each = wanted.withColumn("x", F.explode(F.concat(whole, ends))).select("label", "x.place", "x.text")
    known = vocabulary.groupBy("text").agg(F.min("token_id").alias("token_id"))
    found = each.join(known, "text", "left").groupBy("label").agg(F.min_by("token_id", F.when(F.col("token_id").isNotNull(), F.col("place"))).alias("token_id"))
    return found.select("label", F.coalesce(F.col("token_id").cast("int"), F.ascii("label")).alias("token_id"))


def sharing_tokens(options: DataFrame, by: str, option: str = "option", token: str = "token") -> DataFrame:
    """``by``, ``token``, options: options of a question that share a token, "|" between."""
    grouped = options.groupBy(by, token).agg(F.array_join(F.array_sort(F.collect_list(option)), "|").alias("options"), F.count("*").alias("n"))
    return grouped.where("n > 1").drop("n")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("valid").drop("valid")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("NOT valid").drop("valid")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of several datasets; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def limit_each(rows: DataFrame, n: int, by: str = "dataset", order: str = "id") -> DataFrame:
    """The first n rows of each group, by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def key_to_option(labels: Column, key: Column, options: Column) -> Column:
    """1-based number in a string for an answer key: its place among the labels, a number as it is, a letter's place, else "1"."""
    hit = F.nullif(F.array_position(labels, key).cast("int"), F.lit(0))
    digits = F.when(key.rlike("^[0-9]+$"), key.try_cast("int"))
    letter = F.when(key.rlike("^[A-Za-z]$"), F.ascii(F.upper(key)) - 64)
    place = F.coalesce(hit, digits, letter, F.lit(1))
    return F.when((place >= 1) & (place <= F.size(options)), place).otherwise(1).cast("string")


def strict_key_to_option(labels: Column, key: Column) -> Column:
    """As above by the labels alone; a key that is no label gives "1"."""
    return F.coalesce(F.nullif(F.array_position(labels, key).cast("int"), F.lit(0)), F.lit(1)).cast("string")


def lettered(options: Column) -> Column:
    """"A. first\\nB. second" of an array of texts."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), F.trim(o))), "\n")


# The texts of the prompts.
REASONING_SYSTEM = "You are an LLM that thinks step by step before answering."
DIRECT_SYSTEM = "You are a helpful assistant that provides direct answers."
FINAL_QUESTION = "So what's the final answer?"
REASONED_LEAD, DIRECT_LEAD = "The final answer is option", "The correct answer is option"


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _asked(sentence: Column, options: Column) -> Column:
    return _turn("user", F.concat(sentence, F.lit("\n\n"), lettered(options)))


def reasoning_messages(sentence: Column, options: Column) -> Column:
    """Array of (role, content) that asks for a reasoning."""
    return F.array(_turn("system", F.lit(REASONING_SYSTEM)), _asked(sentence, options))


def messages(sentence: Column, options: Column, reasoning: Column | None = None) -> Column:
    """Array of (role, content): a direct prompt, or the reasoning one with a reasoning and the final question."""
    if reasoning is None:
        return F.array(_turn("system", F.lit(DIRECT_SYSTEM)), _asked(sentence, options))
    return F.concat(reasoning_messages(sentence, options), F.array(_turn("assistant", reasoning), _turn("user", F.lit(FINAL_QUESTION))))


def chat_text(turns: Column, lead: str) -> Column:
    """The turns as plain text, one role after another, and the lead of the answer."""
    said = F.transform(turns, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.array_join(said, "\n\n"), F.lit(f"\n\nAssistant: {lead}"))
