"""Queries of data preparation, event windows, streams, and general SQL coverage (the last as extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.operators import evaluation as ev
from pairlens.operators import logits as lg
from pairlens.operators import outcomes, sequences
from pairlens.plans import q_evaluation as qe
from pairlens.plans import relations as rel
from pairlens.plans.durable import shared_folder
from pairlens.sources import benchmark as bm
from pairlens.sources import event_log
from pairlens.sources import results as rs
from pairlens.sources.tables import table
from pairlens.streaming import decisions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark_examples")


LETTERED = "list_aggregate(list_transform(range(1, len(options) + 1), lambda i: chr(CAST(64 + i AS INT)) || '. ' || trim(options[i])), 'string_agg', chr(10))"


@query(f"SELECT id, {LETTERED} AS lettered FROM benchmark_examples")
def option_lettering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("id", bm.lettered(F.col("options")).alias("lettered"))


KEYED = """coalesce(nullif(list_position(choice_labels, answer_key), 0), CASE WHEN regexp_full_match(answer_key, '[0-9]+') THEN CAST(answer_key AS INT) WHEN regexp_full_match(answer_key, '[A-Za-z]') THEN ascii(upper(answer_key)) - 64 END, 1)"""


@query(f"SELECT id, CAST(CASE WHEN {KEYED} BETWEEN 1 AND len(options) THEN {KEYED} ELSE 1 END AS VARCHAR) AS option_no FROM benchmark_examples")
def answer_key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("id", bm.key_to_option(F.col("choice_labels"), F.col("answer_key"), F.col("options")).alias("option_no"))


@query("SELECT id, CAST(coalesce(nullif(list_position(choice_labels, answer_key), 0), 1) AS VARCHAR) AS option_no FROM benchmark_examples")
def answer_key_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("id", bm.strict_key_to_option(F.col("choice_labels"), F.col("answer_key")).alias("option_no"))


@query("SELECT id, CASE WHEN TRY_CAST(correct_option AS INT) BETWEEN 1 AND len(options) THEN options[TRY_CAST(correct_option AS INT)] END AS gold FROM benchmark_examples")
def gold_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("id", ev.gold_answer(F.col("options"), F.col("correct_option")).alias("gold"))


@query(f"""SELECT id, 'System: {bm.DIRECT_SYSTEM}' || chr(10) || chr(10) || 'User: ' || question || chr(10) || chr(10) || {LETTERED} || chr(10) || chr(10) || 'Assistant: {bm.DIRECT_LEAD}' AS prompt FROM benchmark_examples""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bm.messages(F.col("question"), F.col("options"))
    return _examples(spark, sf_dir).select("id", bm.chat_text(turns, bm.DIRECT_LEAD).alias("prompt"))


@query(f"""SELECT id, 'System: {bm.REASONING_SYSTEM}' || chr(10) || chr(10) || 'User: ' || question || chr(10) || chr(10) || {LETTERED} || chr(10) || chr(10) || 'Assistant: ' AS prompt FROM benchmark_examples""")
def reasoning_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bm.reasoning_messages(F.col("question"), F.col("options"))
    return _examples(spark, sf_dir).select("id", bm.chat_text(turns, "").alias("prompt"))


@query(f"""WITH d AS (SELECT DISTINCT ON (result_id) * FROM detailed_results WHERE cot_reasoning IS NOT NULL)
SELECT result_id, 'System: {bm.REASONING_SYSTEM}' || chr(10) || chr(10) || 'User: ' || sentence || chr(10) || chr(10) || {LETTERED} || chr(10) || chr(10) || 'Assistant: ' || cot_reasoning || chr(10) || chr(10) || 'User: {bm.FINAL_QUESTION.replace("'", "''")}' || chr(10) || chr(10) || 'Assistant: {bm.REASONED_LEAD}' AS prompt FROM d""")
def final_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded reasoning and the question for the final answer."""
    rows = table(spark, sf_dir, "detailed_results").where("cot_reasoning IS NOT NULL").select("result_id", "sentence", "options", "cot_reasoning").dropDuplicates(["result_id"])
    turns = bm.messages(F.col("sentence"), F.col("options"), F.col("cot_reasoning"))
    return rows.select("result_id", bm.chat_text(turns, bm.REASONED_LEAD).alias("prompt"))


_SHAPED = "CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 4"


def _arc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions as JSON texts in four shapes."""
    shape = F.pmod(F.regexp_extract("id", "[0-9]+$", 0).cast("long"), F.lit(4))
    labels = F.coalesce("choice_labels", F.slice(F.array(*map(F.lit, "ABCDEFGH")), F.lit(1), F.size("options")))
    both = F.struct(F.col("options").alias("text"), labels.alias("label"))
    head = lambda choices: F.to_json(F.struct("id", "question", choices.alias("choices"), F.col("answer_key").alias("answerKey")))
    values = F.map_from_arrays(F.transform("options", lambda o, i: F.concat(F.lit("o"), i.cast("string"))), F.col("options"))
    return _examples(spark, sf_dir).select(F.when(shape == 0, head(both)).when(shape == 1, head(F.struct(both.alias("choices")))).when(shape == 2, head(F.col("options"))).otherwise(head(values)).alias("payload"))


@query(f"""WITH e AS (SELECT *, CASE WHEN {_SHAPED} < 2 AND choice_labels IS NOT NULL THEN choice_labels ELSE list_transform(range(1, len(options) + 1), lambda i: chr(CAST(64 + i AS INT))) END AS labels FROM benchmark_examples)
SELECT id, list_aggregate(options, 'string_agg', '|') AS options, list_aggregate(labels, 'string_agg', '|') AS labels,
  coalesce(CAST(nullif(list_position(labels, coalesce(answer_key, '')), 0) AS VARCHAR), CASE WHEN regexp_full_match(answer_key, '[0-9]+') THEN CAST(CAST(answer_key AS BIGINT) AS VARCHAR) END, '1') AS correct_option FROM e""")
def lenient_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm.lenient_arc(_arc_texts(spark, sf_dir))
    return rows.select("id", F.array_join("options", "|").alias("options"), F.array_join("choice_labels", "|").alias("labels"), "correct_option")


_VOCABULARY = "v AS (SELECT vec_id AS token_id, CASE vec_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE '' END || chr(CAST(65 + vec_id % 7 AS INT)) || CASE vec_id % 3 WHEN 2 THEN '.' ELSE '' END AS text FROM embeddings WHERE label < 3)"


@query(f"""WITH {_VOCABULARY}, l AS (SELECT DISTINCT unnest(list_concat(choice_labels, ['X1', 'ZA', '7'])) AS label FROM benchmark_examples WHERE choice_labels IS NOT NULL),
c AS (SELECT label, 0 AS place, ' ' || label AS text FROM l UNION ALL SELECT label, 1, label FROM l UNION ALL SELECT label, 2, label || '.' FROM l UNION ALL SELECT label, 3, ' ' || label || '.' FROM l UNION ALL SELECT label, 10 + i, substr(label, i) FROM l, range(1, 9) AS r(i) WHERE i <= length(label))
SELECT l.label, CAST(coalesce((SELECT arg_min(v.token_id, (c.place, v.token_id)) FROM c JOIN v ON v.text = c.text WHERE c.label = l.label), ascii(l.label)) AS INT) AS token_id FROM l""")
def answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of answer labels in a vocabulary that has some letters after a space, some alone and some with a full stop."""
    v = F.col("vec_id")
    text = F.concat(F.when(v % 3 == 0, " ").otherwise(""), F.char(65 + v % 7), F.when(v % 3 == 2, ".").otherwise(""))
    vocabulary = table(spark, sf_dir, "embeddings").where("label < 3").select(v.alias("token_id"), text.alias("text"))
    labels = _examples(spark, sf_dir).where("choice_labels IS NOT NULL").select(F.explode(F.concat("choice_labels", F.array(*map(F.lit, ("X1", "ZA", "7"))))).alias("label"))
    return bm.answer_tokens(labels, vocabulary)


@query("SELECT * EXCLUDE (n) FROM (SELECT id, dataset, question, row_number() OVER (PARTITION BY dataset ORDER BY id) AS n FROM benchmark_examples) WHERE n <= 5")
def limit_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.limit_each(_examples(spark, sf_dir).select("id", "dataset", "question"), 5)


_RAW_STEM = "SELECT question, options AS choices, TRY_CAST(correct_option AS INT) - 1 AS answer, ['anatomy', 'law', 'virology'][length(id) % 3 + 1] AS subject FROM benchmark_examples"


@query(f"""WITH raw AS ({_RAW_STEM}), d AS (SELECT DISTINCT * FROM raw WHERE subject <> 'law')
SELECT 'mmlu_stem_' || (row_number() OVER (ORDER BY question, to_json(choices)::VARCHAR, subject) - 1) AS id, 'mmlu_stem' AS dataset, question, subject, CASE WHEN answer BETWEEN 0 AND len(choices) - 1 THEN CAST(answer + 1 AS VARCHAR) END AS correct_option,
  CASE WHEN answer BETWEEN 0 AND len(choices) - 1 THEN choices[answer + 1] END AS correct_answer, coalesce(answer BETWEEN 0 AND len(choices) - 1, false) AS valid FROM d
UNION ALL SELECT 'hellaswag_' || (row_number() OVER (ORDER BY question, to_json(choices)::VARCHAR) - 1), 'hellaswag', question, NULL, CAST(answer + 1 AS VARCHAR), choices[answer + 1], true FROM d WHERE answer BETWEEN 0 AND len(choices) - 1""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets in one form: one of subjects, of which some are kept, and one whose answers are texts, without rejects."""
    rows = _examples(spark, sf_dir)
    subjects = F.array(*map(F.lit, ("anatomy", "law", "virology")))
    stem = rows.select("question", F.col("options").alias("choices"), (F.col("correct_option").try_cast("int") - 1).alias("answer"), F.element_at(subjects, F.length("id") % 3 + 1).alias("subject")).distinct()
    swag = stem.where("subject <> 'law' AND answer BETWEEN 0 AND size(choices) - 1").select(F.col("question").alias("ctx"), F.col("choices").alias("endings"), F.col("answer").cast("string").alias("label"), *[F.lit(None).cast("string").alias(c) for c in ("activity_label", "ctx_a", "ctx_b")])
    both = bm.union_all([bm.standardize(stem, "mmlu_stem"), bm.standardize(swag, "hellaswag")])
    return both.select("id", "dataset", "question", "subject", "correct_option", "correct_answer", "valid")


@query("SELECT id, question FROM benchmark_examples WHERE length(question) % 7 <> 0")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions through a file of lines, a seventh of which is broken."""
    path = shared_folder(spark, "lines")
    line = F.to_json(F.struct("id", "question"))
    broken = F.length("question") % 7 == 0
    _examples(spark, sf_dir).select(F.when(broken, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return bm.read_jsonl(spark, path, "id string, question string").select("id", "question")


@query("SELECT DISTINCT result_id, sampler, correct, elapsed_ms FROM detailed_results WHERE result_id IS NOT NULL")
def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as documents and read again."""
    path = shared_folder(spark, "results")
    rows = table(spark, sf_dir, "detailed_results").where("result_id IS NOT NULL").select("result_id", "sampler", "correct", "elapsed_ms").distinct()
    rs.write_results(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT id, any_value(sampler) AS sampler FROM (SELECT DISTINCT id, sampler FROM detailed_results WHERE sampler = 'greedy' AND id IS NOT NULL) GROUP BY id")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the newer of two result files."""
    path = shared_folder(spark, "files")
    for name in ("dcbs", "greedy"):
        ids = table(spark, sf_dir, "detailed_results").where((F.col("sampler") == name) & F.col("id").isNotNull()).select("id").distinct()
        whole = ids.agg(F.collect_list(F.struct("id", F.lit(name).alias("sampler"))).alias("detailed_results"))
        rs.write_results(whole.coalesce(1), f"{path}/{name}")
    return rs.latest_results(spark, f"{path}/*").select("id", "sampler")


@query("SELECT DISTINCT ON (run_id, id, sampler) run_id, id, sampler, result_id FROM detailed_results WHERE result_id IS NOT NULL ORDER BY run_id, id, sampler, result_id")
def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an example evaluated several times in a run the first result."""
    rows = table(spark, sf_dir, "detailed_results").where("result_id IS NOT NULL").select(F.struct("run_id", "id").alias("ctx_id"), "sampler", "result_id")
    return ev.first_of(rows, "result_id").select("ctx_id.run_id", "ctx_id.id", "sampler", "result_id")


@query("""WITH d AS (SELECT DISTINCT ON (result_id) * FROM detailed_results), s AS (SELECT run_id, sampler, count(*) AS completed, max(completed_at) AS timestamp FROM d GROUP BY 1, 2)
SELECT run_id, completed FROM s WHERE sampler = 'dcbs' ORDER BY completed DESC, timestamp DESC NULLS LAST LIMIT 1""")
def compatible_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The furthest run whose settings fit."""
    rows = table(spark, sf_dir, "detailed_results").select("result_id", "run_id", "sampler", "completed_at").dropDuplicates(["result_id"])
    states = rows.groupBy("run_id", "sampler").agg(F.count("*").alias("completed"), F.max("completed_at").alias("timestamp"))
    return rs.latest_compatible(states, {"sampler": "dcbs"}).select("run_id", "completed")


@query("""WITH d AS (SELECT DISTINCT timing_id, run_id, sampler, called_at FROM sampler_timings), g AS (SELECT *, lag(called_at) OVER (PARTITION BY run_id, sampler ORDER BY called_at, timing_id) AS before FROM d)
SELECT timing_id, run_id || '_' || strftime(called_at, '%Y%m%d_%H%M%S') AS stamp, epoch_ms(called_at) - epoch_ms(before) AS waited_ms, coalesce(called_at - before > INTERVAL 1 HOUR, true) AS expired FROM g""")
def call_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per call a stamped name, the milliseconds since the one before, and whether that is longer than an hour."""
    rows = table(spark, sf_dir, "sampler_timings").select("timing_id", "run_id", "sampler", F.col("called_at").cast("timestamp").alias("at"), F.date_format("called_at", "yyyyMMdd_HHmmss").alias("text")).distinct()
    before = F.lag("at").over(Window.partitionBy("run_id", "sampler").orderBy("at", "timing_id"))
    waited = F.unix_millis("at") - F.unix_millis("before")
    gaps = rows.withColumn("before", before)
    return gaps.select("timing_id", F.concat_ws("_", "run_id", "text").alias("stamp"), waited.alias("waited_ms"), F.coalesce(F.unix_micros("at") - F.unix_micros("before") > 3_600_000_000, F.lit(True)).alias("expired"))


@query("SELECT id, o AS option, count(*) AS times FROM (SELECT id, unnest(options) AS o FROM benchmark_examples) GROUP BY id, o HAVING count(*) > 1")
def option_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("id", F.explode("options").alias("option")).groupBy("id", "option").agg(F.count("*").alias("times")).where("times > 1")


_ONCE = "WITH d AS (SELECT DISTINCT ON (result_id) * FROM detailed_results)"


@query(_ONCE + """, e AS (SELECT result_id, unnest(map_entries(answer_ids)) AS e FROM d WHERE answer_ids IS NOT NULL)
SELECT result_id, e.value AS token, string_agg(e.key, '|' ORDER BY e.key) AS options FROM e GROUP BY 1, 2 HAVING count(*) > 1""")
def token_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a question that share a token."""
    rows = table(spark, sf_dir, "detailed_results").select("result_id", "answer_ids").dropDuplicates(["result_id"])
    return bm.sharing_tokens(rows.select("result_id", F.explode("answer_ids").alias("option", "token")), "result_id")


@query(_ONCE + """ SELECT result_id, coalesce(list_contains([correct_id, correct_id + 1], pred_id), false) OR coalesce(lower(trim(predicted_answer, ' ')) = lower(trim(correct_answer, ' ')), false) AS matches FROM d""")
def multitoken_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two tokens, the second of which is the one after the first."""
    rows = table(spark, sf_dir, "detailed_results").select("result_id", "pred_id", "correct_id", "predicted_answer", "correct_answer").dropDuplicates(["result_id"])
    return rows.select("result_id", ev.token_match(F.col("pred_id"), F.col("predicted_answer"), F.col("correct_answer"), F.array("correct_id", F.col("correct_id") + 1)).alias("matches"))


@query("""SELECT d.result_id, b.dataset, b.correct_option FROM (SELECT DISTINCT ON (result_id) result_id, id FROM detailed_results) AS d JOIN benchmark_examples AS b ON b.id = d.id""")
def examples_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "detailed_results").select("result_id", "id").dropDuplicates(["result_id"])
    return rows.join(_examples(spark, sf_dir).select("id", "dataset", "correct_option"), "id").select("result_id", "dataset", "correct_option")


@query("SELECT id FROM benchmark_examples WHERE id NOT IN (SELECT id FROM detailed_results WHERE id IS NOT NULL)")
def examples_never_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("id").join(table(spark, sf_dir, "detailed_results").select("id"), "id", "left_anti")


# windows over events


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""SELECT event_id, round(a, 6) AS average FROM (SELECT event_id, avg(value) OVER w AS a, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10""")
def moving_avg_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.moving_average(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("average", 6).alias("average"))


@query("""SELECT event_id, row_number() OVER w - 1 AS timestep, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def timestep_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("flag", F.col("event_type") == "error")
    return sequences.numbered(rows, "user_id", ["ts", "event_id"], "flag").select("event_id", F.col("timestep").cast("long").alias("timestep"), F.col("so_far").cast("long").alias("so_far"))


@query(f"WITH {rel.logits_sql()}, {rel.softmax_sql('logits')}, k AS (SELECT * FROM soft QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY p DESC, token_id) <= 10) SELECT ctx_id, string_agg(token_id || ':' || printf('%.4f', p), ',' ORDER BY p DESC, token_id) AS top FROM k GROUP BY ctx_id")
def topk_per_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.likeliest(lg.softmax(rel.logits(spark, sf_dir)))


@query("SELECT user_id, CAST(floor((n - 1) / 25) AS BIGINT) AS bucket, count(*) AS rows FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1, 2")
def checkpoint_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.buckets(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 25).groupBy("user_id", "bucket").agg(F.count("*").alias("rows"))


@query("SELECT event_id, user_id, n FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 10 = 0")
def log_every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.every_nth(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 10).select("event_id", "user_id", F.col("n").cast("long").alias("n"))


@query("""WITH a AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
d AS (SELECT pos - lag(pos) OVER (PARTITION BY user_id, k ORDER BY pos) AS distance FROM a)
SELECT count(*) AS accesses, count(*) FILTER (distance IS NOT NULL) AS repeats, count(*) FILTER (distance <= 20) AS hits_20 FROM d""")
def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").alias("k"))
    d = F.col("distance")
    return sequences.reuse_distance(rows, "user_id", ["ts", "event_id"], "k").agg(F.count("*").alias("accesses"), F.count_if(d.isNotNull()).alias("repeats"), F.count_if(d <= 20).alias("hits_20"))


@query("""WITH a AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
p AS (SELECT *, lag(pos) OVER (PARTITION BY user_id, k ORDER BY pos) AS prev FROM a)
SELECT p.event_id, p.prev IS NOT NULL AND (SELECT count(DISTINCT m.k) FROM a AS m WHERE m.user_id = p.user_id AND m.pos > p.prev AND m.pos < p.pos) < 10 AS hit FROM p""")
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache of the ten keys last used by each user."""
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return sequences.lru_hits(rows, "user_id", ["ts", "event_id"], "k", 10).select("event_id", "hit")


@query("""WITH s AS (SELECT user_id AS sequence_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS token_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS timestep FROM events),
f AS (SELECT sequence_id, min(timestep) FILTER (token_id = 7) AS stop FROM s GROUP BY 1)
SELECT s.sequence_id, count(*) AS steps, count(*) FILTER (s.token_id = 7) AS stopped FROM s JOIN f USING (sequence_id) WHERE s.timestep <= least(coalesce(f.stop, 500), 500) GROUP BY 1""")
def replay_until_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each sequence up to a stop token, as a recorded generation would end."""
    token = F.get_json_object("props", "$.k").cast("int").alias("token_id")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("sequence_id"), "ts", "event_id", token)
    steps = sequences.numbered(rows.withColumn("flag", F.lit(False)), "sequence_id", ["ts", "event_id"], "flag")
    return sequences.until_stop(steps, 7).groupBy("sequence_id").agg(F.count("*").alias("steps"), F.count_if(F.col("token_id") == 7).alias("stopped"))


# the decision log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one sequence per context: a token_disagreement where greedy and cluster-aware selection differ, and a sequence_end."""
    rows = qe.results(spark, sf_dir)
    state = F.struct("token_id", "correct")
    wide = rows.where(F.col("sampler").isin("greedy", "dcbs")).groupBy("ctx_id").agg(F.max(F.when(F.col("sampler") == "greedy", state)).alias("g"), F.max(F.when(F.col("sampler") == "dcbs", state)).alias("d"))
    differ = (F.col("g.token_id") != F.col("d.token_id")).cast("int")
    event = lambda kind, at: F.struct(F.lit(kind).alias("event_type"), F.lit(at).cast("int").alias("timestep"))
    told = F.explode(F.when(differ > 0, F.array(event("sequence_end", None), event("token_disagreement", 0))).otherwise(F.array(event("sequence_end", None)))).alias("e")
    rows = wide.select(
        F.concat(F.lit("run_"), F.pmod("ctx_id", F.lit(3))).alias("run_id"), F.concat(F.lit("seq_"), F.col("ctx_id")).alias("sequence_id"),
        F.struct(F.col("g.correct").alias("greedy_correct"), F.col("d.correct").alias("dcbs_correct")).alias("verdicts"), differ.alias("n"), told)
    end = F.col("e.event_type") == "sequence_end"
    return rows.select("run_id", "sequence_id", F.when(end, F.col("verdicts")).alias("correctness"), F.when(end, F.col("n")).alias("disagreement_count"), "e.event_type", "e.timestep")


OUTCOMES = qe.DIFF + " SELECT 'run_' || (ctx_id % 3) AS run_id, outcome, count(*) AS n FROM diff GROUP BY 1, 2"


@query(OUTCOMES)
def event_outcomes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.by_outcome(_log(spark, sf_dir))


@query(OUTCOMES)
def event_outcomes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream over the log's files."""
    path, state = shared_folder(spark, "log"), shared_folder(spark, "stream-state")
    event_log.append(_log(spark, sf_dir), path)
    name = "outcomes_" + path[-12:]
    decisions.to_table(decisions.running_outcomes(event_log.stream(spark, path)), name, state)
    return spark.table(name)


@query(qe.DIFF + """ SELECT 'run_' || (c.ctx_id % 3) AS run_id, 'seq_' || c.ctx_id AS sequence_id, CASE WHEN d.ctx_id IS NULL THEN 0 ELSE 1 END AS logged, CASE WHEN d.ctx_id IS NULL THEN 0 ELSE 1 END AS counted, d.outcome, true AS closed, 'ended' AS kind
FROM (SELECT DISTINCT ctx_id FROM logits) AS c LEFT JOIN diff AS d ON d.ctx_id = c.ctx_id""")
def sequence_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sequence state over a stream, closed sequences appended to a table of files."""
    path, state, out = (shared_folder(spark, n) for n in ("log", "stream-state", "sequences"))
    event_log.append(_log(spark, sf_dir).repartition(4, "sequence_id"), path)
    closed = decisions.sequences(event_log.stream(spark, path))
    decisions.ingest(closed, out, state).awaitTermination()
    return spark.read.schema(decisions.SEQUENCE).parquet(out)


@query(qe.DIFF + """ SELECT 'run_' || (c.ctx_id % 3) AS run_id, 'seq_' || c.ctx_id AS sequence_id, CASE WHEN c.ctx_id % 4 = 0 THEN NULL WHEN d.ctx_id IS NULL THEN 0 ELSE 1 END AS counted, CASE WHEN d.ctx_id IS NULL THEN 0 ELSE 1 END AS logged, c.ctx_id % 4 <> 0 AS agrees
FROM (SELECT DISTINCT ctx_id FROM logits) AS c LEFT JOIN diff AS d ON d.ctx_id = c.ctx_id WHERE c.ctx_id % 4 <> 0 OR d.ctx_id IS NOT NULL""")
def log_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted against logged disagreements, where a quarter of the sequences was never ended."""
    ended = F.pmod(F.substring_index("sequence_id", "_", -1).cast("long"), F.lit(4)) != 0
    return outcomes.drift(_log(spark, sf_dir).where(ended | (F.col("event_type") != "sequence_end")))


@query(qe.DIFF + """, s AS (SELECT count(DISTINCT ctx_id) AS n FROM logits), o AS (SELECT count(*) AS w, count(*) FILTER (outcome = 'greedy_wins') AS gw, count(*) FILTER (outcome = 'dcbs_wins') AS dw, count(*) FILTER (outcome = 'both_correct') AS bc, count(*) FILTER (outcome = 'both_wrong') AS bw FROM diff)
SELECT n AS sequences, w AS sequences_with, w AS tokens_logged, CAST(w AS BIGINT) AS tokens_counted, gw AS greedy_wins, dw AS dcbs_wins, bc AS both_correct, bw AS both_wrong,
       round(w / greatest(1.0, n), 6) AS token_disagreements_per_sequence, round(100.0 * w / n, 6) AS sequence_disagreement_pct FROM s, o""")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes.counters(_log(spark, sf_dir))
    return rows.withColumn("token_disagreements_per_sequence", F.round("token_disagreements_per_sequence", 6)).withColumn("sequence_disagreement_pct", F.round("sequence_disagreement_pct", 6))


@query(qe.DIFF + """ SELECT ctx_id, outcome, CAST(row_number() OVER (PARTITION BY outcome ORDER BY ctx_id) AS INT) AS pos, greatest(0, count(*) OVER (PARTITION BY outcome) - 10) AS more FROM diff QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY ctx_id) <= 10""")
def first10_per_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.examples(ev.differences(qe.results(spark, sf_dir)).select("ctx_id", "outcome"), "outcome", "ctx_id")


# extensions: windows in time


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.tumbling(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


def _streamed(spark: SparkSession, sf_dir: str, windows) -> DataFrame:
    """What a stream over the events appends: windows that its watermark has passed, each once, its state then dropped."""
    rows = _events(spark, sf_dir)
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream can't be given one file
    out, state = shared_folder(spark, "windows"), shared_folder(spark, "stream-state")
    made = windows(stream)
    decisions.ingest(made, out, state).awaitTermination()
    return spark.read.schema(made.schema).parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT * FROM (SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3) WHERE \"end\" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def tumbling_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda rows: decisions.tumbling(rows, late="1 hour"))


@query("""SELECT * FROM (SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOUR AS start, event_type, value FROM (SELECT *, unnest(range(0, 4)) AS i FROM events)) GROUP BY 1, 2, 3)
WHERE "end" <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def sliding_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda rows: decisions.sliding(rows, late="2 hours"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM o)
SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g) WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def session_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda rows: decisions.sessions(rows, late="1 hour"))


@query("""WITH s AS (SELECT *, unnest(range(0, 4)) AS i FROM events), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOUR AS start, event_type, value FROM s)
SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2, 3""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.sliding(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.sessions(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


# extensions: general joins, groupings and set operations


@query("""SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders AS o JOIN customer AS c ON c.c_custkey = o.o_custkey JOIN nation AS n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name""")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per_customer = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    joined = per_customer.join(c, per_customer.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer AS c LEFT JOIN orders AS o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counted, "c_custkey", "left").fillna(0, ["orders"])


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(big, "p_partkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT e.event_id, (SELECT max_by(p.value, p.ts) FROM events AS p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS last_purchase FROM events AS e WHERE e.event_type = 'error'""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    left = rows.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return sequences.as_of(left, right, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.fillna("all", ["l_returnflag", "l_linestatus"])


@query("SELECT coalesce(o_orderpriority, 'all') AS o_orderpriority, coalesce(o_orderstatus, 'all') AS o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def grouping_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).fillna("all", ["o_orderpriority", "o_orderstatus"])


@query("SELECT l_suppkey AS suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("suppkey"))
    return a.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return a.subtract(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def approx_distinct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate is within three of its standard deviations (2 % each) of the count."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.countDistinct("l_partkey").alias("parts"))
    return rows.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.06 * F.col("parts")).alias("near"))


@query("SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
