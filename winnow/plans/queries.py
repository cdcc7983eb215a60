"""The queries over the reference tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import entities as E
from winnow.functions import text as X
from winnow.operators import coverage as C
from winnow.operators import evidence as V
from winnow.operators import fitness as I
from winnow.operators import results as R
from winnow.operators import scorers as S
from winnow.operators import turns as T
from winnow.operators.selection import select_turns
from winnow.plans.compact import Evaluation, evaluate
from winnow.sources import sessions as N
from winnow.sources import sinks as K
from winnow.sources.scratch import new_path
from winnow.streaming.watcher import events as compaction_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Budgets and thresholds that suit the tables' sizes, for the entity-rich transcript and for `conversations`.
BUDGET, THRESHOLD, CHAT_BUDGET, CHAT_THRESHOLD = 8000, 100, 300, 50


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the transcript: one conversation for each user of `events`, entity-rich -----------------------------------------

_BODY = """concat('step ', cast(event_id as string), '\\n', case event_type
    when 'error' then concat('ValueError in load_mod', cast(event_id % 13 as string), '(ctx) at /srv/app/mod',
         cast(event_id % 50 as string), '/handler.py port ', cast(8000 + event_id % 20 as string), ' 404 Not Found')
    when 'view'  then concat('see http://localhost:', cast(3000 + event_id % 9 as string), '/api/v',
         cast(event_id % 5 as string), '/items and class TurnScore', ' then')
    when 'click' then concat('$ git commit change ', cast(event_id % 30 as string), '\\npip install pkg_',
         cast(event_id % 17 as string))
    else concat('export APP_KEY_', cast(event_id % 23 as string), '=1 in ./src/lib',
         cast(event_id % 11 as string), '/core.py') end,
    repeat(' filler', cast(event_id * 7919 % 400 as int)))"""


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn_index, kind, text, n_records, tokens, tier."""
    e = read(spark, sf_dir, "events")
    records = e.select(F.col("user_id").alias("conv_id"), F.col("ts").alias("line_no"), (F.col("event_id") % 4 == 0).alias("is_user"), F.expr(_BODY).alias("text"), F.lit("").alias("raw"))
    turns = T.joined(T.group_blocks(records)).drop("lines")
    return X.tiers(turns.withColumn("tokens", X.token_count(F.col("text"))), THRESHOLD)


_SQL_TURNS = "WITH " + """rec AS (
    SELECT user_id AS conv_id, ts, event_id % 4 = 0 AS is_user, BODY AS text FROM events
), marks AS (
    SELECT *, CASE WHEN is_user OR coalesce(lag(is_user) OVER w, true) THEN 1 ELSE 0 END AS new FROM rec WINDOW w AS (PARTITION BY conv_id ORDER BY ts)
), numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY ts) - 1 AS turn_index FROM marks
), grouped AS (
    SELECT conv_id, CAST(turn_index AS BIGINT) AS turn_index, CASE WHEN is_user THEN 'user' ELSE 'system' END AS kind,
        string_agg(text, chr(10) ORDER BY ts) AS text, count(*) AS n_records FROM numbered GROUP BY ALL
), turns AS (
    SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
        CASE WHEN kind = 'user' THEN 'user' WHEN ceil(length(text) / 4.0) > 100 THEN 'long' ELSE 'short' END AS tier FROM grouped
)""".replace("BODY", _BODY.replace("'\\n'", "chr(10)").replace("'\\npip", "chr(10), 'pip").replace("as string", "as varchar"))

_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_SQL_VALUES = {
    "url": r"""list_transform(regexp_extract_all(text, 'https?://[^\s<>"''`\])]+'), lambda x: rtrim(x, '.,;:)'))""",
    "file_path": r"""list_transform(regexp_extract_all(regexp_replace(text, '(https?:)//[^\s<>"''`\])]+', '\1 ', 'g'), '(?:[./~])?(?:/[\w.\-]+){2,}'), lambda x: rtrim(x, '.,;:)'))""",
    "port": r"list_filter(list_concat(regexp_extract_all(text, '(?:[Pp]ort|PORT)[= ]+(\d{2,5})', 1), regexp_extract_all(text, ':(\d{2,5})(?:[/\s,\)]|$)', 1)), lambda x: CAST(x AS INTEGER) BETWEEN 80 AND 99 OR CAST(x AS INTEGER) BETWEEN 1024 AND 65535)",
    "http_status": "regexp_extract_all(text, '" + E.HTTP_STATUS + "', 1)",
    "exception": "regexp_extract_all(text, '" + E.EXCEPTION + "', 1)",
    "function": "list_filter(regexp_extract_all(text, '" + E.FUNCTION + f"', 1), lambda x: length(x) >= 4 AND x NOT IN ({_LIST(E.SKIPPED_FUNCTIONS)}))",
    "class_name": "regexp_extract_all(text, '" + E.CLASS_NAME + "', 1)",
    "package": "regexp_extract_all(text, '" + E.PACKAGE + "', 1)",
    "command": "regexp_extract_all(text, '(?m)" + E.COMMAND + "', 1)",
    "env_var": "list_filter(regexp_extract_all(text, '" + E.ENV_VAR + f"', 1), lambda x: length(x) >= 4 AND x NOT IN ({_LIST(E.SKIPPED_ENV_VARS)}) AND (contains(x, '_') OR regexp_matches(x, '^({'|'.join(E.ENV_PREFIXES)})')))",
}


def _sql_entities(source: str, keys: str) -> str:
    parts = [f"SELECT {keys}, '{t}' AS etype, unnest({v}) AS v FROM {source}" for t, v in _SQL_VALUES.items()]
    return f"SELECT DISTINCT {keys}, etype, lower(trim(v)) AS value FROM ({' UNION ALL '.join(parts)}) WHERE length(trim(v)) >= 2"


_SQL_WEIGHT = "CASE etype " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in E.WEIGHTS.items()) + f" ELSE {E.OTHER_WEIGHT} END"
_SQL_TF = f""", ents AS ({_sql_entities('turns', 'conv_id, turn_index, tier')}), n AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
tf AS (SELECT e.*, count(*) OVER w AS tf, count(*) FILTER (tier = 'long') OVER w AS long_tf, ln(n.n / (count(*) OVER w)) AS itf
    FROM ents e JOIN n USING (conv_id) WINDOW w AS (PARTITION BY conv_id, etype, value))"""


def _sql_scores(factor: str) -> str:
    return f""", raw AS (
    SELECT t.conv_id, t.turn_index, t.tokens, coalesce(s, 0) / sqrt(greatest(t.tokens, 1)) AS r FROM turns t LEFT JOIN (
        SELECT conv_id, turn_index, sum({_SQL_WEIGHT} * itf * {factor}) AS s FROM tf WHERE tier = 'long' GROUP BY ALL) x USING (conv_id, turn_index) WHERE t.tier = 'long'
), scores AS (SELECT conv_id, turn_index, tokens, r / CASE WHEN max(r) OVER (PARTITION BY conv_id) > 0 THEN max(r) OVER (PARTITION BY conv_id) ELSE 1 END AS score FROM raw)"""


_SQL_SELECT = f""", marked AS (
    SELECT t.*, s.score, t.tier IN ('user', 'short') OR t.turn_index = max(CASE WHEN t.kind = 'system' THEN t.turn_index END) OVER (PARTITION BY t.conv_id) AS forced,
        round(s.score + 0.15 * t.turn_index / count(*) OVER (PARTITION BY t.conv_id), 9) AS adjusted FROM turns t LEFT JOIN scores s USING (conv_id, turn_index)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY adjusted DESC, turn_index) AS rank FROM marked WHERE NOT forced
), room AS (SELECT conv_id, {BUDGET} - coalesce(sum(tokens) FILTER (forced), 0) AS room FROM marked GROUP BY conv_id
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS turn_index, CAST(room AS BIGINT) AS room, false AS taken FROM room
    UNION ALL
    SELECT w.conv_id, r.rank, r.turn_index, CASE WHEN r.tokens <= w.room THEN w.room - r.tokens ELSE w.room END, r.tokens <= w.room
    FROM walk w JOIN ranked r ON r.conv_id = w.conv_id AND r.rank = w.rank + 1
), selection AS (
    SELECT m.*, m.forced OR coalesce(w.taken, false) AS kept, CASE WHEN m.tier = 'user' THEN 'user' WHEN m.tier = 'short' THEN 'short' WHEN m.forced THEN 'last' WHEN w.taken THEN 'fits' ELSE 'dropped' END AS reason
    FROM marked m LEFT JOIN walk w ON w.conv_id = m.conv_id AND w.turn_index = m.turn_index AND w.rank > 0
)"""
_SQL_SETCOVER = "CASE WHEN long_tf <= 2 THEN 1.2 ELSE 1.0 END"
_SQL_EITF = _SQL_TURNS + _SQL_TF + _sql_scores("1.0")
_SQL_SELECTION = (_SQL_EITF + _SQL_SELECT).replace("WITH ", "WITH RECURSIVE ", 1)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcript(spark, sf_dir)
    return select_turns(turns, S.eitf(turns), BUDGET)


# --- turns, tiers, splits ---------------------------------------------------------------------------------------------


@query(_SQL_TURNS + " SELECT conv_id, turn_index, kind, n_records, length(text) AS n_chars FROM turns")
def turn_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript(spark, sf_dir).select("conv_id", "turn_index", "kind", "n_records", F.length("text").cast("long").alias("n_chars"))


_CLASS = "CASE event_type WHEN 'error' THEN 'compacted' WHEN 'view' THEN 'context' WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'system' ELSE 'other' END"


@query(f"""WITH rec AS (SELECT user_id AS conv_id, ts, {_CLASS} AS class FROM events), kept AS (SELECT *, lag(class) OVER (PARTITION BY conv_id ORDER BY ts) AS before FROM rec WHERE class <> 'other'),
    marks AS (SELECT *, CASE WHEN class IN ('compacted', 'context') OR (class = 'user' AND coalesce(before, '') NOT IN ('context', 'user')) OR (class = 'system' AND coalesce(before, '') <> 'system') THEN 1 ELSE 0 END AS new FROM kept),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY ts) - 1 AS turn_index FROM marks)
    SELECT conv_id, CAST(turn_index AS BIGINT) AS turn_index, CASE WHEN class IN ('context', 'user') THEN 'user' ELSE 'system' END AS kind, count(*) AS n_records FROM numbered GROUP BY ALL""")
def rollout_turn_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("ts").alias("line_no"), F.expr(_CLASS).alias("class"))
    return T.group_rollout(e).groupBy("conv_id", "turn_index", "kind").agg(F.count("*").alias("n_records"))


_SQL_CHAT = f"""WITH rec AS (SELECT conv_id, turn, role = 'user' AS is_user, text FROM conversations WHERE role <> 'system'),
    marks AS (SELECT *, CASE WHEN is_user OR coalesce(lag(is_user) OVER (PARTITION BY conv_id ORDER BY turn), true) THEN 1 ELSE 0 END AS new FROM rec),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM marks),
    turns AS (SELECT conv_id, CAST(turn_index AS BIGINT) AS turn_index, CASE WHEN is_user THEN 'user' ELSE 'system' END AS kind, string_agg(text, chr(10) ORDER BY turn) AS text FROM numbered GROUP BY ALL),
    tok AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM turns),
    tiered AS (SELECT *, CASE WHEN kind = 'user' THEN 'user' WHEN tokens > {CHAT_THRESHOLD} THEN 'long' ELSE 'short' END AS tier FROM tok)"""


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = T.joined(T.group_blocks(T.from_flat(read(spark, sf_dir, "conversations")))).drop("lines")
    return X.tiers(turns.withColumn("tokens", X.token_count(F.col("text"))), CHAT_THRESHOLD)


@query(_SQL_CHAT + " SELECT conv_id, turn_index, tokens, tier FROM tiered")
def token_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_turns(spark, sf_dir).select("conv_id", "turn_index", "tokens", "tier")


@query(_SQL_CHAT + f""" SELECT conv_id, count(*) AS n_turns, CAST(sum(tokens) AS BIGINT) AS total_tokens,
    CASE WHEN sum(tokens) <= {CHAT_BUDGET} THEN 'within_budget' WHEN count(*) FILTER (tier = 'long') = 0 THEN 'nothing_to_score' ELSE 'compacted' END AS status FROM tiered GROUP BY conv_id""")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.status(chat_turns(spark, sf_dir), CHAT_BUDGET)


@query(_SQL_CHAT + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) AS n FROM tiered WHERE kind = 'user')
    SELECT conv_id, right(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn_index), 4000) AS query FROM ranked WHERE n <= 3 GROUP BY conv_id""")
def recent_user_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recent_query(chat_turns(spark, sf_dir))


_SQL_SPLIT = """, cuts AS (SELECT conv_id, min(turn_index) FILTER (kind = 'user' AND turn_index >= floor(n * 0.7)) AS cut FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM turns) GROUP BY conv_id),
    parts AS (SELECT t.*, CASE WHEN turn_index < cut THEN 'prefix' ELSE 'suffix' END AS part FROM turns t JOIN cuts USING (conv_id) WHERE cut > 0)"""


@query(_SQL_TURNS + _SQL_SPLIT + " SELECT conv_id, part, count(*) AS n_turns, CAST(sum(tokens) AS BIGINT) AS tokens FROM parts GROUP BY ALL")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.holdout(transcript(spark, sf_dir)).groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.sum("tokens").alias("tokens"))


@query("""SELECT user_id, CASE WHEN TRY_CAST(w AS BIGINT) > 0 THEN TRY_CAST(w AS BIGINT) WHEN t IS NOT NULL THEN greatest(CAST(floor(t * 0.4) AS BIGINT), 40000) ELSE 160000 END AS budget
    FROM (SELECT user_id, CASE min(event_id) % 3 WHEN 0 THEN '1234' WHEN 1 THEN 'x' ELSE '-5' END AS w, CASE WHEN min(event_id) % 2 = 0 THEN CAST(sum(event_id) AS BIGINT) END AS t FROM events GROUP BY user_id)""")
def derived_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.min("event_id")
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.when(least % 3 == 0, "1234").when(least % 3 == 1, "x").otherwise("-5").alias("w"), F.when(least % 2 == 0, F.sum("event_id")).alias("t")
    )
    return e.select("user_id", X.derived_budget(F.col("w"), F.col("t")).alias("budget"))


# --- entities ---------------------------------------------------------------------------------------------------------


def _entity_query(etype: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = E.explode_entities(transcript(spark, sf_dir), ["conv_id", "turn_index"]).where(F.col("etype") == etype)
        return rows.select("conv_id", "turn_index", "value")

    run.__name__ = f"entities_{etype}"
    one = f"SELECT DISTINCT conv_id, turn_index, lower(trim(v)) AS value FROM (SELECT conv_id, turn_index, unnest({_SQL_VALUES[etype]}) AS v FROM turns) WHERE length(trim(v)) >= 2"
    query(_SQL_TURNS + " " + one)(run)


for _etype in _SQL_VALUES:
    _entity_query(_etype)


@query(r"""SELECT page_id, rtrim(unnest(regexp_extract_all(url, 'https?://[^\s<>"''`\])]+')), '.,;:)') AS value FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(E.found(F.col("url"))["url"]).alias("value"))


@query(f"""WITH v AS (SELECT doc_id, unnest({_SQL_VALUES['env_var']}) AS v FROM documents) SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM v""")
def document_env_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(E.found(F.col("text"))["env_var"]).alias("v")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(_SQL_TURNS + _SQL_TF + " SELECT conv_id, etype, count(DISTINCT value) AS n_entities FROM tf GROUP BY ALL")
def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.explode_entities(transcript(spark, sf_dir), ["conv_id"]).distinct().groupBy("conv_id", "etype").agg(F.count("*").alias("n_entities"))


# --- scorers and selection --------------------------------------------------------------------------------------------


@query(_SQL_TURNS + _SQL_TF + " SELECT DISTINCT conv_id, etype, value, tf, round(itf, 6) AS itf FROM tf")
def turn_frequency_itf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.turn_frequency(transcript(spark, sf_dir)).select("conv_id", "etype", "value", "tf", F.round("itf", 6).alias("itf")).distinct()


@query(_SQL_EITF + " SELECT conv_id, turn_index, round(score, 6) AS score, tokens FROM scores")
def eitf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.eitf(transcript(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_SQL_TURNS + _SQL_TF + _sql_scores(_SQL_SETCOVER) + " SELECT conv_id, turn_index, round(score, 6) AS score, tokens FROM scores")
def setcover_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.setcover(transcript(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH w AS (SELECT doc_id, source, p, substr(text, CAST(p AS BIGINT) + 1, 64) AS g FROM (SELECT doc_id, source, text, unnest(range(0, length(text) - 63)) AS p FROM documents WHERE length(text) >= 64)),
    again AS (SELECT * FROM (SELECT doc_id, source, p, count(*) OVER (PARTITION BY source, hash(g), g) AS n FROM w) WHERE n > 1),
    cover AS (SELECT doc_id, sum(least(64, coalesce(p - lag_p, 64))) AS dup FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS lag_p FROM again) GROUP BY doc_id)
    SELECT d.doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(dup, 0) AS BIGINT) AS n_duplicated FROM documents d LEFT JOIN cover USING (doc_id)""")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("turn_index"), "text")
    return S.duplicate_share(d).select(F.col("turn_index").alias("doc_id"), "n_chars", "n_duplicated")


@query("""SELECT a.vec_id, round((list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2, 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10""")
def embed_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("ask"))
    return e.join(b, F.col("vec_id") - F.col("vec_id") % 10 == F.col("_id")).select("vec_id", F.round(S.cosine("embedding", "ask"), 6).alias("score"))


@query(_SQL_SELECTION + " SELECT conv_id, turn_index, tier, tokens, kept, reason FROM selection")
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("conv_id", "turn_index", "tier", "tokens", "kept", "reason")


@query(_SQL_SELECTION + """ SELECT conv_id, count(*) AS n_turns, count(*) FILTER (kept) AS kept_turns, CAST(sum(tokens) AS BIGINT) AS total_tokens,
    CAST(coalesce(sum(tokens) FILTER (tier = 'user'), 0) AS BIGINT) AS user_tokens, CAST(coalesce(sum(tokens) FILTER (tier = 'short'), 0) AS BIGINT) AS short_tokens,
    CAST(coalesce(sum(tokens) FILTER (kept), 0) AS BIGINT) AS kept_tokens, CAST(coalesce(sum(tokens) FILTER (kept AND NOT (reason = 'last' AND tier = 'long')), 0) AS BIGINT) AS reported_kept_tokens,
    round(coalesce(sum(tokens) FILTER (kept), 0) / sum(tokens), 6) AS compression FROM selection GROUP BY conv_id""")
def selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stats(_selected(spark, sf_dir)).withColumn("compression", F.round("compression", 6))


@query(_SQL_SELECTION + """ SELECT conv_id, md5(string_agg('[' || CASE WHEN kind = 'user' THEN 'User' ELSE 'Assistant' END || ' (turn ' || turn_index || ')]:' || chr(10)
    || CASE WHEN length(trim(text, chr(10) || ' ')) > 4000 THEN left(trim(text, chr(10) || ' '), 4000) || chr(10) || '[... truncated]' ELSE trim(text, chr(10) || ' ') END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn_index)) AS digest
    FROM selection WHERE kept GROUP BY conv_id""")
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summary(_selected(spark, sf_dir).where("kept")).select("conv_id", F.md5("summary").alias("digest"))


@query(_SQL_SELECTION + " SELECT conv_id, turn_index, round(score, 4) AS score, tokens, kept, replace(left(text, 120), chr(10), ' ') AS preview FROM selection WHERE score IS NOT NULL")
def scores_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.score_rows(_selected(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


@query(_SQL_SELECTION + """, d AS (
    SELECT conv_id, kept, turn_index, row_number() OVER (PARTITION BY conv_id, kept ORDER BY round(score, 9) DESC, turn_index) AS rank FROM selection WHERE score IS NOT NULL)
    SELECT conv_id, kept, CAST(rank AS INTEGER) AS rank, turn_index FROM d WHERE kept OR rank <= 20""")
def score_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _selected(spark, sf_dir).withColumn("score", F.round("score", 9))
    return K.score_detail(rows).select("conv_id", "kept", "rank", "turn_index")


# --- evaluation -------------------------------------------------------------------------------------------------------

def _sql_eval(factor: str) -> str:
    """What a method whose factor is given covers."""
    return (
        (_SQL_TURNS.replace("), turns AS (", "), all_turns AS (") + _SQL_SPLIT.replace("FROM turns)", "FROM all_turns)").replace("FROM turns t", "FROM all_turns t")
         + ", turns AS (SELECT * EXCLUDE (part) FROM parts WHERE part = 'prefix')" + _SQL_TF + _sql_scores(factor) + _SQL_SELECT).replace("WITH ", "WITH RECURSIVE ", 1)
        + ", needed_text AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn_index) AS text FROM parts WHERE part = 'suffix' AND kind = 'system' GROUP BY conv_id)"
        + ", held_text AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn_index) AS text FROM selection WHERE kept GROUP BY conv_id)"
        + f", needed AS ({_sql_entities('needed_text', 'conv_id')}), held AS ({_sql_entities('held_text', 'conv_id')})"
        + ", hits AS (SELECT n.*, h.conv_id IS NOT NULL AS hit FROM needed n LEFT JOIN held h USING (conv_id, etype, value))"
        + f", types AS (SELECT conv_id, etype, count(*) FILTER (hit) AS covered, count(*) AS total, {_SQL_WEIGHT} AS weight FROM hits GROUP BY conv_id, etype)"
        + """, sums AS (SELECT conv_id, sum(tokens) AS total_tokens, sum(tokens) FILTER (kept) AS kept_tokens FROM selection GROUP BY conv_id),
        cov AS (SELECT s.conv_id, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(kept_tokens AS BIGINT) AS kept_tokens, CAST(coalesce(sum(covered), 0) AS BIGINT) AS covered_count,
            CAST(coalesce(sum(total), 0) AS BIGINT) AS suffix_entity_count, coalesce(sum(covered) / sum(total), 1) AS coverage, coalesce(sum(weight * covered) / sum(weight * total), 1) AS weighted_coverage,
            kept_tokens / total_tokens AS compression FROM sums s LEFT JOIN types USING (conv_id) GROUP BY s.conv_id, total_tokens, kept_tokens),
        final AS (SELECT *, CASE WHEN weighted_coverage + 1 - compression > 0 THEN 2 * weighted_coverage * (1 - compression) / (weighted_coverage + 1 - compression) ELSE 0 END AS f1 FROM cov)"""
    )


_SQL_EVAL = _sql_eval("1.0")


def _prefix_selection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = X.holdout(transcript(spark, sf_dir))
    prefix = parts.where("part = 'prefix'").drop("part")
    return select_turns(prefix, S.eitf(prefix), BUDGET), parts.where("part = 'suffix'")


@query(_SQL_EVAL + " SELECT conv_id, etype, covered, total, round(covered / total, 6) AS coverage, CAST(weight AS DOUBLE) AS weight FROM types")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, suffix = _prefix_selection(spark, sf_dir)
    return C.type_breakdown(C.covered(suffix, selected.where("kept"))).withColumn("coverage", F.round("coverage", 6))


_MEASURES = ("coverage", "weighted_coverage", "compression", "f1")


@query(_SQL_EVAL + " SELECT 'eitf' AS method, conv_id, total_tokens, kept_tokens, covered_count, suffix_entity_count, round(coverage, 6) AS coverage, round(weighted_coverage, 6) AS weighted_coverage, round(compression, 6) AS compression, round(f1, 6) AS f1 FROM final")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir, "eitf")


def _coverage(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir, method).entities()
    return rows.select("method", "conv_id", "total_tokens", "kept_tokens", "covered_count", "suffix_entity_count", *[F.round(m, 6).alias(m) for m in _MEASURES])


def _evaluated(spark: SparkSession, sf_dir: str, *methods: str) -> Evaluation:
    return evaluate(transcript(spark, sf_dir), list(methods), new_path(spark, "evaluation"), budget=BUDGET, threshold=THRESHOLD)


@query(_sql_eval(_SQL_SETCOVER) + " SELECT 'setcover' AS method, conv_id, total_tokens, kept_tokens, covered_count, suffix_entity_count, round(coverage, 6) AS coverage, round(weighted_coverage, 6) AS weighted_coverage, round(compression, 6) AS compression, round(f1, 6) AS f1 FROM final")
def entity_coverage_setcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir, "setcover")


@query(_SQL_EVAL + " SELECT unnest(['coverage', 'weighted_coverage', 'compression', 'f1']) AS metric, round(unnest([avg(coverage), avg(weighted_coverage), avg(compression), avg(f1)]), 6) AS eitf FROM final")
def method_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir, "eitf").entities()
    return C.report(rows, list(_MEASURES), ["eitf"]).withColumn("eitf", F.round("eitf", 6))


@query(_SQL_EVAL + """, m AS (SELECT 0 AS b, CAST(weight AS DOUBLE) AS weight, etype AS metric, avg(covered / total) AS eitf FROM types GROUP BY etype, weight
    UNION ALL SELECT 1, 0, unnest(['coverage', 'weighted_coverage', 'compression', 'f1', 'suffix_entity_count', 'covered_count', 'kept_tokens', 'total_tokens']),
        unnest([avg(coverage), avg(weighted_coverage), avg(compression), avg(f1), avg(suffix_entity_count), avg(covered_count), avg(kept_tokens), avg(total_tokens)]) FROM final)
    SELECT weight, metric, round(eitf, 5) AS eitf FROM m""")
def method_report_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "eitf").report().where("metric <> 'speed_s'").withColumn("eitf", F.round("eitf", 5))


_PROBES = """SELECT conv_id, turn AS probe_ord, CASE turn % 5 WHEN 0 THEN 'error_solution' WHEN 1 THEN 'instruction' WHEN 2 THEN 'progress' WHEN 3 THEN 'environment' ELSE 'other' END AS dimension,
    CASE turn % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'odd' END AS difficulty, CASE WHEN turn = 7 THEN {none} ELSE {some} END AS evidence_turns FROM conversations"""
_KEPT = "SELECT conv_id, {agg} AS kept_turns FROM conversations WHERE (turn + conv_id) % 3 <> 0 GROUP BY conv_id"
_SQL_PROBES = f"""WITH probes AS ({_PROBES.format(none='CAST([] AS BIGINT[])', some='[turn, turn + 1, turn + 1]')}), kept AS ({_KEPT.format(agg='list(turn)')}),
    cov AS (SELECT p.*, len(list_filter(evidence_turns, lambda x: list_contains(kept_turns, x))) / len(evidence_turns) AS coverage,
        list_filter(evidence_turns, lambda x: NOT list_contains(kept_turns, x)) AS lost FROM probes p JOIN kept USING (conv_id) WHERE len(evidence_turns) > 0)"""
_SQL_DIMS = "dims AS (SELECT unnest(['error_solution', 'instruction', 'progress', 'environment', 'noise']) AS dimension, unnest([0.30, 0.25, 0.25, 0.15, 0.05]) AS weight, unnest([1, 2, 3, 4, 5]) AS nth)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    sql = _PROBES.format(none="CAST(array() AS array<bigint>)", some="array(turn, turn + 1, turn + 1)").replace("FROM conversations", "FROM {t}")
    kept = spark.sql(_KEPT.format(agg="collect_list(turn)").replace("FROM conversations", "FROM {t}"), t=conversations)
    return V.probe_coverage(spark.sql(sql, t=conversations), kept)


@query(_SQL_PROBES + " SELECT conv_id, probe_ord, dimension, round(coverage, 6) AS coverage, array_to_string(lost, ',') AS dropped_evidence FROM cov")
def probe_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select("conv_id", "probe_ord", "dimension", F.round("coverage", 6).alias("coverage"), F.array_join(F.col("dropped_evidence").cast("array<string>"), ",").alias("dropped_evidence"))


@query(_SQL_PROBES + f", {_SQL_DIMS} SELECT c.conv_id, d.dimension, round(coalesce(avg(v.coverage), 0), 6) AS mean, count(v.coverage) AS n FROM (SELECT DISTINCT conv_id FROM cov) c CROSS JOIN dims d LEFT JOIN cov v ON v.conv_id = c.conv_id AND v.dimension = d.dimension GROUP BY ALL")
def dimension_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dimension_means(_probes(spark, sf_dir), ["conv_id"]).select("conv_id", "dimension", F.round("mean", 6).alias("mean"), "n")


@query(_SQL_PROBES + f", {_SQL_DIMS}, m AS (SELECT conv_id, dimension, avg(coverage) AS mean FROM cov GROUP BY ALL) SELECT conv_id, round(coalesce(sum(weight * mean), 0), 6) AS composite FROM m LEFT JOIN dims USING (dimension) GROUP BY conv_id")
def dimension_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.composite(V.dimension_means(_probes(spark, sf_dir), ["conv_id"]), ["conv_id"]).withColumn("composite", F.round("composite", 6))


_SQL_NDCG = "CASE difficulty WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 1 END"


@query(_SQL_PROBES + f", {_SQL_DIMS}, r AS (SELECT c.*, {_SQL_NDCG} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY {_SQL_NDCG} DESC, coalesce(nth, 0), probe_ord) AS i FROM cov c LEFT JOIN dims USING (dimension)) SELECT conv_id, round(sum(w / log2(i + 1) * coverage) / sum(w / log2(i + 1)), 6) AS ndcg FROM r GROUP BY conv_id")
def probe_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ndcg(_probes(spark, sf_dir), ["conv_id"]).withColumn("ndcg", F.round("ndcg", 6))


@query(_SQL_PROBES + " SELECT conv_id, probe_ord, round(coverage, 6) AS coverage FROM cov WHERE coverage < 1")
def dropped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dropped(_probes(spark, sf_dir)).select("conv_id", "probe_ord", F.round("coverage", 6).alias("coverage"))


_ANSWERS = """SELECT conv_id, turn AS probe_ord, CASE WHEN turn % 2 = 0 THEN 'capable' ELSE 'cheap' END AS model_key, CASE WHEN turn % 2 = 0 THEN 'large' ELSE 'small' END AS model_label,
    CAST((conv_id + turn) % 6 - 1 AS INT) AS score, conv_id * 100 + turn AS ord, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'eitf' ELSE 'dedup' END AS method FROM conversations"""
_SQL_JUDGED = _SQL_PROBES + f""", {_SQL_DIMS}, answers AS ({_ANSWERS}), j AS (SELECT a.*, p.dimension, p.difficulty, least(3, greatest(0, a.score)) AS s FROM answers a JOIN probes p USING (conv_id, probe_ord)),
    comp AS (SELECT method, model_key, sum(weight * mean) AS composite FROM (SELECT method, model_key, dimension, avg(s / 3) AS mean FROM j GROUP BY ALL) JOIN dims USING (dimension) GROUP BY ALL),
    r AS (SELECT j.*, {_SQL_NDCG} AS w, row_number() OVER (PARTITION BY method, model_key, conv_id ORDER BY {_SQL_NDCG} DESC, coalesce(nth, 0), probe_ord) AS i FROM j LEFT JOIN dims USING (dimension)),
    gains AS (SELECT method, model_key, avg(g) AS ndcg FROM (SELECT method, model_key, conv_id, sum(w / log2(i + 1) * s) / sum(w / log2(i + 1) * 3) AS g FROM r GROUP BY ALL) GROUP BY ALL),
    agg AS (SELECT method, model_key, arg_min(model_label, ord) AS model_label, count(*) AS n_answers FROM j GROUP BY ALL)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    probes = spark.sql(_PROBES.format(none="CAST(array() AS array<bigint>)", some="array(turn, turn + 1, turn + 1)").replace("FROM conversations", "FROM {t}"), t=conversations)
    return V.judged(spark.sql(_ANSWERS.replace("FROM conversations", "FROM {t}"), t=conversations), probes)


@query(_SQL_JUDGED + " SELECT method, model_key, model_label, n_answers, round(composite, 6) AS composite, round(ndcg, 6) AS ndcg FROM agg JOIN comp USING (method, model_key) JOIN gains USING (method, model_key)")
def judge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.judge_aggregate(_judged(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("composite", "ndcg")})


@query(_SQL_JUDGED + ", g AS (SELECT method, max(composite) FILTER (model_key = 'capable') - max(composite) FILTER (model_key = 'cheap') AS gap FROM comp GROUP BY method) SELECT method, round(gap, 6) AS gap, CASE WHEN gap > 0.1 THEN 'context lacks detail' WHEN gap < 0.02 THEN 'similar' ELSE 'moderate' END AS insight FROM g")
def model_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.model_gap(V.judge_aggregate(_judged(spark, sf_dir))).withColumn("gap", F.round("gap", 6))


_SQL_SHOWN = """WITH e AS (SELECT conv_id, turn, '--- Turn ' || turn || ' (' || role || ') ---' || chr(10) || coalesce(text, '') || chr(10) AS entry FROM conversations),
    s AS (SELECT *, sum(length(entry)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM e)"""


@query(_SQL_SHOWN + " SELECT conv_id, turn AS turn_index FROM s WHERE s <= 1500")
def prompt_prefix_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prompt_prefix(_as_turns(spark, sf_dir), 1500).select("conv_id", "turn_index")


def _as_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("turn_index"), F.col("role").alias("kind"), "text")


@query(_SQL_SHOWN + """ SELECT conv_id, coalesce(string_agg(entry, chr(10) ORDER BY turn) FILTER (s <= 1500), '') || CASE WHEN count(*) > count_if(s <= 1500)
    THEN CASE WHEN count_if(s <= 1500) > 0 THEN chr(10) ELSE '' END || chr(10) || '[...truncated at 1500 chars, ' || (count(*) - count_if(s <= 1500)) || ' turns shown...]' ELSE '' END AS transcript FROM s GROUP BY conv_id""")
def probe_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transcript(_as_turns(spark, sf_dir), 1500)


_SQL_TERMS = r"""SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, lower(unnest(list_concat(regexp_extract_all(text, '(?:[./~])?(?:/[\w.\-]+){{2,}}'), regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_./\-]{{3,}}')))) AS term FROM {source}) GROUP BY ALL"""
_SQL_REL = (_SQL_CHAT + _SQL_SPLIT + f""", sys AS (SELECT * FROM parts WHERE part = 'prefix' AND kind = 'system'), own AS ({_SQL_TERMS.format(keys='conv_id, turn_index', source='sys')}),
    later AS ({_SQL_TERMS.format(keys='conv_id', source="(SELECT * FROM parts WHERE part = 'suffix')")}), df AS (SELECT conv_id, term, count(*) AS df FROM own GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM sys GROUP BY conv_id),
    s AS (SELECT o.conv_id, o.turn_index, sum(o.tf * ln(1 + n / df) * l.tf) AS r FROM own o JOIN later l USING (conv_id, term) JOIN df USING (conv_id, term) JOIN n USING (conv_id) GROUP BY ALL),
    rel AS (SELECT y.conv_id, y.turn_index, coalesce(r, 0) AS relevance FROM sys y LEFT JOIN s USING (conv_id, turn_index))""")


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.holdout(chat_turns(spark, sf_dir))
    return I.relevance(parts.where("part = 'prefix'"), parts.where("part = 'suffix'"))


@query(_SQL_REL + " SELECT conv_id, turn_index, round(relevance, 5) AS relevance FROM rel")
def tfidf_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).withColumn("relevance", F.round("relevance", 5))


@query(_SQL_REL + """, t AS (SELECT conv_id, sum(ceil(length(text) / 4.0)) AS total_tokens, coalesce(sum(ceil(length(text) / 4.0)) FILTER (turn_index % 4 = 1), 0) AS kept_tokens FROM parts WHERE part = 'prefix' GROUP BY conv_id),
    c AS (SELECT conv_id, CASE WHEN sum(relevance) > 0 THEN coalesce(sum(relevance) FILTER (turn_index % 4 = 1), 0) / sum(relevance) ELSE 1 END AS recall FROM rel GROUP BY conv_id)
    SELECT conv_id, round(recall, 6) AS recall, round(CASE WHEN recall + 1 - kept_tokens / total_tokens > 0 THEN 2 * recall * (1 - kept_tokens / total_tokens) / (recall + 1 - kept_tokens / total_tokens) ELSE 0 END, 6) AS f1,
    CAST(kept_tokens AS BIGINT) AS kept_tokens, CAST(total_tokens AS BIGINT) AS total_tokens FROM c JOIN t USING (conv_id)""")
def fitness_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = X.holdout(chat_turns(spark, sf_dir)).where("part = 'prefix'")
    selected = prefix.withColumns({"kept": F.col("turn_index") % 4 == 1, "score": F.lit(None).cast("double")})
    rows = I.evaluated(_relevance(spark, sf_dir), selected)
    return rows.select("conv_id", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "kept_tokens", "total_tokens")


@query(_SQL_REL + " SELECT conv_id, round(CASE WHEN sum(relevance) > 0 THEN coalesce(sum(relevance) FILTER (turn_index % 4 = 1), 0) / sum(relevance) ELSE 1 END, 6) AS recall FROM rel GROUP BY conv_id")
def fitness_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _relevance(spark, sf_dir)
    kept = rel.select("conv_id", "turn_index", (F.col("turn_index") % 4 == 1).alias("kept"))
    return I.recall(rel, kept).withColumn("recall", F.round("recall", 6))


# --- results, discovery, streaming ------------------------------------------------------------------------------------


@query("SELECT event_type, user_id % 7 AS k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY event_id) AS n FROM events) WHERE n = 1")
def result_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("k"), "event_id")
    return R.first_of(e, ["event_type", "k"], "event_id")


@query("SELECT event_type, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY user_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pareto(read(spark, sf_dir, "events"), "user_id", "value", "event_id", ["event_type"]).select("event_type", "event_id", "value")


_RESULTS = """SELECT event_type AS method, CASE WHEN event_id % 2 = 0 THEN 2000 ELSE 20000 END AS budget, CASE WHEN event_id % 5 < 3 THEN 'capable' ELSE 'cheap' END AS model_key, 'm' AS model_label,
    value / 100 AS composite, value / 200 AS recall, value AS speed_s, event_id AS kept_tokens, 2 * event_id AS total_tokens, event_id AS ord, event_id % 3 AS source FROM events"""


@query(f"""WITH r AS ({_RESULTS}), s AS (SELECT method, arg_max(speed_s, ord) AS v FROM r WHERE source = 2 AND budget = 2000 AND method <> 'view' GROUP BY 1)
    SELECT method, budget, model_key, model_label, composite, CAST(NULL AS DOUBLE) AS recall, speed_s, kept_tokens, total_tokens FROM r WHERE source = 0 AND method <> 'error'
    UNION ALL SELECT method, budget, model_key, model_label, composite, NULL, coalesce(v, 1.2), 7144, 81696 FROM r LEFT JOIN s USING (method) WHERE source = 1
    UNION ALL SELECT method, budget, 'recall_only', 'TF-IDF (no composite)', NULL, recall, speed_s, kept_tokens, total_tokens FROM r WHERE source = 2 AND budget = 20000 AND method <> 'view'""")
def results_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_RESULTS.replace("FROM events", "FROM {t}"), t=read(spark, sf_dir, "events"))
    return R.merge(rows.where("source = 0"), rows.where("source = 1"), rows.where("source = 2 AND method <> 'view'"), "error")


@query(f"""SELECT event_type AS method, CAST(user_id % 3 AS INTEGER) AS budget, etype, count(*) AS n, CASE WHEN {_SQL_WEIGHT} >= 0.8 THEN 'high' WHEN {_SQL_WEIGHT} >= 0.6 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'command' ELSE 'function' END AS etype FROM events) WHERE user_id % 3 = 2 GROUP BY ALL""")
def largest_budget_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    etype = F.when(F.col("event_id") % 3 == 0, "url").when(F.col("event_id") % 3 == 1, "command").otherwise("function")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 3).cast("int").alias("budget"), etype.alias("etype"), F.lit(1.0).alias("coverage"))
    return R.largest_budget(rows).groupBy("method", "budget", "etype", "band").agg(F.count("*").alias("n"))


@query("""SELECT u AS conv_id, method, budget FROM (SELECT DISTINCT user_id AS u FROM events) CROSS JOIN (SELECT unnest(['eitf', 'dedup']) AS method) CROSS JOIN (SELECT unnest([40000, 80000]) AS budget)""")
def method_budget_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid(["eitf", "dedup"], [40000, 80000], read(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id")).distinct())


@query("""WITH o AS (SELECT user_id, ts, CAST(event_id * 7919 % 300 AS BIGINT) AS n_lines, event_type, lag(CAST(event_id * 7919 % 300 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS prev_lines FROM events)
    SELECT user_id AS session, n_lines, prev_lines FROM o WHERE n_lines < prev_lines // 2 AND n_lines > 2 AND (event_type = 'error' OR n_lines < prev_lines // 3)""")
def compaction_event_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("session"), F.col("ts").alias("seq"), (F.col("event_id") * 7919 % 300).cast("long").alias("n_lines"), F.when(F.col("event_type") == "error", "compacted").otherwise("other").alias("last_type"))
    return compaction_events(seen).select("session", "n_lines", "prev_lines")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("path"), F.col("ts").alias("modified"))
    return N.latest(listing, ["user_id"]).withColumnRenamed("path", "event_id")
