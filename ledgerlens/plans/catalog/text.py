"""Questions derived from the orders, and the conversation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import text
from ..facts import table
from .registry import R, query, tidy

FIELDS = ("productline", "country", "customername", "territory", "dealsize")
METRICS = ("revenue", "profit", "sales", "earnings")
SIZE = 7

QUESTIONS_SQL = """asked AS (SELECT o_orderkey AS id, CASE o_orderkey % 7
    WHEN 0 THEN 'Show top ' || day(o_orderdate) || ' ' || f || ' by ' || m || ' in year ' || year(o_orderdate)
    WHEN 1 THEN 'Predict next month ' || m || ' for ' || f
    WHEN 2 THEN 'Compare ' || m || ' of quarter ' || quarter(o_orderdate) || ' and month ' || month(o_orderdate)
    WHEN 3 THEN 'Bottom ' || month(o_orderdate) || ' customers by total spend'
    WHEN 4 THEN 'Which customers are at risk? Status ' || o_orderstatus
    WHEN 5 THEN 'What''s my ' || m || ' trend this month?'
    ELSE 'How many duplicate ' || f || ' entries, priority ' || o_orderpriority END AS text
  FROM (SELECT *, ['productline', 'country', 'customername', 'territory', 'dealsize'][o_custkey % 5 + 1] AS f,
    ['revenue', 'profit', 'sales', 'earnings'][o_custkey % 4 + 1] AS m FROM orders))"""


def questions(spark, folder):
    """One question per order, worded from its own values."""
    orders = table(spark, folder, "orders")
    f = F.element_at(F.array(*[F.lit(x) for x in FIELDS]), (F.col("o_custkey") % len(FIELDS) + 1).cast("int"))
    m = F.element_at(F.array(*[F.lit(x) for x in METRICS]), (F.col("o_custkey") % len(METRICS) + 1).cast("int"))
    d, turn = F.col("o_orderdate"), F.col("o_orderkey") % SIZE
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    wording = (
        F.when(turn == 0, say("Show top ", F.dayofmonth(d), " ", f, " by ", m, " in year ", F.year(d)))
        .when(turn == 1, say("Predict next month ", m, " for ", f))
        .when(turn == 2, say("Compare ", m, " of quarter ", F.quarter(d), " and month ", F.month(d)))
        .when(turn == 3, say("Bottom ", F.month(d), " customers by total spend"))
        .when(turn == 4, say("Which customers are at risk? Status ", F.col("o_orderstatus")))
        .when(turn == 5, say("What's my ", m, " trend this month?"))
        .otherwise(say("How many duplicate ", f, " entries, priority ", F.col("o_orderpriority")))
    )
    return orders.select(F.col("o_orderkey").alias("id"), wording.alias("text"))


ENTITY_SQL = r"""entities AS (SELECT id, CASE WHEN t LIKE '%sales%' OR t LIKE '%revenue%' OR t LIKE '%earnings%' THEN 'sales'
    WHEN t LIKE '%profit%' OR t LIKE '%margin%' THEN 'profit' ELSE 'sales' END AS metric,
  CASE WHEN t LIKE '%productline%' THEN 'productline' WHEN t LIKE '%country%' THEN 'country' WHEN t LIKE '%customername%' THEN 'customername'
    WHEN t LIKE '%territory%' THEN 'territory' WHEN t LIKE '%dealsize%' THEN 'dealsize' WHEN t LIKE '%month%' THEN 'month'
    WHEN t LIKE '%quarter%' THEN 'quarter' WHEN t LIKE '%year%' THEN 'year' END AS group_by,
  TRY_CAST(regexp_extract(t, '(top|bottom)\s+(\d+)', 2) AS BIGINT) AS top_n,
  CASE WHEN regexp_extract(t, '(top|bottom)\s+(\d+)', 1) = 'bottom' THEN 'asc' ELSE 'desc' END AS "order",
  TRY_CAST(regexp_extract(t, '(?:year|year_id)\s*(\d{4})', 1) AS BIGINT) AS year_id,
  TRY_CAST(regexp_extract(t, '(?:month|month_id)\s*(\d{1,2})', 1) AS BIGINT) AS month_id,
  TRY_CAST(regexp_extract(t, '(?:qtr|quarter|qtr_id)\s*(\d)', 1) AS BIGINT) AS qtr_id, text
  FROM (SELECT id, text, lower(text) AS t FROM asked))"""


@query(f"WITH {QUESTIONS_SQL}, {ENTITY_SQL} SELECT * FROM entities")
def question_entities(spark, folder):
    return text.extract_entities(questions(spark, folder))


@query(
    f"""WITH {QUESTIONS_SQL}, {ENTITY_SQL} SELECT id, kind AS intent, metric, 'sum' AS aggregation, group_by, year_id, month_id, qtr_id,
    CASE WHEN kind = 'ranking_query' THEN coalesce(top_n, 5) END AS top_n, "order", kind = 'forecast_query' AS forecast
    FROM (SELECT *, CASE WHEN text LIKE 'Predict%' THEN 'forecast_query' WHEN text LIKE 'Compare%' THEN 'comparison_query'
      WHEN text LIKE 'Show top%' OR text LIKE 'Bottom%' OR text LIKE 'Which%' THEN 'ranking_query' ELSE 'sales_query' END AS kind FROM entities)"""
)
def question_specs(spark, folder):
    asked = text.extract_entities(questions(spark, folder)).withColumn("intent", opening_intent(F.col("text")))
    return text.build_specs(asked).select("id", "spec.*")


def opening_intent(question):
    """Intent by the first words; labels the derived questions."""
    return (
        F.when(question.startswith("Predict"), "forecast_query")
        .when(question.startswith("Compare"), "comparison_query")
        .when(question.startswith("Show top") | question.startswith("Bottom") | question.startswith("Which"), "ranking_query")
        .otherwise("sales_query")
    )


def _has(phrases) -> str:
    return f"regexp_matches(q, '{text.phrase_pattern(phrases)}')"


def _route_sql() -> str:
    intents = " ".join(f"WHEN {_has(p)} THEN '{intent}'" for intent, _, p in text.ROUTES)
    sure = " ".join(f"WHEN {_has(p)} THEN {value}" for _, value, p in text.ROUTES)
    top = (
        f"{_has(('customer', 'client', 'buyer'))} AND {_has(('top', 'best'))} "
        f"AND NOT {_has(text.PLAIN_TOPICS[0][1])} AND NOT {_has(text.PLAIN_TOPICS[1][1])}"
    )
    confident = ", ".join(f"'{i}'" for i in text.CONFIDENT_INTENTS)
    return f"""routed AS (SELECT id, text, CASE {intents} WHEN {top} THEN 'top_customers_query' ELSE 'fallback_query' END AS intent,
      CAST(CASE {sure} WHEN {top} THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence FROM normal),
    flagged AS (SELECT *, CASE WHEN intent IN ('identity_query', 'dataset_ops_query') THEN false WHEN intent IN ({confident}) THEN confidence < 0.62
      WHEN intent = 'fallback_query' THEN confidence < 0.66 ELSE confidence < 0.55 END AS escalate,
      CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_label FROM routed)"""


NORMAL_SQL = r"""normal AS (SELECT id, text, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM asked)"""


@query(f"WITH {QUESTIONS_SQL}, {NORMAL_SQL}, {_route_sql()} SELECT * FROM flagged")
def question_routing(spark, folder):
    return text.route_questions(questions(spark, folder))


@query(
    f"""WITH {QUESTIONS_SQL}, {NORMAL_SQL}, {_route_sql()} SELECT id, text,
    CASE intent WHEN 'geography_query' THEN 'geography_proxy_query' WHEN 'top_customers_query' THEN 'top_customers_proxy_query' ELSE intent END AS intent,
    CASE intent WHEN 'geography_query' THEN 0.68 WHEN 'top_customers_query' THEN 0.7 WHEN 'demographic_query' THEN 0.64 ELSE confidence END::DOUBLE AS confidence,
    escalate, confidence_label FROM flagged"""
)
def question_routing_by_columns(spark, folder):
    """Questions about a table that knows neither places nor customers."""
    return text.route_questions(questions(spark, folder), columns=["date", "total_amount", "product_category"])


@query(
    f"""WITH asked AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'), {NORMAL_SQL}, {_route_sql()}
    SELECT intent, escalate, confidence_label, count(*) AS n FROM flagged GROUP BY 1, 2, 3"""
)
def conversation_routing(spark, folder):
    asked = table(spark, folder, "conversations").where(F.col("role") == "user")
    return text.route_questions(asked).groupBy("intent", "escalate", "confidence_label").agg(F.count(F.lit(1)).alias("n"))


def _jaccard_sql() -> str:
    rows = ", ".join("('{}', '{}', {})".format(q.replace("'", "''"), intent, i) for i, (q, intent) in enumerate(text.TEMPLATES))
    return f"""known AS (SELECT question, intent, ord, list_distinct(string_split(lower(question), ' ')) AS kw FROM (VALUES {rows}) v(question, intent, ord)),
    worded AS (SELECT id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM asked),
    scored AS (SELECT id, question, intent, ord, len(list_intersect(w, kw)) / len(list_distinct(list_concat(w, kw))) AS j FROM worded, known),
    best AS (SELECT id, arg_min(question, ord) AS question, arg_min(intent, ord) AS intent, arg_min(j, ord) AS j FROM scored WHERE j > 0.6 GROUP BY 1)"""


@query(
    f"""WITH {QUESTIONS_SQL}, {_jaccard_sql()} SELECT a.id, a.text, b.question AS matched_question, b.intent AS matched_intent, {R('b.j', 4)} AS similarity
    FROM asked a LEFT JOIN best b ON a.id = b.id"""
)
def jaccard_match(spark, folder):
    return tidy(text.match_templates(questions(spark, folder)), 4)


WORDS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"


@query(
    f"""WITH lines AS (SELECT * FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS question, lang
      FROM documents) WHERE length(question) BETWEEN 20 AND 120),
    known AS (SELECT question, min(lang) AS intent, min(doc_id * 100000 + k) AS ord, {WORDS_SQL.format('question')} AS kw FROM lines GROUP BY question),
    turns AS (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM conversations),
    copies AS (SELECT -1 - doc_id AS conv_id, k AS turn, CAST(0 AS BIGINT) AS line, question || ' Again' AS text FROM lines),
    asked AS (SELECT *, {WORDS_SQL.format('text')} AS w FROM (SELECT * FROM turns UNION ALL SELECT * FROM copies)),
    texts AS (SELECT DISTINCT text, w FROM asked),
    scored AS (SELECT t.text, question, intent, ord, len(list_intersect(w, kw)) / len(list_distinct(list_concat(w, kw))) AS j FROM texts t
      JOIN known ON len(w) >= 0.6 * len(kw) AND len(kw) >= 0.6 * len(w) AND list_has_any(w, kw)),
    best AS (SELECT text, arg_min(question, ord) AS q, arg_min(intent, ord) AS i, arg_min(j, ord) AS j FROM scored WHERE j > 0.6 GROUP BY text)
    SELECT conv_id, turn, line, q AS matched_question, i AS matched_intent, {R('j', 4)} AS similarity FROM asked a LEFT JOIN best b ON a.text = b.text"""
)
def question_join(spark, folder):
    """Lines of conversations, and lines of documents with a word more, against all lines of documents that are as long as a question."""
    cut = F.posexplode(F.split("text", "\n"))
    lines = table(spark, folder, "documents").select("doc_id", "lang", cut.alias("k", "question")).where(F.char_length("question").between(20, 120))
    known = lines.groupBy("question").agg(F.min("lang").alias("intent"), F.min(F.col("doc_id") * 100000 + F.col("k")).alias("ord"))
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), cut.alias("line", "text"))
    copies = lines.select((-1 - F.col("doc_id")).alias("conv_id"), F.col("k").cast("long").alias("turn"), F.lit(0).alias("line"), F.concat("question", F.lit(" Again")).alias("text"))
    asked = turns.unionByName(copies).withColumn("line", F.col("line").cast("long"))
    return tidy(text.similar_questions(asked, known), 4).drop("text")


@query(
    """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 50"""
)
def history_tail(spark, folder):
    return text.history_tail(table(spark, folder, "conversations"))


@query(
    r"""WITH tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 20),
    talk AS (SELECT conv_id, turn, role, trim(text, E' \t\r\n') AS answer FROM tail WHERE role IN ('user', 'assistant')),
    paired AS (SELECT *, lag(role) OVER w AS before, lag(answer) OVER w AS question FROM talk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    useful AS (SELECT * FROM paired WHERE role = 'assistant' AND before = 'user' AND question <> '' AND length(answer) >= 20
      AND NOT (lower(answer) LIKE '%no chat history available%' OR lower(answer) LIKE '%no paired q&a entries%'
        OR lower(answer) LIKE '%i do not have enough%' OR lower(answer) LIKE '%please upload%')),
    uniq AS (SELECT conv_id, min(turn) AS turn, arg_min(question, turn) AS question, arg_min(answer, turn) AS answer FROM useful
      GROUP BY conv_id, lower(question), lower(answer))
    SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn, question, answer FROM uniq) WHERE position <= 5"""
)
def qa_pairs(spark, folder):
    return text.qa_pairs(table(spark, folder, "conversations"))
