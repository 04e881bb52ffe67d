"""Questions and chat logs as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.coerce import first_match, normal_text
from ..functions.edge import ladder
from ..session import write_once
from .scale import first_per_group

# Words of the question vocabulary.
METRIC_SYNONYMS = {"sales": ("sales", "revenue", "earnings"), "profit": ("profit", "margin")}
GROUP_FIELDS = ("productline", "country", "customername", "territory", "dealsize", "month", "quarter", "year")
NUMBER_FILTERS = {
    "year_id": r"(?:year|year_id)\s*(\d{4})",
    "month_id": r"(?:month|month_id)\s*(\d{1,2})",
    "qtr_id": r"(?:qtr|quarter|qtr_id)\s*(\d)",
}
TOP_PATTERN = r"(top|bottom)\s+(\d+)"

# Question families in the order they are tried: intent, confidence, phrases.
SUMMARY_PHRASES = (
    "summary", "summarize", "overview", "insight", "insights", "key insight", "key insights", "complete analysis",
    "analysis summary", "executive summary",
)
GROWTH_PHRASES = (
    "recommend", "recommendation", "recommendations", "suggest", "advice", "focus", "strategy", "strategies", "growth",
    "grow", "increase", "improve", "boost", "optimize", "action plan",
)
DATASET_PHRASES = {
    "missing": ("missing", "null", "na", "n a", "blank"),
    "duplicates": ("duplicate", "duplicates", "repeated"),
    "total": ("total", "sum", "overall"),
    "average": ("average", "avg", "mean"),
    "maximum": ("max", "highest", "top value"),
    "minimum": ("min", "lowest"),
    "rows": ("count", "how many rows", "rows", "records"),
    "columns": ("columns", "schema", "fields"),
}
ROUTES = (
    ("identity_query", 0.7, ("who am i", "what is my name", "whats my name", "my name")),
    ("dataset_ops_query", 0.72, tuple(p for phrases in DATASET_PHRASES.values() for p in phrases)),
    ("analysis_summary_query", 0.76, SUMMARY_PHRASES),
    ("revenue_growth_query", 0.74, GROWTH_PHRASES),
    ("forecast_query", 0.72, ("forecast", "predict", "next", "future")),
    ("revenue_trend_query", 0.73, ("trend", "monthly", "month", "weekly", "week", "daily", "over time", "time series")),
    ("geography_query", 0.72, ("region", "country", "location", "geography", "geographic")),
    ("demographic_query", 0.71, ("age", "gender", "demographic", "demographics")),
)
PLAIN_TOPICS = (
    ("revenue", ("revenue", "sales", "sale", "earn", "total sale", "total sales")),
    ("product", ("product", "category")),
    ("customer", ("customer", "client", "buyer")),
    ("churn", ("churn", "risk", "lose")),
)
FALLBACK = ("fallback_query", 0.6)
CONFIDENT_INTENTS = (
    "analysis_summary_query", "revenue_growth_query", "forecast_query", "revenue_trend_query", "geography_query",
    "geography_proxy_query", "demographic_query", "top_customers_query", "top_customers_proxy_query",
)
TEMPLATES = (
    ("Who are my top customers?", "find_top_customers"),
    ("What's my revenue trend this month?", "revenue_analysis"),
    ("Which customers are at risk?", "churn_analysis"),
    ("Which product category sells most?", "product_analysis"),
    ("What will my sales be next month?", "forecast_query"),
    ("How can I increase revenue?", "strategic_advice"),
)
EMPTY_ANSWERS = ("no chat history available", "no paired q&a entries", "i do not have enough", "please upload")


def extract_entities(df: DataFrame, text: str = "text") -> DataFrame:
    """metric, group_by, top_n, order and number filters found in a question."""
    df = df.withColumn("__t", F.lower(F.col(text)))
    t = F.col("__t")
    metric = F.lit("sales")
    for name, words in reversed(METRIC_SYNONYMS.items()):
        hit = reduce(lambda a, b: a | b, [t.contains(w) for w in words])
        metric = F.when(hit, F.lit(name)).otherwise(metric)
    group = F.lit(None).cast("string")
    for name in reversed(GROUP_FIELDS):
        group = F.when(t.contains(name), F.lit(name)).otherwise(group)
    number = first_match(t, TOP_PATTERN, 2)
    return df.withColumns(
        {
            "metric": metric,
            "group_by": group,
            "top_n": number.try_cast("bigint"),
            "order": F.when(F.regexp_extract(t, TOP_PATTERN, 1) == "bottom", "asc").otherwise("desc"),
            **{name: first_match(t, pattern, 1).try_cast("bigint") for name, pattern in NUMBER_FILTERS.items()},
        }
    ).drop("__t")


def build_specs(df: DataFrame, intent: str = "intent") -> DataFrame:
    """Add a ``spec`` struct with the defaults of the intent."""
    kind = F.col(intent)
    return df.withColumn(
        "spec",
        F.struct(
            kind.alias("intent"),
            F.col("metric"),
            F.lit("sum").alias("aggregation"),
            F.col("group_by"),
            F.col("year_id"),
            F.col("month_id"),
            F.col("qtr_id"),
            F.when(kind == "ranking_query", F.coalesce("top_n", F.lit(5).cast("bigint"))).alias("top_n"),
            F.col("order"),
            (kind == "forecast_query").alias("forecast"),
        ),
    )


def _forms(phrase: str) -> list[str]:
    if " " in phrase:
        return [phrase]
    return [phrase, phrase + "s"] + ([phrase[:-1] + "ies"] if phrase.endswith("y") else [])


def phrase_pattern(phrases) -> str:
    """Whole words or phrases, single words also in the plural."""
    forms = sorted({f for p in phrases for f in _forms(p)})
    return r"\b(" + "|".join(forms) + r")\b"


def _mentions(text: Column, phrases) -> Column:
    return text.rlike(phrase_pattern(phrases))


# What an answer becomes when the table lacks its columns. Of each intent the first variant all of whose columns
# are there is taken; "a|b" asks for one of them.
VARIANTS = {
    "geography_query": (
        (("region|country", "total_amount"), "geography_query", 0.72),
        (("product_category", "total_amount"), "geography_proxy_query", 0.68),
        ((), "geography_query", 0.64),
    ),
    "demographic_query": (
        (("gender", "total_amount"), "demographic_query", 0.71),
        (("age", "total_amount"), "demographic_query", 0.7),
        ((), "demographic_query", 0.64),
    ),
    "top_customers_query": (
        (("customer_id", "total_amount"), "top_customers_query", 0.75),
        (("product_category", "total_amount"), "top_customers_proxy_query", 0.7),
        ((), *FALLBACK),
    ),
}


def variant(answer: tuple[str, float], columns) -> tuple[str, float]:
    """The answer that a table with these columns allows."""
    have = set(columns)
    for needs, intent, sure in VARIANTS.get(answer[0], ()):
        if all(have & set(need.split("|")) for need in needs):
            return intent, sure
    return answer


def route_questions(df: DataFrame, text: str = "text", columns=None) -> DataFrame:
    """(intent, confidence, escalate, confidence_label): first family whose words a question holds.

    With the canonical ``columns`` of the table asked about, families whose columns are missing give their stand-in or a
    weaker answer."""
    q = F.col("__q")
    top_customers = _mentions(q, ("customer", "client", "buyer")) & _mentions(q, ("top", "best"))
    before_customers = _mentions(q, PLAIN_TOPICS[0][1]) | _mentions(q, PLAIN_TOPICS[1][1])
    tests = [(_mentions(q, phrases), (intent, sure)) for intent, sure, phrases in ROUTES]
    tests.append((top_customers & ~before_customers, ("top_customers_query", 0.75)))
    answers = [answer if columns is None else variant(answer, columns) for _, answer in tests] + [FALLBACK]
    place = F.lit(len(tests))
    for i, (test, _) in reversed(list(enumerate(tests))):
        place = F.when(test, F.lit(i)).otherwise(place)
    routed = df.withColumn("__q", normal_text(F.col(text))).withColumn("__route", place)
    chosen = {name: F.array(*[F.lit(a[i]) for a in answers])[F.col("__route")] for i, name in enumerate(("intent", "confidence"))}
    return with_escalation(routed.withColumns(chosen).drop("__q", "__route"))


def with_escalation(df: DataFrame) -> DataFrame:
    """Is the answer too weak for its kind of question?"""
    i, c = F.col("intent"), F.col("confidence")
    weak = (
        F.when(i.isin("identity_query", "dataset_ops_query"), False)
        .when(i.isin(*CONFIDENT_INTENTS), c < 0.62)
        .when(i.isin("fallback_query", "general_query", "unknown", ""), c < 0.66)
        .otherwise(c < 0.55)
    )
    return df.withColumn("escalate", weak).withColumn("confidence_label", ladder(c, [(0.8, "High"), (0.5, "Medium")], "Low"))


def match_templates(df: DataFrame, text: str = "text", above: float = 0.6) -> DataFrame:
    """First known question whose words overlap enough (Jaccard), else NULL. The known questions ride in the plan."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""))
    known = F.array(
        *[
            F.struct(F.lit(question).alias("question"), F.lit(intent).alias("intent"), F.array(*[F.lit(w) for w in sorted(set(question.lower().split()))]).alias("words"))
            for question, intent in TEMPLATES
        ]
    )

    def overlap(entry: Column) -> Column:
        return F.size(F.array_intersect("__w", entry["words"])) / F.size(F.array_union("__w", entry["words"]))

    hit = F.get(F.filter(known, lambda e: overlap(e) > above), 0)
    return (
        df.withColumn("__w", words)
        .withColumn("__hit", hit)
        .withColumns(
            {
                "matched_question": F.col("__hit.question"),
                "matched_intent": F.col("__hit.intent"),
                "similarity": F.when(F.col("__hit").isNotNull(), overlap(F.col("__hit"))),
            }
        )
        .drop("__w", "__hit")
    )


def similar_questions(asked: DataFrame, known: DataFrame, text: str = "text", above: float = 0.6) -> DataFrame:
    """``asked`` with ``matched_question, matched_intent, similarity``: of the ``known`` questions (``question, intent, ord``) whose words overlap by more
    than ``above`` (Jaccard) the first by ``ord``, else NULL.

    Words are ordered by how many known questions hold them, the rarest first; counts are those of hashed slots, so a table of one size tells
    them and no word is joined to be counted. Two sets of that likeness share a word among the first ``size - ceil(above * size) + 1`` of
    each, so known questions are listed under those words only and meet the asked ones there, as numbers with a size and a bitmap of their
    words that bounds what two sets can share. Only pairs that may be alike enough get their words back, and all are compared. Each different text is matched once.
    """

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))

    listed = known.where(F.col("ord").isNotNull()).select("question", "intent", "ord", F.monotonically_increasing_id().alias("__known"))
    listed = write_once(listed)  # what is numbered must not be computed again
    texts = asked.select(F.col(text).alias("__text")).where(F.col("__text").isNotNull()).distinct()
    texts = write_once(texts.withColumn("__asked", F.monotonically_increasing_id()))
    rare = _rarity(listed.select(F.explode(words(F.col("question"))).alias("word")))

    def under_first_words(df: DataFrame, key: str, c: str, side: str) -> DataFrame:
        have = df.select(key, words(F.col(c)).alias("__words"))
        size = F.size("__words")
        ranked = F.array_sort(F.transform("__words", lambda w: F.struct(rare(w).alias("n"), w.alias("word"))))
        taken = F.slice(ranked, F.lit(1), size - F.ceil(F.lit(above) * size).cast("int") + 1)
        return have.select(key, size.cast("double").alias(f"{side}_size"), _bitmap("__words").alias(f"{side}_bits"), F.explode(taken).alias("__first")).select(
            key, f"{side}_size", f"{side}_bits", F.col("__first.word").alias("word")
        )

    met = under_first_words(texts, "__asked", "__text", "a").join(under_first_words(listed, "__known", "question", "k"), "word")
    a, k = F.col("a_size"), F.col("k_size")
    lone = [F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) for x, y in (("a_bits", "k_bits"), ("k_bits", "a_bits"))]
    most = F.least(a - lone[0], k - lone[1])
    pairs = met.where((a >= above * k) & (k >= above * a) & (most / (a + k - most) > above)).select("__asked", "__known").distinct()
    both = pairs.join(texts, "__asked").join(listed, "__known").withColumns({"__a": words(F.col("__text")), "__k": words(F.col("question"))})
    alike = F.size(F.array_intersect("__a", "__k")) / F.size(F.array_union("__a", "__k"))
    scored = both.select("__asked", F.struct("ord", "__known", alike.alias("similarity")).alias("m")).where(F.col("m.similarity") > above)
    best = scored.groupBy("__asked").agg(F.min("m").alias("m")).select("__asked", "m.__known", "m.similarity")
    found = best.join(texts, "__asked").join(listed, "__known").select(
        "__text", F.col("question").alias("matched_question"), F.col("intent").alias("matched_intent"), "similarity"
    )
    return asked.join(found, F.col(text) == F.col("__text"), "left").drop("__text")


#: Slots that words are counted in; their counts come to the driver as one byte each.
WORD_SLOTS = 1 << 16


def _rarity(words: DataFrame):
    """A function that gives the level of a word's count in ``words`` (``word``), rare words first: eight levels for each doubling."""
    def slot(w: Column) -> Column:
        return F.pmod(F.xxhash64(w), F.lit(WORD_SLOTS)).cast("int")

    level = F.least(F.lit(255), F.floor(F.log2(F.count(F.lit(1)).cast("double")) * 8) + 1).cast("int")
    levels = bytearray(WORD_SLOTS)
    for row in words.groupBy(slot(F.col("word")).alias("slot")).agg(level.alias("level")).collect():
        levels[row["slot"]] = row["level"]
    return lambda w: F.substr(F.lit(levels), slot(w) + 1, F.lit(1))


def _bitmap(words: str) -> Column:
    """64 bits, of which each word sets one."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return F.aggregate(words, none, lambda bits, w: bits.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(w, F.lit(1)), F.lit(64)).cast("int"))))


def history_tail(log: DataFrame, n: int = 50) -> DataFrame:
    """The last turns of every conversation; long ones are cut before the shuffle."""
    return first_per_group(log, ["conv_id"], [F.col("turn").desc()], n, "from_end").drop("from_end")


def qa_pairs(log: DataFrame, last: int = 20, first: int = 5, min_length: int = 20) -> DataFrame:
    """User turn and the assistant turn that answers it, from the tail of each conversation."""
    tail = history_tail(log, last).where(F.col("role").isin("user", "assistant"))
    order = W.partitionBy("conv_id").orderBy("turn")
    message = F.btrim("text", F.lit(" \t\r\n"))
    paired = tail.select(
        "conv_id", "turn", "role", message.alias("answer"),
        F.lag("role").over(order).alias("__role"), F.lag(message).over(order).alias("question"),
    ).where((F.col("role") == "assistant") & (F.col("__role") == "user") & (F.col("question") != ""))
    empty = reduce(lambda a, b: a | b, [F.lower("answer").contains(t) for t in EMPTY_ANSWERS])
    useful = paired.where((F.length("answer") >= min_length) & ~empty)
    unique = useful.groupBy("conv_id", F.lower("question").alias("__q"), F.lower("answer").alias("__a")).agg(
        F.min("turn").alias("turn"), F.min_by("question", "turn").alias("question"), F.min_by("answer", "turn").alias("answer")
    )
    return first_per_group(unique, ["conv_id"], [F.col("turn")], first, "position").select(
        "conv_id", F.col("position").cast("bigint").alias("position"), "turn", "question", "answer"
    )
