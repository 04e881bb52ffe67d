"""Questions, chat logs, streaming and nested results."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import text
from ledgerlens.plans.facts import table
from ledgerlens.sources import sinks
from ledgerlens.streaming import live


def _ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "id int, text string")


def test_entities(spark):
    rows = text.extract_entities(
        _ask(spark, "Show top 10 customername by margin", "Bottom 3 territory sales in year 2004", "revenue in month 11 of quarter 2", "hello")
    ).orderBy("id").collect()
    assert (rows[0].metric, rows[0].group_by, rows[0].top_n, rows[0].order) == ("profit", "customername", 10, "desc")
    assert (rows[1].group_by, rows[1].top_n, rows[1].order, rows[1].year_id) == ("territory", 3, "asc", 2004)
    assert (rows[2].group_by, rows[2].month_id, rows[2].qtr_id) == ("month", 11, 2)
    assert (rows[3].metric, rows[3].group_by, rows[3].top_n) == ("sales", None, None)


def test_spec_defaults(spark):
    df = text.extract_entities(_ask(spark, "rank countries")).withColumn("intent", F.lit("ranking_query"))
    spec = text.build_specs(df).first()["spec"]
    assert (spec.top_n, spec.aggregation, spec.forecast) == (5, "sum", False)


def test_routing(spark):
    asked = {
        "What is my name?": "identity_query",
        "How many duplicates are there?": "dataset_ops_query",
        "Give me an executive summary": "analysis_summary_query",
        "How can I increase revenue?": "revenue_growth_query",
        "What will my sales be next month?": "forecast_query",
        "Show the weekly trend": "revenue_trend_query",
        "Which countries lead?": "fallback_query",
        "Which country leads?": "geography_query",
        "Revenue by gender": "demographic_query",
        "Who are the best buyers?": "top_customers_query",
        "tell me a joke": "fallback_query",
    }
    rows = text.route_questions(_ask(spark, *asked)).collect()
    got = {r.text: r for r in rows}
    expected = dict(asked)
    expected["Which countries lead?"] = "geography_query"  # plural of a word ending in y
    assert {q: r.intent for q, r in got.items()} == expected
    assert got["tell me a joke"].escalate and not got["What is my name?"].escalate
    assert got["tell me a joke"].confidence_label == "Medium"


def test_templates(spark):
    rows = text.match_templates(_ask(spark, "who are my TOP customers?", "which customers are lost")).orderBy("id").collect()
    assert (rows[0].matched_intent, rows[0].similarity) == ("find_top_customers", 1.0)
    assert rows[1].matched_intent is None


def _log(spark, turns):
    rows = [(1, i, role, message) for i, (role, message) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_qa_pairs(spark):
    long_answer = "This is a long enough answer."
    log = _log(
        spark,
        [
            ("user", "first?"), ("user", "really first?"), ("assistant", long_answer), ("assistant", "A second answer without question."),
            ("user", "short?"), ("assistant", "no"), ("user", "Really First?"), ("assistant", long_answer.upper()),
            ("system", "note"), ("user", "empty?"), ("assistant", "Please upload a file to continue."),
            ("user", "q?"), ("system", "x"), ("assistant", "  Answers survive a system turn.\n"),
        ],
    )
    rows = text.qa_pairs(log).orderBy("position").collect()
    assert [(r.position, r.question, r.answer) for r in rows] == [
        (1, "really first?", long_answer), (2, "q?", "Answers survive a system turn."),
    ]


def test_history_tail(spark):
    log = _log(spark, [("user", str(i)) for i in range(80)])
    assert sorted(r.turn for r in text.history_tail(log).collect()) == list(range(30, 80))


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("2024-01-03 10:00:00", 5.0), ("2024-01-01 09:00:00", 1.0), ("2024-01-02 09:00:00", 4.0)]
    events = spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    for i, r in enumerate(events.collect()):
        spark.createDataFrame([r]).coalesce(1).write.mode("append").parquet(folder)
    out = {str(r.window_start): r.total_value for r in live.refresh_kpis(live.event_stream(spark, folder, per_trigger=1)).collect()}
    assert out == {"2024-01-01": 1.0, "2024-01-02": 4.0, "2024-01-03": 5.0}
    alerts = {str(r.window_start): r.alert for r in live.refresh_alerts(live.event_stream(spark, folder)).collect()}
    assert alerts == {"2024-01-01": "normal", "2024-01-02": "spike", "2024-01-03": "spike"}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, table_path, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def arrive(ts, value):
        row = spark.createDataFrame([(ts, value)], "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        row.coalesce(1).write.mode("append").parquet(folder)

    def refresh():
        out = live.refresh_kpis(live.event_stream(spark, folder), table=table_path, state=state)
        return {str(r.window_start): (r.events, r.total_value) for r in out.collect()}

    arrive("2024-01-01 09:00:00", 1.0)
    assert refresh() == {"2024-01-01": (1, 1.0)}
    arrive("2024-01-01 12:00:00", 2.0)
    arrive("2024-01-02 12:00:00", 5.0)
    assert refresh() == {"2024-01-01": (2, 3.0), "2024-01-02": (1, 5.0)}
    assert refresh() == {"2024-01-01": (2, 3.0), "2024-01-02": (1, 5.0)}  # nothing new
    arrive("2024-01-01 23:00:00", 4.0)  # late
    assert refresh() == {"2024-01-01": (3, 7.0), "2024-01-02": (1, 5.0)}
    with pytest.raises(ValueError):
        live.refresh_kpis(live.event_stream(spark, folder), state=state)


def test_stream_on_given_events(spark, folder):
    out = live.refresh_kpis(live.event_stream(spark, folder, "events.parquet"))
    assert out.agg(F.sum("events")).first()[0] == table(spark, folder, "events").count()


def test_json_safe_and_flatten(spark, tmp_path):
    df = spark.sql("SELECT double('NaN') AS a, struct(double('Infinity') AS x, date '2024-01-02' AS d) AS s, array(1.5D, double('NaN')) AS l")
    path = str(tmp_path / "out")
    sinks.write_json(df.coalesce(1), path)
    line = json.loads(spark.read.text(path).first()[0])
    assert line == {"s": {"d": "2024-01-02"}, "l": [1.5, None]}
    nested = spark.sql("SELECT 3 AS n, struct('p' AS top, struct(1 AS deep, 2 AS low) AS in1) AS s, array(struct(7 AS v), struct(8 AS v)) AS l")
    pairs = {r.key: r.value for r in sinks.flatten(nested).collect()}
    assert pairs == {"n": "3", "s.top": "p", "s.in1.deep": "1", "s.in1.low": "2", "l[0].v": "7", "l[1].v": "8"}


def test_run_history_keeps_five(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(12).select(F.lit("u").alias("user"), F.col("id").alias("analyzed_at"))
    sinks.append_run(rows.where("id < 6"), path)
    sinks.append_run(rows.where("id >= 6"), path)
    assert sorted(r.analyzed_at for r in sinks.recent_runs(spark.read.parquet(path)).collect()) == [7, 8, 9, 10, 11]


def test_routes_follow_the_columns():
    def of(intent, *columns):
        return text.variant((intent, 0.9), columns)

    assert of("geography_query", "country", "total_amount") == ("geography_query", 0.72)
    assert of("geography_query", "product_category", "total_amount") == ("geography_proxy_query", 0.68)
    assert of("geography_query", "date") == ("geography_query", 0.64)
    assert of("demographic_query", "age", "total_amount") == ("demographic_query", 0.7)
    assert of("demographic_query", "total_amount") == ("demographic_query", 0.64)
    assert of("top_customers_query", "product_category", "total_amount") == ("top_customers_proxy_query", 0.7)
    assert of("forecast_query") == ("forecast_query", 0.9)


def test_similar_questions_against_all_pairs(spark):
    """Ten thousand known questions of few words, asked ones a word off: the same as comparing every pair; and no cross join."""
    import numpy as np

    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    known = [(" ".join(rng.choice(words, int(rng.integers(1, 9)))), f"i{k % 5}", k) for k in range(10_000)]
    asked = [" ".join(rng.permutation(known[int(k)][0].split()).tolist() + (["new"] if k % 2 else [])) for k in rng.integers(0, 10_000, 60)]
    asked += ["", "  ", "nothing alike", "W1  w1 w2", asked[0]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(asked)] + [(99, None)], "id int, text string")
    matched = text.similar_questions(df, spark.createDataFrame(known, "question string, intent string, ord long"))
    found = {r.id: (r.matched_question, r.matched_intent, r.similarity) for r in matched.collect()}
    sets = [set(q.split()) for q, _, _ in known]
    for k, t in enumerate(asked):
        own = set(t.lower().split())
        best = next(((q, i, len(own & s) / len(own | s)) for (q, i, _), s in zip(known, sets) if own and len(own & s) / len(own | s) > 0.6), (None,) * 3)
        assert found[k] == best
    assert found[99] == (None,) * 3
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_alike_questions_without_a_list_of_words_per_text(spark, monkeypatch):
    """Every pair compared by hand gives the same; words are not joined to be counted."""
    import random

    from ledgerlens.operators import text

    def listed(*_):
        raise AssertionError("words of a text were collected")

    dice = random.Random(5)
    known = [(f"{k} " + " ".join(dice.sample("abcdefghij", dice.randint(1, 8))), "i", k * 10) for k in range(60)]
    asked = [(k, " ".join(dice.sample([*"ABCDEFGHIJ", str(k % 60)], dice.randint(1, 9)))) for k in range(80)] + [(80, known[3][0]), (81, ""), (82, None)]
    monkeypatch.setattr(text.F, "collect_list", listed)
    found = text.similar_questions(spark.createDataFrame(asked, "id int, text string"), spark.createDataFrame(known, "question string, intent string, ord long"), above=0.4)
    got = {r["id"]: (r["matched_question"], r["similarity"]) for r in found.collect()}
    for k, words in asked:
        a, best = set((words or "").lower().split()), (None, None)
        for question, _, _ in reversed(known):
            b = set(question.split())
            if a and len(a & b) / len(a | b) > 0.4:
                best = question, len(a & b) / len(a | b)
        assert got[k] == best, words
