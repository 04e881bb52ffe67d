"""Models trained on the given tables; checked by rows, ranges and repeatability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import customers, mapping, ml
from ...operators import timeseries as ts
from ...session import materialize, scratch_path, write_once
from ..facts import TABLES, order_revenue, orders_fact, sales, table
from .registry import R, query, tidy, with_sales
from .text import opening_intent, questions


@query()
def kmeans_segments(spark, folder):
    scores = write_once(customers.rfm(orders_fact(spark, folder, ["customer_id", "date", "total_amount"])))
    path = scratch_path(spark, "segment-model")
    ml.save_model(ml.train_segments(scores), path)
    return tidy(ml.segment_profile(ml.assign_segments(ml.load_model(path), scores)))


def _purchases(spark, folder):
    rows = sales(spark, folder, ["customer_id", "date", "total_amount", "size", "segment", "product_category", "transaction_id"])
    return write_once(ml.churn_labels(rows), ml.TASK_ROWS)  # every stage of the training reads it


def _churn(spark, folder):
    train, test = ml.stratified_split(_purchases(spark, folder), "label", ["transaction_id"])
    model = ml.train_churn(train, ["size"], ["segment", "product_category"])
    return model, test


@query()
def churn_forest(spark, folder):
    model, test = _churn(spark, folder)
    columns = ["customer_id", "total_amount", "label", "prediction", "rawPrediction", "churn_risk_score"]
    scored = write_once(ml.score_churn(model, test).select(*columns))
    report = ml.binary_report(scored)
    exposed = ml.churn_exposure(scored)
    return report.select("*", *[exposed.select(c).scalar().alias(c) for c in exposed.columns])


@query()
def churn_feature_importance(spark, folder):
    model, test = _churn(spark, folder)
    return ml.feature_importance(model, test)


@query()
def weekly_forest_forecast(spark, folder):
    series = materialize(ts.resample(order_revenue(spark, folder, ["date", "total_amount"]), "W"))
    model = ml.train_weekly(series)
    return ml.forecast_weeks(model, series).withColumn("mae", F.lit(ml.mean_absolute_error(model, series)))


@query()
def intent_model(spark, folder):
    """Per-intent precision and recall on held-out questions derived from the orders."""
    labelled = questions(spark, folder).withColumn("intent", opening_intent(F.col("text")))
    model, scored, scores = ml.train_intents(labelled, ["id"])
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    named = scored.select(
        F.get(names, F.col("label").cast("int")).alias("label"), F.get(names, F.col("prediction").cast("int")).alias("prediction")
    )
    return ml.class_report(named).withColumns({f"accuracy_{k}": F.lit(v) for k, v in scores.items()})


@query()
def quality_out_of_fold(spark, folder):
    """How well the given quality labels of documents, which no rule of ours makes, are predicted from their texts by models that did not see them."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    labelled = table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id")
    return tidy(ml.fold_report(ml.out_of_fold(labelled, ["doc_id"], "quality"), "quality"), 4)


def _descriptions(spark, folder) -> DataFrame:
    """Descriptions of all columns of all tables; a label where the name says the role."""
    parts = [ml.column_descriptions(table(spark, folder, t)).withColumn("source", F.lit(t)) for t in TABLES]
    return reduce(DataFrame.unionByName, parts).withColumn("label", _role_of(F.col("column_name")))


# What the columns of the test tables are, in the roles of the mapper.
ROLE_PATTERNS = (
    ("Date", "date$|^ts$"),
    ("ID", "key$|_id$|^turn$|number$"),
    ("Location", "^n_name$|^r_name$"),
    ("Numeric", "price$|acctbal$|quantity$|discount$|tax$|size$|value$|chars$|^embedding$"),
    ("Text", "^text$|props$|_name$|^html$|^url$"),
)


def _role_of(name):
    out = F.lit("Categorical")
    for role, pattern in reversed(ROLE_PATTERNS):
        out = F.when(name.rlike(pattern), F.lit(role)).otherwise(out)
    return out


def _held_out_roles(spark, folder) -> DataFrame:
    """Predictions for the fifth of all columns that the model did not see; numbered twins of a table stay together by name."""
    train, test = ml.stratified_split(materialize(_descriptions(spark, folder)), "label", ["column_name"], 0.7)
    return materialize(ml.predict_column_roles(ml.train_column_roles(train), test))


@query()
def column_role_model(spark, folder):
    """Roles of held-out columns, with the accuracy and the recommended threshold on them."""
    predicted = _held_out_roles(spark, folder)
    limit = ml.confidence_threshold(predicted)
    right = F.avg((F.col("role") == F.col("label")).cast("double"))
    return predicted.withColumns({"threshold": limit.scalar(), "accuracy": predicted.agg(right.alias("a")).scalar()})


@query()
def column_role_report(spark, folder):
    """Precision, recall and support per role on the held-out columns."""
    return ml.class_report(_held_out_roles(spark, folder), prediction="role")


def _role_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(column_name, '{pattern}') THEN '{role}'" for role, pattern in ROLE_PATTERNS)
    columns = " UNION ALL ".join(f"SELECT column_name FROM (DESCRIBE {t})" for t in TABLES)
    return f"SELECT CASE {cases} ELSE 'Categorical' END AS label, count(*) AS columns FROM ({columns}) GROUP BY 1"


@query(_role_sql())
def column_role_labels(spark, folder):
    """How often each role labels a column of the given tables."""
    return _descriptions(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("columns"))


@query()
def column_role_mapping(spark, folder):
    """Classifier roles feed the automatic mapping of the orders table."""
    model = ml.train_column_roles(_descriptions(spark, folder))
    orders = table(spark, folder, "orders")
    chosen = mapping.auto_map(orders, predicted=ml.roles_by_model(model, orders))
    return spark.createDataFrame(sorted(chosen.items()), "role string, source string")


@query(
    with_sales(
        f"""SELECT region, step, {R('level + last * phi * (1 - pow(phi, step)) / (1 - phi)')} AS forecast
        FROM fitted CROSS JOIN (SELECT unnest(range(1, 4)) AS step)""",
        """months AS (SELECT region, date_trunc('month', date) AS m, sum(total_amount) AS v FROM sales GROUP BY 1, 2),
        filled AS (SELECT s.region, s.m, coalesce(v, 0) AS y FROM (SELECT region, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m
          FROM months GROUP BY region) s LEFT JOIN months USING (region, m)),
        changes AS (SELECT *, y - lag(y) OVER (PARTITION BY region ORDER BY m) AS d FROM filled),
        pairs AS (SELECT *, lag(d) OVER (PARTITION BY region ORDER BY m) AS b FROM changes),
        fitted AS (SELECT region, least(greatest(coalesce(sum(d * b) / nullif(sum(b * b) FILTER (d IS NOT NULL), 0), 0), -0.98), 0.98) AS phi,
          arg_max(y, m) AS level, coalesce(arg_max(d, m), 0) AS last FROM pairs GROUP BY region)""",
    )
)
def arima_per_region(spark, folder):
    monthly = ml.monthly_by(order_revenue(spark, folder, ["region", "date", "total_amount"]), "region")
    return tidy(ml.arima_forecast(monthly, "region"))
