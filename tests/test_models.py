"""Model helpers: shapes, ranges, repeatability."""

from pyspark.sql import functions as F

from ledgerlens.operators import customers, ml
from ledgerlens.plans.catalog.text import opening_intent, questions
from ledgerlens.plans.facts import orders_fact
from ledgerlens.session import scratch_path


def test_segments_survive_saving(spark, folder):
    scores = customers.rfm(orders_fact(spark, folder, ["customer_id", "date", "total_amount"]))
    model = ml.train_segments(scores)
    path = scratch_path(spark, "model")
    ml.save_model(model, path)
    a = {tuple(r) for r in ml.assign_segments(model, scores).select("customer_id", "cluster").collect()}
    b = {tuple(r) for r in ml.assign_segments(ml.load_model(path), scores).select("customer_id", "cluster").collect()}
    assert a == b and {c for _, c in a} == {0, 1, 2, 3}
    assert ml.segment_profile(ml.assign_segments(model, scores)).agg(F.sum("customers")).first()[0] == scores.count()


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("label"))
    train, test = ml.stratified_split(df, "label", ["id"])
    again, _ = ml.stratified_split(df.repartition(7), "label", ["id"])
    assert train.count() + test.count() == 4000
    assert {r.id for r in train.collect()} == {r.id for r in again.collect()}
    shares = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 290 < shares["rare"] < 350 and 2750 < shares["common"] < 3000


def test_intents_are_learned(spark, folder):
    labelled = questions(spark, folder).withColumn("intent", opening_intent(F.col("text")))
    _, scored, scores = ml.train_intents(labelled, ["id"], features=256, trees=5)
    assert max(scores.values()) > 0.9
    report = {r["class"]: r for r in ml.class_report(scored).collect()}
    assert all(0 <= r.precision <= 1 and 0 <= r.f1 <= 1 for r in report.values())


def test_class_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    got = {r["class"]: (r.support, round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in ml.class_report(df).collect()}
    assert got == {"a": (2, 1.0, 0.5, 0.667), "b": (1, 0.333, 1.0, 0.5), "c": (1, 0.0, 0.0, 0.0)}


def test_cross_validation(spark, folder):
    labelled = questions(spark, folder).withColumn("intent", opening_intent(F.col("text"))).limit(300)
    assert 0.5 < ml.cross_validated_accuracy(labelled, folds=2, features=128) <= 1.0


def test_column_roles(spark, folder):
    from ledgerlens.plans.catalog.learned import _descriptions

    described = _descriptions(spark, folder)
    model = ml.train_column_roles(described)
    out = ml.predict_column_roles(model, described)
    assert out.where("confidence < 0 or confidence > 1").count() == 0
    assert out.where("role = label").count() / out.count() > 0.8
    assert 0 < ml.confidence_threshold(out).first()["threshold"] <= 1


def test_out_of_fold_predictions(spark):
    """Each row once, in a fold of its own key, and a report that SQL gives from the predictions alone."""
    import duckdb

    rows = [(k, f"{'red rose' if k % 3 else 'blue sky'} word{k % 7}", "warm" if k % 3 else "cold") for k in range(150)] + [(999, "no label", None)]
    df = spark.createDataFrame(rows, "id long, text string, kind string")
    predicted = ml.out_of_fold(df, ["id"], "kind", folds=3)
    assert sorted(r.id for r in predicted.collect()) == list(range(150))
    assert predicted.where("kind = predicted").count() == 150
    shuffled = df.withColumn("kind", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "a").otherwise("b"))  # nothing to learn
    predicted = ml.out_of_fold(shuffled, ["id"], "kind", folds=3)
    con = duckdb.connect()
    con.register("p", predicted.toArrow())
    wanted = con.execute(
        """WITH per AS (SELECT fold, count(*) AS n, avg((kind = predicted)::INT) AS a FROM p GROUP BY fold)
        SELECT fold, n, a, (SELECT avg(a) FROM per), (SELECT stddev_samp(a) FROM per), (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM p GROUP BY kind)) FROM per ORDER BY fold"""
    ).fetchall()
    found = [tuple(r) for r in ml.fold_report(predicted, "kind").orderBy("fold").collect()]
    assert [f[:2] for f in found] == [w[:2] for w in wanted] and all(abs(a - b) < 1e-9 for f, w in zip(found, wanted) for a, b in zip(f[2:], w[2:]))
    assert found[0][3] < 0.75


def test_intent_forest_gets_what_varies_over_many_tasks(spark, monkeypatch):
    """One file of few bytes used to be one task with a row as 8 192 numbers."""
    seen = _forest_inputs(monkeypatch, 16)
    rows = [(k, f"{'Predict' if k % 2 else 'Compare'} word{k % 5}", "a" if k % 2 else "b") for k in range(200)]
    _, scored, scores = ml.train_intents(spark.createDataFrame(rows, "id long, text string, intent string").coalesce(1), ["id"], features=256, trees=3)
    (tasks, width), = seen
    assert tasks > 5 and 0 < width < 40 and set(scores) == {"logistic_regression", "random_forest"}
    assert scored.where("label = prediction").count() == scored.count() > 0


def test_intent_forest_without_varying_features(spark):
    rows = spark.createDataFrame([(k, "same words", "a" if k % 3 else "b") for k in range(60)], "id long, text string, intent string")
    _, _, scores = ml.train_intents(rows, ["id"], features=16, trees=2)
    assert scores["random_forest"] > 0.4


def _forest_inputs(monkeypatch, rows_per_task):
    """``(tasks, features)`` of what forests are fitted on from now on."""
    seen, fit = [], ml.RandomForestClassifier.fit

    def noted(self, df):
        seen.append((df.rdd.getNumPartitions(), len(df.first()[self.getFeaturesCol()])))
        return fit(self, df)

    monkeypatch.setattr(ml.RandomForestClassifier, "fit", noted)
    monkeypatch.setattr(ml, "TASK_ROWS", rows_per_task)
    return seen


def test_churn_forest_is_trained_by_many_tasks(spark, monkeypatch):
    seen = _forest_inputs(monkeypatch, 16)
    rows = spark.createDataFrame([(float(k % 2), k % 50, "AB"[k % 2], "x") for k in range(160)], "label double, size long, segment string, kind string")
    model = ml.train_churn(rows.coalesce(1), ["size"], ["segment", "kind"], trees=3)
    assert seen[0][0] == 10
    assert ml.score_churn(model, rows).where("label = prediction").count() == 160
    assert ml.feature_importance(model, rows).count() > 0


def _signal(spark, copies=500):
    """Rows of 36 kinds of features, each with both labels; ``size`` and ``kind`` say how often the label is 1. Some features are null."""
    rows = spark.range(copies * 36).selectExpr("id % 36 AS f", "pmod(xxhash64(id), 12) AS luck")
    rows = rows.selectExpr("CAST(f % 6 AS INT) AS size", "array('A', 'B', NULL)[CAST(f DIV 6 % 3 AS INT)] AS segment", "array('x', 'y')[CAST(f DIV 18 AS INT)] AS kind", "luck")
    return rows.selectExpr("size", "segment", "kind", "CAST(luck < size + IF(kind = 'x', 5, 1) AS DOUBLE) AS label")


def test_churn_forest_grows_on_counted_rows(spark, monkeypatch):
    """It is given no row twice, and tells what a forest on all rows tells."""
    rows, seen, fit = _signal(spark), [], ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    model = ml.train_churn(rows, ["size"], ["segment", "kind"], trees=24)
    assert len(seen) == 24 and max(seen) <= 72
    forest = model.stages[-1]
    assert (forest.getNumTrees, forest.numClasses, forest.numFeatures) == (24, 2, 5) and len({t.toDebugString for t in forest.trees}) > 12
    plain = ml.Pipeline(stages=ml.feature_stages(["size"], ["segment", "kind"])).fit(rows)
    whole = fit(ml.RandomForestClassifier(numTrees=24, seed=1, featuresCol="features", labelCol="label"), plain.transform(rows).select("label", "features"))
    asked = rows.select("size", "segment", "kind").distinct()
    risks = [{tuple(r)[:3]: r.churn_risk_score for r in ml.score_churn(m, asked).select("size", "segment", "kind", "churn_risk_score").collect()} for m in (model, ml.PipelineModel(stages=[*plain.stages, whole]))]
    assert max(abs(risks[0][k] - risks[1][k]) for k in risks[1]) < 0.12 and len(risks[1]) == 36
    path = scratch_path(spark, "forest")
    ml.save_model(model, path)
    assert ml.load_model(path).stages[-1].toDebugString == forest.toDebugString
    again = ml.score_churn(ml.train_churn(rows.repartition(7), ["size"], ["segment", "kind"], trees=24), asked)
    assert {tuple(r)[:3]: r.churn_risk_score for r in again.select("size", "segment", "kind", "churn_risk_score").collect()} == risks[0]


def test_importance_of_a_forest_on_counted_rows(spark, monkeypatch):
    """No more rows are fitted than there are different ones; the importance is that of a forest on all rows."""
    rows, seen, fit = _signal(spark), [], ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    found = dict(ml.feature_importance(ml.train_churn(rows, ["size"], ["segment", "kind"], trees=24), rows).collect())
    assert max(seen) <= 72 and list(found) != sorted(found) and abs(sum(found.values()) - 1) < 1e-9
    plain = ml.Pipeline(stages=ml.feature_stages(["size"], ["segment", "kind"])).fit(rows)
    whole = fit(ml.RandomForestClassifier(numTrees=24, seed=1, featuresCol="features", labelCol="label"), plain.transform(rows).select("label", "features"))
    wanted = dict(ml.feature_importance(ml.PipelineModel(stages=[*plain.stages, whole]), rows).collect())
    assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 0.15 for k in wanted)


def test_counted_rows_are_drawn_as_often_as_rows(spark):
    counted = spark.createDataFrame([(float(k % 2), k, 1 if k < 400 else 1000) for k in range(800)], "label double, size int, times long")
    drawn = ml.bootstrapped(counted, 10)
    found = {r["size"]: [r[f"t{k}"] for k in range(10)] for r in drawn.collect()}
    for many, least, most in ((1, 0, 400), (1000, 400, 800)):
        n = [x for size, draws in found.items() if least <= size < most for x in draws]
        mean = sum(n) / len(n)
        assert abs(mean / many - 1) < 0.1 and abs(sum((x - mean) ** 2 for x in n) / len(n) / many - 1) < 0.15
    other = ml.bootstrapped(counted.repartition(5), 10)
    assert {r["size"]: [r[f"t{k}"] for k in range(10)] for r in other.collect()} == found


def test_levels_of_counted_rows(spark):
    """In the order of Spark's indexer on the rows themselves."""
    rows = spark.createDataFrame([(x, 1.0) for x in ["b", "b", "a", "c", "c", None, "d", "Z", "\U0001f600", "\uffee"]], "kind string, label double")
    levels = ml.levels_of(rows.groupBy("kind").count().withColumnRenamed("count", "times"), "kind")
    assert levels == ml.StringIndexer(inputCol="kind", outputCol="i", handleInvalid="keep").fit(rows).labels


def test_folds_share_the_words_of_a_text(spark, monkeypatch):
    made, tokenizer = [], ml.RegexTokenizer
    monkeypatch.setattr(ml, "RegexTokenizer", lambda **kw: made.append(1) or tokenizer(**kw))
    df = spark.createDataFrame([(k, "red rose" if k % 3 else "blue sky", "warm" if k % 3 else "cold") for k in range(60)], "id long, text string, kind string")
    predicted = ml.out_of_fold(df, ["id"], "kind", folds=3, features=64)
    assert predicted.columns == ["id", "text", "kind", "fold", "predicted"]
    assert predicted.where("kind = predicted").count() == 60 and len(made) == 1
