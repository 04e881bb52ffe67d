"""Exact order statistics, skewed, tied and with infinite values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.edge import edge_round
from ledgerlens.operators import scale
from ledgerlens.operators.scale import column_quantiles, exact_quantiles, first_per_group, global_rank, running_totals, top_n
from ledgerlens.session import materialize, scratch_root

PROBS = {"q0": 0.0, "q10": 0.1, "q33": 0.33, "q50": 0.5, "q66": 0.66, "q75": 0.75, "q100": 1.0}


def _values(kind: str, n: int):
    rng = np.random.default_rng(3)
    return {
        "spread": rng.normal(0, 1000, n),
        "long tail": np.exp(rng.normal(0, 8, n)),
        "one third equal": np.where(np.arange(n) % 3 == 0, 7.0, rng.integers(0, 50, n)),
        "all equal": np.full(n, 4.25),
        "two values": np.where(np.arange(n) % 2 == 0, -1.0, 1e12),
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "long tail", "one third equal", "all equal", "two values"])
@pytest.mark.parametrize("n", [1, 101, 1000])
def test_quantiles_equal_numpy(spark, kind, n):
    values = _values(kind, n)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = [np.quantile(values, p) for p in PROBS.values()]
    got = exact_quantiles(df, "v", PROBS).first()
    assert list(got.asDict()) == list(PROBS)
    assert np.allclose(list(got), want, rtol=1e-12, atol=1e-9)


def test_quantiles_with_infinite_values_and_a_range_that_overflows(spark):
    inf = float("inf")
    values = [-inf, -1.7e308, 5.0, 5.0, 1.7e308, inf, inf]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = exact_quantiles(df, "v", {"a": 0.0, "b": 1 / 6, "c": 0.4, "d": 0.5, "e": 5 / 6, "f": 1.0}).first()
    assert tuple(got) == (-inf, -1.7e308, 5.0, 5.0, inf, inf)
    many = spark.range(201).selectExpr("IF(id = 200, double('Infinity'), double(id)) AS v")
    assert exact_quantiles(many, "v", {"m": 0.5, "t": 1.0}).first() == (100.0, inf)


def test_quantiles_by_group(spark):
    rows = [("hot", float(i % 97)) for i in range(600)] + [(f"g{i}", float(i + j)) for i in range(30) for j in range(5)]
    df = spark.createDataFrame(rows + [(None, 1.0), ("hot", None), ("hot", float("nan"))], "k string, v double")
    found = {r["k"]: tuple(r)[1:] for r in exact_quantiles(df, "v", PROBS, by=["k"]).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(found) == set(groups)
    for key, values in groups.items():
        assert np.allclose(found[key], [np.quantile(values, p) for p in PROBS.values()])


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", {"q": 0.5}).first()["q"] is None


def test_rank_numbers_every_row_and_spreads_ties(spark):
    df = materialize(spark.range(500).select("id", (F.col("id") % 3).alias("v")))
    found = global_rank(df, [F.col("v").desc(), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 501))
    assert [r["id"] for r in found] == [r["id"] for r in sorted(df.collect(), key=lambda r: (-r["v"], r["id"]))]


def test_running_totals_in_order(spark):
    df = spark.range(300).selectExpr("id % 7 AS g", "id AS k", "id % 5 AS v")
    total = 0
    for r in sorted(running_totals(df, ["g", "k"], {"upto": "v"}).collect(), key=lambda r: (r.g, r.k)):
        total += r.v
        assert r.upto == total


def test_top_n_and_first_per_group(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("g"))
    assert [r["id"] for r in top_n(df, [F.col("id").desc()], 3).orderBy("rank").collect()] == [99, 98, 97]
    kept = first_per_group(df, ["g"], [F.col("id")], 2)
    assert kept.count() == 8
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


class _Session:
    """Just the two settings the scratch folder looks at."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_follows_the_session():
    assert scratch_root(_Session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            scratch_root(_Session(master))


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(12.34497, 79.9497, -12.345, 12.345, 0.1 + 0.2)], "a double, b double, c double, d double, e double")
    got = df.select(edge_round("a"), edge_round("b", 1), edge_round("c"), edge_round("d"), edge_round("e", 4)).first()
    assert tuple(got) == (12.34, 79.9, -12.35, 12.35, 0.3)


def test_values_are_rounded_once(spark):
    df = spark.createDataFrame([(12.3449996, 79.9499997, 12.345 - 2e-14, 1234.5649999)], "a double, b double, c double, d double")
    got = df.select(edge_round("a"), edge_round("b", 1), edge_round("c"), edge_round("d")).first()
    assert tuple(got) == (12.34, 79.9, 12.35, 1234.56)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles_narrow_their_brackets(spark, by):
    """Columns of 40 000 values, brackets that may hold 300 of them: several passes, same answer."""
    rng = np.random.default_rng(8)
    a, b = np.exp(rng.normal(0, 5, 40_000)), np.where(np.arange(40_000) % 2 == 0, 3.0, rng.integers(0, 9000, 40_000))
    df = spark.createDataFrame([(int(k % 3 == 0), float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "g int, a double, b double")
    wanted = {"a": {"a10": 0.1, "a50": 0.5}, "b": {"b40": 0.4, "b99": 0.99}}
    for r in column_quantiles(df, wanted, by, keep=300).collect():
        own = np.arange(40_000) % 3 == 0 if by and r.g else np.arange(40_000) % 3 != 0 if by else np.full(40_000, True)
        want = [np.quantile(a[own], 0.1), np.quantile(a[own], 0.5), np.quantile(b[own], 0.4), np.quantile(b[own], 0.99)]
        assert np.allclose([r.a10, r.a50, r.b40, r.b99], want, rtol=1e-12)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch, by):
    """Sketches so small, with no slack, that ranks fall outside: the counts notice and the answer stays exact."""
    monkeypatch.setattr(scale, "SKETCH_SIZE", 8)
    monkeypatch.setattr(scale, "SLACK", 0.0)
    values = np.random.default_rng(9).normal(0, 1, 20_000)
    df = spark.createDataFrame([(1, float(x)) for x in values], "g int, v double")
    found = column_quantiles(df, {"v": PROBS}, by).select(*PROBS).first()
    assert np.allclose(list(found), [np.quantile(values, p) for p in PROBS.values()], rtol=1e-12)


def test_quantiles_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("b", 2.0, None)], "k string, x double, y double")
    found = {r.k: (r.x, r.y) for r in column_quantiles(df, {"x": {"x": 0.5}, "y": {"y": 0.5}}, ["k"]).collect()}
    assert found == {"a": (None, 2.0), "b": (2.0, None)}


def test_report_parts_share_one_join(spark, folder, monkeypatch):
    from ledgerlens.plans.catalog import storage

    read, parts = [], storage.report_sections
    monkeypatch.setattr(storage, "report_sections", lambda rows, quality: read.extend(rows.inputFiles() + quality.inputFiles()) or parts(rows, quality))
    assert storage.export_report(spark, folder).count() == 7
    assert read and not any("lineitem" in f for f in read)
