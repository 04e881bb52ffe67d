"""The gated analysis run: every step the schema allows, with a status row per step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import clean, customers, kpi, mapping, products, profile, timeseries
from ..operators.filters import last_days
from ..session import write_once
from ..sources.readers import read_dataset

# Accepted names of the advanced modules.
MODULE_NAMES = {
    "cohort": "cohort",
    "cohortanalysis": "cohort",
    "geographic": "geographic",
    "geographicanalysis": "geographic",
    "timeseries": "timeseries",
    "timeseriesanalysis": "timeseries",
    "churn": "churn",
    "churnprediction": "churn",
    "forecast": "forecast",
    "salesforecast": "forecast",
    "affinity": "affinity",
    "productaffinity": "affinity",
    "clv": "clv",
    "repeatpurchase": "repeatpurchase",
    "healthscore": "healthscore",
    "anomalies": "anomalies",
    "productperformance": "productperformance",
    "promotionalimpact": "promotionalimpact",
}


def _place(df: DataFrame) -> str:
    return "region" if "region" in df.columns else "country"


def _basket(df: DataFrame) -> str:
    return "transaction_id" if "transaction_id" in df.columns else "customer_id"


BASIC_STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kpis": lambda df: kpi.business_kpis(df),
    "trends": lambda df: kpi.revenue_trend(df, "month"),
    "top_categories": lambda df: kpi.top_categories(df),
    "segmentation": lambda df: kpi.spend_tiers(df),
    "forecast": lambda df: timeseries.smooth_forecast(timeseries.resample(df, "D")),
    "churn_prediction": lambda df: customers.churn_at_risk(df),
}
ADVANCED_STEPS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "cohort": (("customer_id", "date"), customers.cohort_table),
    "geographic": (("total_amount",), lambda df: products.geography(df, region=_place(df))),
    "timeseries": (("date", "total_amount"), lambda df: timeseries.decomposition_stats(timeseries.resample(df, "D"))),
    "churn": (("customer_id", "date", "total_amount"), customers.churn_at_risk),
    "forecast": (("date", "total_amount"), lambda df: timeseries.forecast_summary(timeseries.resample(df, "D"))),
    "affinity": (("customer_id", "product_category"), lambda df: products.affinity_rules(df, basket=_basket(df))),
    "clv": (("customer_id", "date", "total_amount"), customers.lifetime_summary),
    "repeatpurchase": (("customer_id", "date"), customers.repeat_summary),
    "healthscore": (("customer_id", "date", "total_amount"), customers.health_summary),
    "anomalies": (("date", "total_amount"), timeseries.anomaly_summary),
    "productperformance": (
        ("product_category", "total_amount"),
        lambda df: products.product_performance(df, product="product_category"),
    ),
    "promotionalimpact": (("total_amount",), products.promo_impact),
}


@dataclass
class Analysis:
    """Lazy results by step name, plus (step, status, reason, missing_columns) rows."""

    results: dict[str, DataFrame] = field(default_factory=dict)
    status: list[tuple] = field(default_factory=list)

    def status_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.status, "step string, status string, reason string, missing_columns array<string>"
        )

    def outcome(self, spark) -> DataFrame:
        """The status rows with the number of result rows of every completed step.

        Each result is written once, and counted by an observation while it is; ``results`` are the written ones from then on."""
        rows = {}
        for step, df in self.results.items():
            seen = Observation(step)
            self.results[step] = write_once(df.observe(seen, F.count(F.lit(1)).alias("result_rows")))
            rows[step] = seen.get["result_rows"]
        counted = [(*status, rows.get(status[0])) for status in self.status]
        return spark.createDataFrame(counted, "step string, status string, reason string, missing_columns array<string>, result_rows bigint")


def module_key(name: str) -> str:
    key = "".join(ch for ch in name.lower() if ch.isalnum())
    return MODULE_NAMES.get(key, key)


def run_basic(df: DataFrame) -> Analysis:
    """KPIs, trend, categories, tiers, forecast, churn - as far as the columns allow."""
    able = mapping.capabilities(df.columns)
    run = Analysis()
    df = write_once(df)  # the steps share one copy and read only their columns of it
    for step, make in BASIC_STEPS.items():
        missing = [c for c in mapping.REQUIREMENTS[step] if c not in df.columns]
        if not able[step]:
            run.status.append((step, "skipped", "required columns missing", missing))
            continue
        run.results[step] = make(df)
        run.status.append((step, "completed", "", []))
    return run


def run_advanced(df: DataFrame, selected: Sequence[str] = ()) -> Analysis:
    """The chosen advanced modules (all when none is named)."""
    wanted = [module_key(s) for s in selected if s.strip()] or list(ADVANCED_STEPS)
    run = Analysis()
    df = write_once(df)  # as above
    for step in dict.fromkeys(wanted):
        if step not in ADVANCED_STEPS:
            run.status.append((step, "skipped", "unknown module", []))
            continue
        needs, make = ADVANCED_STEPS[step]
        missing = [c for c in needs if c not in df.columns]
        if step == "geographic" and not {"region", "country"} & set(df.columns):
            missing.append("region")
        if missing:
            run.status.append((step, "skipped", "required columns missing", missing))
            continue
        run.results[step] = make(df)
        run.status.append((step, "completed", "", []))
    return run


@dataclass
class Dataset:
    """An ingested table: raw and canonical frames, mapping, quality and mode."""

    raw: DataFrame
    frame: DataFrame
    mode: str
    mapped: dict[str, str]
    quality: DataFrame
    issues: DataFrame | None = None
    confidence: str | None = None


def ingest(spark, path: str, fmt: str | None = None, **options) -> Dataset:
    """Read, sanitise, score, map, validate and clean; fall back to exploration when date or amount is missing."""
    return ingest_frame(read_dataset(spark, path, fmt, **options))


def ingest_frame(raw: DataFrame) -> Dataset:
    cleaned = clean.sanitize(raw)
    quality = profile.quality_score(cleaned)
    seen = mapping.column_facts(cleaned)
    mapped = mapping.auto_map(cleaned, facts=seen)
    canonical = cleaned.withColumnsRenamed({s: r for r, s in mapped.items() if s != r and r not in cleaned.columns})
    facts = mapping.renamed_facts(seen, mapped)
    if mapping.validate_required(canonical, facts):
        return Dataset(raw, cleaned, "exploratory_only", mapped, quality)
    frame = write_once(clean.canonical_frame(cleaned, mapped, facts["date"]["day_first"], whole=True))  # texts are parsed here and not again
    mode = mapping.analysis_mode(mapping.capabilities(frame.columns))
    return Dataset(
        raw, frame, mode, mapped, quality, mapping.mapping_issues(canonical, facts), mapping.mapping_confidence(canonical, facts)
    )


def analyze(spark, path: str, fmt: str | None = None, **options) -> tuple[Dataset, Analysis, list[str]]:
    """Ingest a file and run everything its columns allow; also the questions worth asking."""
    data = ingest(spark, path, fmt, **options)
    if data.mode == "exploratory_only":
        return data, Analysis(profile.exploratory_summary(data.frame)), mapping.suggested_questions({})
    able = mapping.capabilities(data.frame.columns)
    return data, run_basic(data.frame), mapping.suggested_questions(able)


def report_sections(df: DataFrame, quality: DataFrame) -> dict[str, DataFrame]:
    """The seven parts of an exported report; write them with ``sinks.write_sections``."""
    return {
        "kpis": kpi.business_kpis(df),
        "trends": kpi.revenue_trend(df, "month"),
        "categories": kpi.top_categories(df, n=10),
        "segments": kpi.spend_tiers(df),
        "forecast": timeseries.smooth_forecast(timeseries.resample(df, "D")),
        "at_risk": customers.churn_at_risk(df),
        "metadata": quality,
    }


def subset_report(df: DataFrame, days: int | None = None) -> dict[str, DataFrame]:
    """KPIs, trend, categories and tiers of a filtered frame (category, segment or time filters come first)."""
    df = last_days(df, days)
    return {
        "kpis": kpi.business_kpis(df),
        "trends": kpi.revenue_trend(df, "month"),
        "categories": kpi.top_categories(df) if "product_category" in df.columns else kpi.revenue_by(df, F.lit("all"), "name"),
        "segments": kpi.spend_tiers(df),
    }
